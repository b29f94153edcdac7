"""Corridor, country and commodity queries over the metrics table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tradelanes.dimensions import CountryBook
from tradelanes.functions.guards import stable, zero_if_null
from tradelanes.functions.text import contains_text, hs_chapter, six_digit_hs
from tradelanes.operators.alerts import CORRIDOR
from tradelanes.session import materialise

TOP_METRICS = ("his", "severity_total", "notification_count", "hdi", "cvs")

PRESETS: dict[str, dict] = {
    "high_hazard": {"min_his": 0.5},
    "active_destination": {"active_only": True},
    "notifier": {"role": "notifier"},
    "eu_to_eu": {"origin_eu": True, "dest_eu": True},
    "non_eu_to_eu": {"origin_eu": False, "dest_eu": True},
}


#: Rows up to which a page is taken from the largest rows of each task.
_SHALLOW = 10_000
#: A number made in order has the task in its upper bits, the row of the task in these.
_PART_BITS = 33


def by_metric(metric: Column) -> list[Column]:
    """Largest first; equal values in corridor order."""
    return [stable(metric).desc(), *[F.col(k) for k in CORRIDOR]]


def _score(corridors: DataFrame) -> Column:
    return F.col("cvs") if "cvs" in corridors.columns else F.lit(None).cast("double")


def corridor_predicate(
    corridors: DataFrame,
    book: CountryBook,
    *,
    commodity: str | None = None,
    origin: int | None = None,
    destination: int | None = None,
    min_his: float | None = None,
    min_hdi: float | None = None,
    min_cvs: float | None = None,
    min_notification_count: int | None = None,
    active_only: bool = False,
    role: str | None = None,
    has_cvs: bool | None = None,
    origin_eu: bool | None = None,
    dest_eu: bool | None = None,
) -> Column:
    """All given conditions together. Code 0 and empty text mean no condition."""
    cvs = _score(corridors)
    tests = [F.lit(True)]
    if commodity:
        tests.append(F.col("commodity_hs") == commodity)
    if origin:
        tests.append(F.col("origin_m49") == origin)
    if destination:
        tests.append(F.col("destination_m49") == destination)
    if min_his is not None:
        tests.append(stable(zero_if_null(F.col("his"))) >= min_his)
    if min_hdi is not None:
        tests.append(stable(zero_if_null(F.col("hdi"))) >= min_hdi)
    if min_cvs is not None:
        tests.append(cvs.isNotNull() & (stable(cvs) >= min_cvs))
    if min_notification_count is not None:
        tests.append(F.col("notification_count") >= min_notification_count)
    if active_only:
        tests.append(F.col("is_active_destination"))
    if role:
        tests.append(F.array_contains("destination_roles", role))
    if has_cvs is not None:
        tests.append(cvs.isNotNull() if has_cvs else cvs.isNull())
    for wanted, code in ((origin_eu, "origin_m49"), (dest_eu, "destination_m49")):
        if wanted is not None:
            member = book.is_eu(F.col(code))
            tests.append(member if wanted else ~member)
    result = tests[0]
    for test in tests[1:]:
        result = result & test
    return result


def filter_corridors(corridors: DataFrame, book: CountryBook, limit: int | None = None, **conditions) -> DataFrame:
    """Matching corridors, most hazardous first; all of them unless ``limit`` is given."""
    if limit is not None and limit < 1:
        raise ValueError("limit must be positive")
    kept = corridors.where(corridor_predicate(corridors, book, **conditions)).orderBy(*by_metric(F.col("his")))
    return kept if limit is None else kept.limit(limit)


def count_corridors(corridors: DataFrame, book: CountryBook, **conditions) -> DataFrame:
    """How many corridors match, before any limit."""
    return corridors.where(corridor_predicate(corridors, book, **conditions)).agg(F.count("*").alias("count"))


def corridor_presets(corridors: DataFrame, book: CountryBook) -> DataFrame:
    """Size of each saved filter, all counted in one pass."""
    flags = [
        F.count_if(corridor_predicate(corridors, book, **conditions)).alias(name)
        for name, conditions in PRESETS.items()
    ]
    counts = corridors.agg(*flags)
    pairs = [F.struct(F.lit(n).alias("preset"), F.col(n).alias("corridors")) for n in PRESETS]
    return counts.select(F.inline(F.array(*pairs)))


def corridor_lookup(corridors: DataFrame, commodity: str, destination: int, origin: int) -> DataFrame:
    return corridors.where(
        (F.col("commodity_hs") == commodity)
        & (F.col("destination_m49") == destination)
        & (F.col("origin_m49") == origin)
    )


def corridor_hazard_lookup(corridors: DataFrame, commodity: str, destination: int, origin: int) -> DataFrame:
    return corridor_lookup(corridors, commodity, destination, origin).select(
        *CORRIDOR, "his", "hdi", "notification_count", "severity_total"
    )


def top_corridors(corridors: DataFrame, n: int = 50, sort_by: str = "his") -> DataFrame:
    """The ``n`` corridors highest by a metric; an unknown metric means hazard intensity."""
    if n < 1:
        raise ValueError("n must be positive")
    metric = F.col(sort_by) if sort_by in TOP_METRICS and sort_by in corridors.columns else F.col("his")
    return corridors.orderBy(*by_metric(zero_if_null(metric.cast("double")))).limit(n)


def text_search(df: DataFrame, columns: list[str], query: str) -> DataFrame:
    if not query.strip():
        return df
    return df.where(contains_text([F.col(c) for c in columns], query))


def sort_page(
    df: DataFrame, column: str, keys: list[str], descending: bool = True, page: int = 0, size: int = 25
) -> DataFrame:
    """One page in the order of a column, missing values last either way.

    The first pages are the largest rows of each task. A page further down is
    cut out of a sort that many tasks share: the sorted rows are written with
    a number that rises with the order, the rows of each part are counted, and
    the page is a range of numbers.
    """
    numeric = dict(df.dtypes)[column] in ("double", "float")
    value = stable(F.col(column)) if numeric else F.col(column)
    order = [value.desc_nulls_last() if descending else value.asc_nulls_last(), *keys]
    begin, end = page * size, (page + 1) * size
    if end <= _SHALLOW:
        return df.orderBy(*order).offset(begin).limit(size)
    numbered = materialise(df.orderBy(*order).withColumn("_number", F.monotonically_increasing_id()))
    part = F.shiftright("_number", _PART_BITS)
    sizes = numbered.groupBy(part.alias("part")).agg(F.count("*").alias("rows")).orderBy("part").collect()
    low, high, before = None, None, 0
    for part, rows in sizes:  # as many as the sort had tasks
        if low is None and begin < before + rows:
            low = (part << _PART_BITS) + begin - before
        if before < end:
            high = (part << _PART_BITS) + min(end - before, rows)
        before += rows
    found = F.lit(False) if low is None else (F.col("_number") >= low) & (F.col("_number") < high)
    return numbered.where(found).orderBy("_number").drop("_number")


def exposure_profile(corridors: DataFrame, limit: int = 50) -> DataFrame:
    """The most hazardous inbound corridors of every destination, with the full count.

    The count comes from an aggregation; the ranking keeps at most ``limit``
    rows per task before it shuffles.
    """
    counts = corridors.groupBy("destination_m49").agg(F.count("*").alias("corridor_count"))
    inbound = Window.partitionBy("destination_m49").orderBy(*by_metric(F.col("his")))
    top = corridors.withColumn("position", F.row_number().over(inbound)).where(F.col("position") <= limit)
    return top.join(counts, "destination_m49")


def code_forms(hs_code: str) -> list[str]:
    """A commodity code as it is written and as a number, which has no leading zero."""
    code = hs_code.strip()
    number = code.lstrip("0") if code.isdecimal() else code
    return sorted({code, number, *([f"0{code}"] if code.isdecimal() and len(code) in (3, 5) else [])} - {""})


def commodity_corridors(corridors: DataFrame, names: DataFrame, hs_code: str) -> DataFrame:
    """Corridors of one commodity by hazard, with the names the code stands for.

    Corridors carry codes as numbers do, without leading zero, and the
    commodity map has all six digits. ``090421`` and ``90421`` are one code;
    the result has it in full as ``hs_code``.
    """
    forms = code_forms(hs_code)
    full = six_digit_hs(F.lit(hs_code))
    mine = names.where(F.col("hs_code").isin(forms)).select(six_digit_hs(F.col("hs_code")).alias("hs_code"), "names")
    rows = corridors.where(F.col("commodity_hs").isin(forms)).withColumn("hs_code", full)
    return rows.join(mine, "hs_code", "left").orderBy(*by_metric(F.col("his")))


def country_detail(corridors: DataFrame, book: CountryBook) -> DataFrame:
    """Corridor counts of each country as destination and as origin, in one pass."""
    ends = F.array(
        F.struct(F.col("destination_m49").alias("m49"), F.lit(1).alias("d"), F.lit(0).alias("o")),
        F.struct(F.col("origin_m49").alias("m49"), F.lit(0).alias("d"), F.lit(1).alias("o")),
    )
    sums = corridors.select(F.inline(ends)).groupBy("m49").agg(
        F.sum("d").alias("corridors_as_destination"), F.sum("o").alias("corridors_as_origin")
    )
    return sums.withColumns(
        {"name": book.name_of(F.col("m49")), "is_eu27": book.is_eu(F.col("m49"))}
    )


def inbound_his_total(corridors: DataFrame) -> DataFrame:
    return corridors.groupBy("destination_m49").agg(F.sum("his").alias("inbound_his"))


def list_countries(countries: DataFrame, eu_only: bool = False) -> DataFrame:
    """One row per code under its alphabetically first name; code 0 is no country."""
    named = countries.where(F.col("m49") != 0).groupBy("m49").agg(
        F.min("name").alias("name"), F.bool_or("is_eu27").alias("is_eu27")
    )
    return (named.where("is_eu27") if eu_only else named).orderBy("name")


def corridor_view_stats(corridors: DataFrame) -> DataFrame:
    """One row about a set of corridors. Equal frequencies go to the smallest name.

    The three most frequent values come from one aggregation over their
    combinations, which the dimensions bound.
    """
    cvs = _score(corridors)
    combos = corridors.groupBy("destination_country", "origin_country", "commodity_hs").agg(
        F.count("*").alias("n"),
        F.sum("notification_count").alias("alerts"),
        F.sum("his").alias("his"),
        F.max("his").alias("max_his"),
        F.count(cvs).alias("scored"),
    )
    labels = F.array(
        *[
            F.struct(F.lit(kind).alias("kind"), F.col(column).alias("label"))
            for kind, column in (
                ("destination", "destination_country"),
                ("origin", "origin_country"),
                ("commodity", "commodity_hs"),
            )
        ]
    )
    # every combination counts once per kind; totals are taken from one kind only
    tallied = combos.select("*", F.inline(labels)).groupBy("kind", "label").agg(
        F.sum("n").alias("n"),
        F.sum("alerts").alias("alerts"),
        F.sum("his").alias("his"),
        F.max("max_his").alias("max_his"),
        F.sum("scored").alias("scored"),
    )

    def top(kind: str) -> Column:
        mine = F.when(F.col("kind") == kind, F.struct(-F.col("n"), F.col("label").alias("label")))
        return F.min(mine)["label"].alias(f"top_{kind}")

    one = F.col("kind") == "commodity"
    return tallied.agg(
        F.sum(F.when(one, F.col("n"))).alias("corridors"),
        F.sum(F.when(one, F.col("alerts"))).alias("sum_alerts"),
        (F.sum(F.when(one, F.col("his"))) / F.sum(F.when(one, F.col("n")))).alias("mean_his"),
        F.max("max_his").alias("max_his"),
        F.sum(F.when(one, F.col("scored"))).alias("with_cvs"),
        top("destination"),
        top("origin"),
        top("commodity"),
    )


def dashboard_kpis(corridors: DataFrame) -> DataFrame:
    """Flagged corridors and the highest score; hazard stands in while no score exists."""
    cvs = _score(corridors)
    sums = corridors.agg(
        F.count("*").alias("corridors"),
        F.count(cvs).alias("_scored"),
        F.count_if(stable(zero_if_null(cvs)) > 0.3).alias("_flag_cvs"),
        F.max(zero_if_null(cvs)).alias("_max_cvs"),
        F.count_if(stable(F.col("his")) >= 0.5).alias("_flag_his"),
        F.max("his").alias("_max_his"),
    )
    scored = F.col("_scored") > 0
    return sums.select(
        "corridors",
        scored.alias("cvs_available"),
        F.when(scored, F.col("_flag_cvs")).otherwise(F.col("_flag_his")).alias("flagged"),
        F.coalesce(F.when(scored, F.col("_max_cvs")).otherwise(F.col("_max_his")), F.lit(0.0)).alias("max_score"),
    )


def hazard_heatmap(corridors: DataFrame, rows: int = 15, columns: int = 12) -> DataFrame:
    """Largest hazard per origin and chapter, for the origins and chapters with the most.

    Chapters are those of the whole code, with the leading zero that numbers lose.
    """
    cells = corridors.groupBy("origin_country", hs_chapter(six_digit_hs(F.col("commodity_hs"))).alias("chapter")).agg(
        F.max("his").alias("max_his"), F.sum("his").alias("sum_his")
    )

    def leading(name: str, count: int) -> DataFrame:
        sums = cells.groupBy(name).agg(F.sum("sum_his").alias("_sum"))
        return sums.orderBy(stable(F.col("_sum")).desc(), name).limit(count).select(name)

    return (
        cells.join(F.broadcast(leading("origin_country", rows)), "origin_country", "left_semi")
        .join(F.broadcast(leading("chapter", columns)), "chapter", "left_semi")
        .select("origin_country", "chapter", "max_his")
    )


# ------------------------------------------------------------------ commodities


def hs_code_names(commodities: DataFrame) -> DataFrame:
    """The names of each code in source order: as many as the commodity map, a dimension, gives it."""
    named = commodities.where(F.col("hs_code").isNotNull() & F.col("commodity").isNotNull())
    entries = F.sort_array(F.collect_list(F.struct("pos", F.col("commodity").alias("name"))))
    return named.groupBy("hs_code").agg(entries.alias("_entries")).select(
        "hs_code", F.transform("_entries", lambda e: e["name"]).alias("names")
    )


def hs_names_lookup(names: DataFrame, hs_code: str) -> DataFrame:
    return names.where(F.col("hs_code") == hs_code)


def hs_code_summary(commodities: DataFrame) -> DataFrame:
    """Names per code: how many, and the first three in source order.

    Both are bounded before they are shuffled: the count is a partial sum, and
    of the names each task passes on three a code.
    """
    named = commodities.where(F.col("hs_code").isNotNull() & F.col("commodity").isNotNull())
    counts = named.groupBy("hs_code").agg(F.count("*").cast("int").alias("commodity_count"))
    order = Window.partitionBy("hs_code").orderBy("pos", "commodity")
    first = named.withColumn("_place", F.row_number().over(order)).where(F.col("_place") <= 3)
    sample = first.groupBy("hs_code").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("_place", "commodity"))), lambda e: e["commodity"]), ", ").alias("_sample")
    )
    more = F.when(F.col("commodity_count") > 3, F.lit("...")).otherwise(F.lit(""))
    return (
        counts.join(sample, "hs_code")
        .select("hs_code", "commodity_count", F.concat("_sample", more).alias("sample_commodities"))
        .orderBy(F.col("commodity_count").desc(), "hs_code")
    )


def unique_hs_codes(commodities: DataFrame) -> DataFrame:
    return commodities.where(F.col("hs_code").isNotNull()).select("hs_code").distinct().orderBy("hs_code")


def hs_by_chapter(commodities: DataFrame, chapter: str) -> DataFrame:
    return unique_hs_codes(commodities.where(F.startswith("hs_code", F.lit(chapter))))


def readiness_counts(corridors: DataFrame, notifications: DataFrame, trade: DataFrame) -> DataFrame:
    """One row of table sizes and the current period."""
    period = F.max(F.when(F.col("period") > 0, F.col("period"))).alias("current_period")
    sizes = notifications.agg(F.count("*").alias("notifications"), period)
    return sizes.withColumns(
        {
            "corridor_metrics": corridors.agg(F.count("*")).scalar(),
            "trade_rows": trade.agg(F.count("*")).scalar(),
        }
    )
