"""The trade report: its tables, and the tables behind its figures.

Every table here is made of sums over route, commodity and period.
:func:`condense` reduces the trade rows to those cells in one pass with
partial sums; a function takes trade rows or cells alike. Functions that use
their input more than once write the cells first, so the trade rows are read
once; :func:`report_tables` shares one set of cells among all tables. Top sets
are limited in number, so they are joined by broadcast. Results are not
rounded; that is presentation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tradelanes.functions import formulas, text
from tradelanes.functions.guards import ratio_nonzero, stable, total
from tradelanes.session import materialise

VALUE, WEIGHT = "primaryValue", "netWgt"
TOP_N = 15
TOP_ROUTES = 10
#: Largest top set that is joined by broadcast.
MAX_TOP = 10_000


CELL = ["reporterDesc", "partnerDesc", "cmdCode", "cmdDesc", "period"]


def condense(trade: DataFrame) -> DataFrame:
    """Cells of the report: value, weight and valued rows by route, commodity and period."""
    return trade.groupBy(CELL).agg(
        F.sum(VALUE).alias(VALUE), F.sum(WEIGHT).alias(WEIGHT), F.count(VALUE).alias("n_valued")
    )


def _cells(trade: DataFrame) -> DataFrame:
    return trade if "n_valued" in trade.columns else materialise(condense(trade))


def _valued(trade: DataFrame) -> Column:
    """Aggregate: rows with a value, of trade rows or of cells."""
    if "n_valued" in trade.columns:
        return F.coalesce(F.sum("n_valued"), F.lit(0))
    return F.count(VALUE)


def _route() -> Column:
    return text.route_label(F.col("reporterDesc"), F.col("partnerDesc"))


def with_route(trade: DataFrame) -> DataFrame:
    return trade.withColumn("route", _route())


def _sums(trade: DataFrame, *keys: str) -> DataFrame:
    """Value, weight and number of valued rows by the keys; rows with a missing key are left out."""
    return trade.dropna(subset=list(keys)).groupBy(*keys).agg(
        total(F.col(VALUE)).alias("value_usd"), total(F.col(WEIGHT)).alias("weight_kg"), _valued(trade).alias("n_transactions")
    )


def _top(df: DataFrame, keys: list[str], n: int, value: str = "value_usd") -> DataFrame:
    """The ``n`` key groups with the largest sum; equal sums in key order."""
    if n > MAX_TOP:
        raise ValueError(f"at most {MAX_TOP} groups")
    sums = df.groupBy(*keys).agg(F.sum(value).alias("_sum"))
    return sums.orderBy(stable(F.col("_sum")).desc(), *keys).limit(n)


def _keep(df: DataFrame, top: DataFrame, keys: list[str]) -> DataFrame:
    return df.join(F.broadcast(top.select(keys)), keys, "left_semi")


def _share_pct(value: str, *group: str) -> Column:
    whole = F.sum(value).over(Window.partitionBy(*group))
    return ratio_nonzero(F.col(value), whole) * 100


def _rank_in(group: list[str], value: str, keys: list[str]) -> Column:
    return F.row_number().over(Window.partitionBy(*group).orderBy(stable(F.col(value)).desc(), *keys))


# ---------------------------------------------------------------- export flows


def exports_by_route_year(trade: DataFrame) -> DataFrame:
    return _sums(trade, "reporterDesc", "partnerDesc", "period")


def top_routes(trade: DataFrame, n: int = TOP_N) -> DataFrame:
    """Routes with the most value, their share of all trade, and the running share."""
    trade = _cells(trade)
    routes = trade.groupBy(_route().alias("route")).agg(
        F.min("reporterDesc").alias("reporterDesc"),
        F.min("partnerDesc").alias("partnerDesc"),
        total(F.col(VALUE)).alias("total_value_usd"),
        total(F.col(WEIGHT)).alias("total_weight_kg"),
        _valued(trade).alias("n_transactions"),
    )
    # the routes number at most the countries squared; their total is one value
    whole = routes.agg(F.sum("total_value_usd")).scalar()
    largest = routes.orderBy(stable(F.col("total_value_usd")).desc(), "route").limit(n)
    running = Window.orderBy(stable(F.col("total_value_usd")).desc(), "route")  # n rows
    shared = largest.withColumn("share_pct", ratio_nonzero(F.col("total_value_usd"), whole) * 100)
    return shared.withColumn("cumulative_share_pct", F.sum("share_pct").over(running))


def _two_periods(sums: DataFrame) -> tuple[Column, Column]:
    last = sums.agg(F.max("period")).scalar()
    return sums.where(F.col("period") < last).agg(F.max("period")).scalar(), last


def _side_by_side(sums: DataFrame, keys: list[str], value: Column, first: Column, second: Column) -> DataFrame:
    """``value`` of two periods next to each other; NULL where a period has no row."""
    return sums.groupBy(*keys).agg(
        F.max(F.when(F.col("period") == first, value)).alias("value_prev"),
        F.max(F.when(F.col("period") == second, value)).alias("value_last"),
    )


def yoy_by_route(trade: DataFrame) -> DataFrame:
    """Value of each route at the last two periods. Empty with fewer than two periods.

    Only sums by route and period, bounded by the country pairs times the
    years, are compared with the periods.
    """
    trade = _cells(trade)
    sums = with_route(trade).dropna(subset=["period"]).groupBy("route", "period").agg(F.sum(VALUE).alias("value"))
    prev, last = _two_periods(sums)
    wide = _side_by_side(sums, ["route"], F.coalesce("value", F.lit(0.0)), prev, last)
    change = F.col("value_last") - F.col("value_prev")
    return (
        wide.where(prev.isNotNull())
        .withColumn("abs_change_usd", change)
        .withColumn("yoy_pct", ratio_nonzero(F.col("abs_change_usd"), F.col("value_prev")) * 100)
    )


def yoy_movers(yoy: DataFrame, n: int = 10, by: str = "abs_change_usd") -> DataFrame:
    """The ``n`` largest gains and the ``n`` largest losses, each route once."""
    known = yoy.where(F.col(by).isNotNull())
    value = stable(F.col(by))
    gains = known.orderBy(value.desc(), "route").limit(n)
    losses = known.orderBy(value.asc(), "route").limit(n)
    return gains.union(losses).dropDuplicates(["route"])


def _listed(column: str, names: list, rest: str | None) -> Column:
    """The column's value if it is listed, else ``rest``, and without ``rest`` an error."""
    value = F.col(column)
    told = F.concat(F.lit(f"{column} without a column of its own: "), F.coalesce(value.cast("string"), F.lit("missing")))
    return F.when(value.isin(names), value).otherwise(F.raise_error(told) if rest is None else F.lit(rest))


def matrix(
    df: DataFrame, row: str, column: str, value: str, columns: list[str] | None = None, rest: str | None = None
) -> DataFrame:
    """Rows by columns with the sum of a value, 0 where there is none.

    Give ``columns`` to fix the columns; otherwise their distinct values are
    looked up first, which Spark limits in number. Nothing is dropped: a value
    outside ``columns``, or a missing one, goes to the column named ``rest``;
    without that it ends the query with an error that names it. So the wide
    table adds up to the long one.
    """
    if columns is None:
        return df.groupBy(row).pivot(column).agg(F.sum(value)).na.fill(0.0)
    if rest in columns:
        raise ValueError(f"{rest} is a column already")
    checked = df.withColumn("_column", _listed(column, columns, rest))
    wide = checked.groupBy(row).pivot("_column", columns + ([] if rest is None else [rest]))
    return wide.agg(F.sum(value)).na.fill(0.0)


def reporter_partner_values(trade: DataFrame) -> DataFrame:
    return _sums(trade, "reporterDesc", "partnerDesc").select("reporterDesc", "partnerDesc", "value_usd")


def reporter_partner_matrix(trade: DataFrame, partners: list[str] | None = None, rest: str | None = None) -> DataFrame:
    return matrix(reporter_partner_values(trade), "reporterDesc", "partnerDesc", "value_usd", partners, rest)


def _top_within(pairs: DataFrame, group: str, member: str, n: int, share: str) -> DataFrame:
    """The ``n`` largest members of each group with their share of the whole group."""
    shared = pairs.withColumn(share, _share_pct("value_usd", group))
    ranked = shared.withColumn("position", _rank_in([group], "value_usd", [member]))
    return ranked.where(F.col("position") <= n).select(group, member, "value_usd", share)


def partners_per_reporter(trade: DataFrame, n: int = 10) -> DataFrame:
    pairs = reporter_partner_values(trade)
    return _top_within(pairs, "reporterDesc", "partnerDesc", n, "share_of_reporter_pct")


def reporters_per_partner(trade: DataFrame, n: int = 10) -> DataFrame:
    pairs = reporter_partner_values(trade)
    return _top_within(pairs, "partnerDesc", "reporterDesc", n, "share_of_partner_pct")


def _top_of_top(pairs: DataFrame, group: str, member: str, groups: int, members: int) -> DataFrame:
    """Largest members of the largest groups; the share is of the members shown."""
    kept = _keep(pairs, _top(pairs, [group], groups), [group])
    shown = kept.withColumn("position", _rank_in([group], "value_usd", [member])).where(
        F.col("position") <= members
    )
    return shown.withColumn("share_of_shown_pct", _share_pct("value_usd", group)).drop("position")


def top_partners_of_top_reporters(trade: DataFrame, reporters: int = 5, partners: int = 8) -> DataFrame:
    return _top_of_top(reporter_partner_values(_cells(trade)), "reporterDesc", "partnerDesc", reporters, partners)


def top_reporters_of_top_partners(trade: DataFrame, partners: int = 5, reporters: int = 8) -> DataFrame:
    return _top_of_top(reporter_partner_values(_cells(trade)), "partnerDesc", "reporterDesc", partners, reporters)


def top_heatmap(trade: DataFrame, reporters: int = 12, partners: int = 12) -> DataFrame:
    """Values in millions of the largest reporters by the largest partners, as rows.

    Pairs without trade have no row; :func:`matrix` lays them out wide.
    """
    pairs = reporter_partner_values(_cells(trade))
    kept = _keep(pairs, _top(pairs, ["reporterDesc"], reporters), ["reporterDesc"])
    kept = _keep(kept, _top(pairs, ["partnerDesc"], partners), ["partnerDesc"])
    return kept.select("reporterDesc", "partnerDesc", (F.col("value_usd") / 1e6).alias("value_musd"))


# ----------------------------------------------------------------- commodities


def semi_top_routes(trade: DataFrame, n: int = TOP_ROUTES) -> DataFrame:
    """Trade rows of the ``n`` routes with the most value."""
    routed = with_route(trade)
    return _keep(routed, _top(routed, ["route"], n, "primaryValue"), ["route"])


def _route_commodities(trade: DataFrame) -> DataFrame:
    return _sums(with_route(trade), "route", "cmdDesc")


def route_commodity_breakdown(trade: DataFrame, n: int = TOP_ROUTES) -> DataFrame:
    trade = _cells(trade)
    sums = _sums(with_route(trade), "route", "reporterDesc", "partnerDesc", "cmdCode", "cmdDesc")
    kept = _keep(sums, _top(sums, ["route"], n), ["route"])
    return kept.withColumn("share_of_route_pct", _share_pct("value_usd", "route"))


def top_commodities_per_route(trade: DataFrame, routes: int = TOP_ROUTES, commodities: int = 10) -> DataFrame:
    trade = _cells(trade)
    sums = _route_commodities(trade)
    kept = _keep(sums, _top(sums, ["route"], routes), ["route"])
    ranked = kept.withColumn("position", _rank_in(["route"], "value_usd", ["cmdDesc"]))
    return ranked.where(F.col("position") <= commodities).select(
        "route",
        "cmdDesc",
        "value_usd",
        "weight_kg",
        ratio_nonzero(F.col("value_usd"), F.col("weight_kg")).alias("unit_value_usd_per_kg"),
    )


def top_route_commodities(trade: DataFrame, n: int = 10) -> DataFrame:
    """The largest commodities of the single largest route."""
    return top_commodities_per_route(trade, 1, n)


def commodity_summary_by_route(
    trade: DataFrame, routes: int = TOP_ROUTES, commodities: int = 15, columns: list[str] | None = None, rest: str | None = None
) -> DataFrame:
    trade = _cells(trade)
    sums = _route_commodities(trade)
    kept = _keep(sums, _top(sums, ["route"], routes), ["route"])
    kept = _keep(kept, _top(kept, ["cmdDesc"], commodities), ["cmdDesc"])
    return matrix(kept, "route", "cmdDesc", "value_usd", columns, rest)


def route_commodity_mix(
    trade: DataFrame, routes: int = 8, commodities: int = 8, columns: list[str] | None = None, rest: str | None = None
) -> DataFrame:
    """As the summary, over the commodities each route lists among its own largest ten."""
    trade = _cells(trade)
    sums = top_commodities_per_route(trade)
    kept = _keep(sums, _top(sums, ["route"], routes), ["route"])
    kept = _keep(kept, _top(kept, ["cmdDesc"], commodities), ["cmdDesc"])
    return matrix(kept, "route", "cmdDesc", "value_usd", columns, rest)


def top_commodities_overall(trade: DataFrame, n: int = TOP_N) -> DataFrame:
    """Largest commodities; distinct reporters are counted on sums by reporter."""
    trade = _cells(trade)
    by_reporter = trade.dropna(subset=["cmdCode", "cmdDesc"]).groupBy("cmdCode", "cmdDesc", "reporterDesc").agg(
        total(F.col(VALUE)).alias("value_usd"), total(F.col(WEIGHT)).alias("weight_kg"), _valued(trade).alias("n_transactions")
    )
    sums = by_reporter.groupBy("cmdCode", "cmdDesc").agg(
        F.sum("value_usd").alias("total_value_usd"),
        F.sum("weight_kg").alias("total_weight_kg"),
        F.count("reporterDesc").alias("n_routes"),
        F.sum("n_transactions").alias("n_transactions"),
    )
    whole = trade.agg(F.sum(VALUE)).scalar()
    top = sums.orderBy(stable(F.col("total_value_usd")).desc(), "cmdCode", "cmdDesc").limit(n)
    return top.withColumns(
        {
            "share_pct": ratio_nonzero(F.col("total_value_usd"), whole) * 100,
            "unit_value_usd_per_kg": ratio_nonzero(F.col("total_value_usd"), F.col("total_weight_kg")),
        }
    )


# ------------------------------------------------- unit values, concentrations


def _unit_values(trade: DataFrame, key: str) -> DataFrame:
    sums = _sums(trade, key, "period").drop("n_transactions")
    uv = ratio_nonzero(F.col("value_usd"), F.col("weight_kg"))
    return sums.withColumn("unit_value_usd_per_kg", uv)


def unit_values_by_commodity_year(trade: DataFrame) -> DataFrame:
    return _unit_values(trade, "cmdDesc")


def unit_values_by_route_year(trade: DataFrame) -> DataFrame:
    return _unit_values(with_route(trade), "route")


def unit_value_matrix(trade: DataFrame, periods: list[int] | None = None) -> DataFrame:
    """Commodities by year; commodities without any weight are left out.

    A unit value outside ``periods`` is an error, as unit values do not add up.
    """
    uv = unit_values_by_commodity_year(trade).where(F.col("unit_value_usd_per_kg").isNotNull())
    weighed = Window.partitionBy("cmdDesc")
    kept = uv.withColumn("_weight", F.sum("weight_kg").over(weighed)).where(F.col("_weight") > 0)
    if periods is not None:
        kept = kept.withColumn("period", _listed("period", periods, None))
    return kept.groupBy("cmdDesc").pivot("period", periods).agg(F.first("unit_value_usd_per_kg"))


def unit_value_slope(trade: DataFrame) -> DataFrame:
    """Unit value at the first and last period; commodities missing either, or any between, are left out."""
    trade = _cells(trade)
    uv = unit_values_by_commodity_year(trade).where(F.col("unit_value_usd_per_kg").isNotNull())
    first = uv.agg(F.min("period")).scalar()
    last = uv.agg(F.max("period")).scalar()
    years = uv.agg(F.count_distinct("period")).scalar()
    wide = uv.groupBy("cmdDesc").agg(
        F.max(F.when(F.col("period") == first, F.col("unit_value_usd_per_kg"))).alias("uv_first"),
        F.max(F.when(F.col("period") == last, F.col("unit_value_usd_per_kg"))).alias("uv_last"),
        F.count("*").alias("_years"),
    )
    change = ratio_nonzero(F.col("uv_last") - F.col("uv_first"), F.col("uv_first")) * 100
    return wide.where((F.col("_years") == years) & (first < last)).select(
        "cmdDesc", "uv_first", "uv_last", F.coalesce(change, F.lit(0.0)).alias("change_pct")
    )


def hhi_percent(values: Column) -> Column:
    """Aggregate: sum of squared percentage shares, 0 to 10,000."""
    whole = F.sum(values)
    return ratio_nonzero(F.sum(values * values), whole * whole) * 10_000


def _concentration(sums: DataFrame, keys: list[str], member: str, count: str, hhi: str) -> DataFrame:
    """Concentration of each group over its members, in one aggregation without a window."""
    value = F.col("value_usd")
    grouped = sums.groupBy(*keys).agg(
        F.sum(value).alias("total_export_usd"),
        F.count("*").alias(count),
        hhi_percent(value).alias(hhi),
        F.max(value).alias("_largest"),
        F.min(F.struct((-stable(value)).alias("v"), F.col(member).alias("member")))["member"].alias("top"),
    )
    known = grouped.where(F.col("total_export_usd") != 0)
    return known.withColumns(
        {
            "concentration": formulas.concentration_band(stable(F.col(hhi))),
            "top_share_pct": F.col("_largest") / F.col("total_export_usd") * 100,
        }
    ).drop("_largest")


def market_concentration(trade: DataFrame) -> DataFrame:
    sums = _sums(trade, "reporterDesc", "partnerDesc")
    table = _concentration(sums, ["reporterDesc"], "partnerDesc", "n_partners", "hhi")
    return table.withColumnsRenamed({"top": "top_partner", "top_share_pct": "top_partner_share_pct"})


def market_concentration_by_year(trade: DataFrame) -> DataFrame:
    sums = _sums(trade, "reporterDesc", "partnerDesc", "period")
    table = _concentration(sums, ["reporterDesc", "period"], "partnerDesc", "n_partners", "hhi")
    return table.drop("top", "top_share_pct")


def commodity_concentration(trade: DataFrame) -> DataFrame:
    sums = _sums(trade, "reporterDesc", "cmdDesc")
    table = _concentration(sums, ["reporterDesc"], "cmdDesc", "n_commodities", "commodity_hhi")
    return table.withColumnsRenamed({"top": "top_commodity", "top_share_pct": "top_commodity_share_pct"})


def hhi_year_shift(trade: DataFrame) -> DataFrame:
    """Concentration at the first two periods side by side; empty with fewer than two."""
    trade = _cells(trade)
    by_year = market_concentration_by_year(trade)
    first = by_year.agg(F.min("period")).scalar()
    second = by_year.where(F.col("period") > first).agg(F.min("period")).scalar()
    wide = by_year.groupBy("reporterDesc").agg(
        F.max(F.when(F.col("period") == first, F.col("hhi"))).alias("hhi_first"),
        F.max(F.when(F.col("period") == second, F.col("hhi"))).alias("hhi_second"),
    )
    return wide.where(second.isNotNull()).withColumn("delta", F.col("hhi_second") - F.col("hhi_first"))


def dual_concentration(trade: DataFrame) -> DataFrame:
    """Destination and commodity concentration of each reporter, with their quadrant."""
    trade = _cells(trade)
    destinations = market_concentration(trade).select("reporterDesc", "hhi", "total_export_usd")
    products = commodity_concentration(trade).select("reporterDesc", "commodity_hhi")
    joined = destinations.join(products, "reporterDesc")
    narrow_products, narrow_markets = stable(F.col("commodity_hhi")) > 2500, stable(F.col("hhi")) > 2500
    quadrant = (
        F.when(narrow_products & narrow_markets, "both concentrated")
        .when(narrow_products, "product concentrated")
        .when(narrow_markets, "destination concentrated")
        .otherwise("diversified")
    )
    return joined.withColumn("quadrant", quadrant)


def market_share_by_commodity(trade: DataFrame) -> DataFrame:
    sums = _sums(trade, "cmdDesc", "reporterDesc").select("cmdDesc", "reporterDesc", "value_usd")
    return sums.withColumn("market_share_pct", _share_pct("value_usd", "cmdDesc"))


def market_share_matrix(trade: DataFrame, reporters: list[str] | None = None, rest: str | None = None) -> DataFrame:
    """Commodities by reporters in millions."""
    shares = market_share_by_commodity(trade).withColumn("musd", F.col("value_usd") / 1e6)
    return matrix(shares, "cmdDesc", "reporterDesc", "musd", reporters, rest)


# ----------------------------------------------------------------- other folds


def route_commodity_other(trade: DataFrame, routes: int = 5, least_pct: float = 2.0) -> DataFrame:
    """Commodities of the largest routes; those under ``least_pct`` are folded into one."""
    trade = _cells(trade)
    sums = _route_commodities(trade)
    kept = _keep(sums, _top(sums, ["route"], routes), ["route"])
    shared = kept.withColumn("share", _share_pct("value_usd", "route"))
    label = F.when(stable(F.col("share")) >= least_pct, F.col("cmdDesc")).otherwise(F.lit("Other"))
    folded = shared.groupBy("route", label.alias("label")).agg(F.sum("value_usd").alias("value_usd"))
    return folded.where((F.col("label") != "Other") | (F.col("value_usd") > 0))


def reporter_commodity_other(trade: DataFrame, reporters: int = 10, commodities: int = 8) -> DataFrame:
    """Largest reporters by commodity; commodities outside the largest are folded into one."""
    trade = _cells(trade)
    sums = _sums(trade, "reporterDesc", "cmdDesc")
    kept = _keep(sums, _top(sums, ["reporterDesc"], reporters), ["reporterDesc"])
    top = _top(kept, ["cmdDesc"], commodities).select("cmdDesc", F.col("cmdDesc").alias("label"))
    labelled = kept.join(F.broadcast(top), "cmdDesc", "left")
    label = F.coalesce("label", F.lit("Other"))
    return labelled.groupBy("reporterDesc", label.alias("label")).agg(F.sum("value_usd").alias("value_usd"))


def trade_totals(trade: DataFrame) -> DataFrame:
    """One row; distinct counts are taken on sums by key, not on the trade rows."""
    keyed = trade.groupBy("reporterDesc", "partnerDesc", "cmdDesc", "period").agg(F.sum(VALUE).alias("value"))
    return keyed.agg(
        total(F.col("value")).alias("total_value_usd"),
        F.count_distinct("period").alias("periods"),
        F.count_distinct("reporterDesc").alias("reporters"),
        F.count_distinct("partnerDesc").alias("partners"),
        F.count_distinct("cmdDesc").alias("commodities"),
    )


REPORT = {
    "exports_by_route_year": exports_by_route_year,
    "top_routes": top_routes,
    "yoy_by_route": yoy_by_route,
    "reporter_partner_matrix": reporter_partner_matrix,
    "partners_per_reporter": partners_per_reporter,
    "reporters_per_partner": reporters_per_partner,
    "route_commodity_breakdown": route_commodity_breakdown,
    "top_commodities_per_route": top_commodities_per_route,
    "commodity_summary_by_route": commodity_summary_by_route,
    "top_commodities_overall": top_commodities_overall,
    "unit_values_by_commodity_year": unit_values_by_commodity_year,
    "unit_values_by_route_year": unit_values_by_route_year,
    "market_concentration": market_concentration,
    "market_concentration_by_year": market_concentration_by_year,
    "commodity_concentration": commodity_concentration,
    "market_share_by_commodity": market_share_by_commodity,
}


def report_tables(trade: DataFrame) -> dict[str, DataFrame]:
    """The sixteen report tables over one trade table, which is read once."""
    cells = _cells(trade)
    return {name: build(cells) for name, build in REPORT.items()}
