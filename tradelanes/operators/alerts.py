"""From raw alert notifications to corridor events and notifications.

A notification names its origins and destinations in short country lists. They
are parsed, mapped and paired inside their row, so one pass over the raw table
yields every (origin, destination) event without a join or a shuffle.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tradelanes.dimensions import CountryBook
from tradelanes.functions import text
from tradelanes.functions.guards import once
from tradelanes.functions.periods import DEFAULT_PERIOD, is_unread, to_period_yyyymm
from tradelanes.session import materialise
from tradelanes.sources.scans import with_row_id

CORRIDOR = ["commodity_hs", "destination_m49", "origin_m49"]


def _optional(df: DataFrame, name: str) -> Column:
    return F.col(name) if name in df.columns else F.lit(None).cast("string")


def _codes_of(names: Column, book: CountryBook) -> Column:
    return text.each(names, book.code_of)


def _mapped(names: str, codes: str) -> Column:
    """The names that have a code, with it."""
    named = F.arrays_zip(F.col(names).alias("name"), F.col(codes).alias("m49"))
    return F.filter(named, lambda n: n["m49"].isNotNull())


def _unmapped_of(names: str, codes: str) -> Column:
    """The names without a code; few rows have one, so the others are told by their codes alone."""
    named = F.arrays_zip(F.col(names).alias("name"), F.col(codes).alias("m49"))
    strange = F.transform(F.filter(named, lambda n: n["m49"].isNull()), lambda n: n["name"])
    return F.when(F.exists(codes, lambda c: c.isNull()), strange).otherwise(F.array().cast("array<string>"))


def _codes_as(role: str) -> str:
    return f"_codes_{role}"


def _with_countries(df: DataFrame, book: CountryBook) -> DataFrame:
    """Add ``_origins`` and ``_mentions``, the names of origins and of destinations in column order; and the codes of origins and of each role."""
    lists = {f"_names_{role}": text.split_country_list(_optional(df, column)) for column, role in text.ROLE_COLUMNS}
    codes = {_codes_as(role): _codes_of(F.col(f"_names_{role}"), book) for role in text.ROLES}
    split = df.withColumns({"_origins": text.split_country_list(F.col("origin")), **lists})
    return split.withColumns({"origins_m49": _codes_of(F.col("_origins"), book), "_mentions": F.concat(*lists), **codes}).drop(*lists)


def _with_codes(df: DataFrame) -> DataFrame:
    """Add ``_codes``, those of ``_mentions``, and ``_named``, the distinct ones as first mentioned, without NULL."""
    nothing = F.array(F.lit(None).cast("int"))
    coded = df.withColumn("_codes", F.concat(*[_codes_as(role) for role in text.ROLES]))
    return coded.withColumn("_named", F.array_except("_codes", nothing))


#: The roles of every combination, by the sum of their places as powers of two.
_ROLE_SETS = [[r for i, r in enumerate(sorted(text.ROLES)) if k >> i & 1] for k in range(1 << len(text.ROLES))]


def _name_seen_first(code: Column) -> Column:
    return F.get("_mentions", (F.array_position("_codes", code) - 1).cast("int"))


def _roles_of(code: Column) -> Column:
    """All roles of a destination, looked up in the codes of each."""
    sets = F.array(*[F.array(*[F.lit(r) for r in roles]).cast("array<string>") for roles in _ROLE_SETS])
    has = [F.when(F.array_contains(_codes_as(role), code), 1 << i).otherwise(0) for i, role in enumerate(sorted(text.ROLES))]
    return F.get(sets, sum(has[1:], has[0]))


def _merge_mentions() -> Column:
    """One entry per destination: the name seen first and all its roles."""
    return F.transform(
        "_named", lambda code: F.struct(code.alias("m49"), _name_seen_first(code).alias("name"), _roles_of(code).alias("roles"))
    )


def _date_columns(raw: DataFrame) -> list[str]:
    return [c for c in ("date", "notification_date", "Date") if c in raw.columns]


def _dates(raw: DataFrame) -> list[Column]:
    """What a notification may be dated by, in order of preference."""
    return [F.col(c) for c in _date_columns(raw)] or [F.lit(None).cast("string")]


def read_notifications(raw: DataFrame, book: CountryBook, keep: list[str] | None = None) -> DataFrame:
    """Cleaned notifications, one row each, with the names they mention and their codes, side by side.

    Enough for :func:`events_of` and :func:`notifications_with_credit`, and
    flat: names and roles of destinations are looked up in their events, where
    it takes no lambda. ``keep`` names input columns to carry along.
    """
    rows = with_row_id(raw)
    hazards = _optional(rows, "hazards") if "hazards" in rows.columns else _optional(rows, "hazard_category")
    return _with_countries(rows, book).select(
        *(keep or []),
        "row_id",
        F.coalesce(F.col("reference").cast("string"), F.lit("")).alias("reference"),
        text.normalise_hs(F.col("hs_code")).alias("commodity_hs"),
        F.coalesce(_optional(rows, "commodities"), F.lit("")).alias("commodity_name"),
        F.coalesce("classification", F.lit("")).alias("classification"),
        F.coalesce("risk_decision", F.lit("")).alias("risk_decision"),
        text.extract_hazard_categories(hazards).alias("hazard_category"),
        to_period_yyyymm(*_dates(raw)).alias("period"),
        "_origins",
        "origins_m49",
        "_mentions",
        *[_codes_as(role) for role in text.ROLES],
    )


def parse_notifications(raw: DataFrame, book: CountryBook, keep: list[str] | None = None) -> DataFrame:
    """As :func:`read_notifications`, with lists of mapped origins and destinations."""
    return _with_codes(read_notifications(raw, book, keep)).withColumns(
        {
            "origins": _mapped("_origins", "origins_m49"),
            "unmapped_origins": _unmapped_of("_origins", "origins_m49"),
            "destinations": _merge_mentions(),
            "unmapped_destinations": _unmapped_of("_mentions", "_codes"),
        }
    ).drop("_codes", "_named")


def explode_origins(raw: DataFrame, book: CountryBook) -> DataFrame:
    """One row per mapped origin of a notification."""
    parsed = parse_notifications(raw, book)
    return parsed.select("row_id", "reference", F.posexplode("origins").alias("pos", "origin")).select(
        "row_id",
        "reference",
        "pos",
        F.col("origin.name").alias("origin_country"),
        F.col("origin.m49").alias("origin_m49"),
    )


def collect_destinations(raw: DataFrame, book: CountryBook) -> DataFrame:
    """One row per notification and destination, with the union of its roles."""
    code = F.col("destination_m49")
    # outer, as a filter on the array's size would be pushed below and work out all lists anew
    mentioned = _with_codes(read_notifications(raw, book)).withColumn("destination_m49", F.explode_outer("_named"))
    return mentioned.where(code.isNotNull()).select(
        "row_id",
        "reference",
        _name_seen_first(code).alias("destination_country"),
        "destination_m49",
        _roles_of(code).alias("destination_roles"),
    )


def _pairs() -> Column:
    """Origin by destination inside one row, without trade of a country with itself."""
    pairs = F.flatten(
        F.transform(
            "origins",
            lambda o: F.transform("destinations", lambda d: F.struct(o.alias("o"), d.alias("d"))),
        )
    )
    return F.filter(pairs, lambda p: p["o"]["m49"] != p["d"]["m49"])


_SHARED = [
    "row_id",
    "reference",
    "commodity_hs",
    "commodity_name",
    "classification",
    "risk_decision",
    "hazard_category",
    "period",
]


def active_destination(roles: Column) -> Column:
    return F.arrays_overlap(roles, F.array(*[F.lit(r) for r in text.ACTIVE_ROLES]))


def extract_corridors(raw: DataFrame, book: CountryBook, keep: list[str] | None = None) -> DataFrame:
    """Corridor events: one row per notification, origin and destination.

    ``(row_id, pos)`` is the order of the source.
    """
    return events_of(read_notifications(raw, book, keep), keep)


def events_of(parsed: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """The events of notifications read; ``pos`` rises with origin, then destination, and may have gaps."""
    carried = [*(keep or []), *_SHARED]
    lists = ["_mentions", "_codes", *[_codes_as(role) for role in text.ROLES]]
    # outer, as a filter on the arrays' sizes would work them out twice
    origins = _with_codes(parsed).select(
        *carried, *lists, "_origins", "_named", F.posexplode_outer("origins_m49").alias("_row", "origin_m49")
    )
    pairs = origins.select(
        *carried, *lists, "_origins", "_row", "origin_m49", F.size("_named").alias("_width"),
        F.posexplode_outer("_named").alias("_column", "destination_m49"),
    ).where(F.col("origin_m49") != F.col("destination_m49"))
    roles = _roles_of(F.col("destination_m49"))
    return pairs.select(
        *carried,
        (F.col("_row") * F.col("_width") + F.col("_column")).alias("pos"),
        F.get("_origins", F.col("_row")).alias("origin_country"),
        "origin_m49",
        _name_seen_first(F.col("destination_m49")).alias("destination_country"),
        "destination_m49",
        roles.alias("destination_roles"),
        active_destination(roles).alias("is_active_destination"),
    )


def eventful(parsed: DataFrame) -> DataFrame:
    """Parsed notifications with an event, in the place of its first; attributes of the row need no more of it."""
    lone = F.get("destinations", 0)["m49"]
    apart = (F.size("destinations") > 1) | F.exists("origins", lambda o: o["m49"] != lone)
    some = (F.size("origins") > 0) & (F.size("destinations") > 0)
    return parsed.where(some & apart).withColumn("pos", F.lit(0))


def _first_seen(value: Column | str) -> Column:
    return F.min_by(value, F.struct("row_id", "pos"))


def _place() -> Column:
    """``(row_id, pos)`` as one number; rows without an identifier come first."""
    row = F.coalesce(F.col("row_id"), F.lit(-(2**63))).cast("decimal(20,0)")
    return row * F.lit(2**31).cast("decimal(10,0)") + F.col("pos").cast("decimal(10,0)")


def build_notifications(events: DataFrame) -> DataFrame:
    """One notification per (reference, origin) with every destination it touches.

    Attributes are those of the event seen first. Groups without a commodity
    or a period are dropped. Rows without a reference are notifications of their own.
    """
    attributes = F.struct("commodity_hs", "classification", "risk_decision", "hazard_category", "period")
    nameless = F.when(F.col("reference") == "", F.col("row_id")).alias("_row")
    grouped = events.groupBy("reference", "origin_m49", nameless).agg(
        F.sort_array(F.collect_set("destination_m49")).alias("affected"),
        _first_seen(attributes).alias("first"),
    )
    kept = grouped.where((F.col("first.commodity_hs") != "") & (F.col("first.period") != 0))
    return kept.select(
        "reference",
        F.col("first.commodity_hs").alias("commodity_hs"),
        "origin_m49",
        "affected",
        text.parse_classification(F.col("first.classification")).alias("classification"),
        text.parse_risk_decision(F.col("first.risk_decision")).alias("risk_decision"),
        text.parse_hazard_type(F.col("first.hazard_category")).alias("hazard_type"),
        F.col("first.period").alias("period"),
    )


def _words(book: CountryBook) -> list[list[int]]:
    """The dimension's codes, rising, 64 to a word of a set of countries."""
    return [book.codes[i : i + 64] for i in range(0, len(book.codes), 64)]


def _bit(place: int) -> Column:
    return F.lit([*(1 << i for i in range(63)), -(1 << 63), 0][place]).cast("bigint")


def _word_of(codes: Column, known: list[int]) -> Column:
    """The bits of those of 64 codes that are in an array; no lambda, so that it is compiled."""
    bits = [F.when(F.array_contains(codes, code), _bit(place)).otherwise(_bit(64)) for place, code in enumerate(known)]
    return reduce(lambda a, b: a.bitwiseOR(b), bits)


def _countries_of(word: Column, known: list[int], but: Column) -> Column:
    """The codes whose bits are set, rising, without one."""
    nothing = F.lit(min(known) - 1)
    held = [F.when((word.bitwiseAND(_bit(i)) != 0) & (but != code), code).otherwise(nothing) for i, code in enumerate(known)]
    return F.array_remove(F.array(*held), nothing)


def notifications_with_credit(parsed: DataFrame, book: CountryBook) -> DataFrame:
    """As :func:`build_notifications`, from notifications read, groups it drops included; see :func:`usable`.

    A row keeps its destinations together: they are united as bits of the
    dimension's codes, so events need not be paired and grouped one by one.
    ``first`` tells where the group was seen first, ``credit`` is what the
    categories listed there give to each family, NULL if none is listed.
    """
    words = {f"_word{i}": known for i, known in enumerate(_words(book))}
    families = F.col("_families")
    listed = [(F.size(families) - F.size(F.array_remove(families, kind))) / F.size(families) for kind, _ in text.HAZARD_TYPES]
    category = F.col("hazard_category")
    told = _with_codes(parsed).withColumns({"_category": F.lower(F.trim(category)), "_tokens": text.split_tokens(F.lower(category))})
    rows = told.withColumn("_families", text.each(F.col("_tokens"), text.family_of)).select(
        "row_id",
        "reference",
        "commodity_hs",
        text.parse_classification(F.col("classification")).alias("classification"),
        text.parse_risk_decision(F.col("risk_decision")).alias("risk_decision"),
        text.family_of(F.col("_category")).alias("hazard_type"),
        "period",
        F.when(F.size(families) > 0, F.array(*listed)).alias("credit"),
        F.size("_named").alias("_width"),
        F.get("_named", 0).alias("_lead"),
        *[_word_of(F.col("_named"), known).alias(name) for name, known in words.items()],
        F.posexplode("origins_m49").alias("_at", "origin_m49"),
    ).where(F.col("origin_m49").isNotNull())
    itself = F.col("_lead") == F.col("origin_m49")
    # destinations differ, so only a lone one leaves no event
    seen = rows.where((F.col("_width") > 1) | ((F.col("_width") == 1) & ~itself))
    place = F.struct("row_id", (F.col("_at") * F.col("_width") + itself.cast("int")).alias("pos"))
    attributes = ["commodity_hs", "classification", "risk_decision", "hazard_type", "period", "credit"]
    nameless = F.when(F.col("reference") == "", F.col("row_id")).alias("_row")
    grouped = seen.groupBy("reference", "origin_m49", nameless).agg(
        F.min_by(F.struct(*attributes, place.alias("place")), place).alias("_first"),
        *[F.bit_or(name).alias(name) for name in words],
    )
    return grouped.select(
        "reference",
        "_row",
        F.col("_first.commodity_hs").alias("commodity_hs"),
        "origin_m49",
        F.concat(*[_countries_of(F.col(name), known, F.col("origin_m49")) for name, known in words.items()]).alias("affected"),
        *[F.col(f"_first.{name}").alias(name) for name in attributes[1:]],
        F.col("_first.place").alias("first"),
    )


def usable(groups: DataFrame) -> DataFrame:
    """Those that name a commodity and a period."""
    return groups.where((F.col("commodity_hs") != "") & (F.col("period") != 0))


def build_notifications_followup(raw: DataFrame, book: CountryBook) -> DataFrame:
    """The narrower rule: the origin text is one country, only follow-up countries are affected.

    Takes a numeric ``period`` column as given; repeated countries are kept.
    """
    mapped = raw.withColumn("_affected", _codes_of(text.split_tokens(F.col("for_followUp")), book))
    codes = F.array_compact("_affected")
    rows = mapped.select(
        "row_id",
        F.coalesce(F.col("reference").cast("string"), F.lit("")).alias("reference"),
        text.normalise_hs(F.col("hs_code")).alias("commodity_hs"),
        book.code_of(F.trim("origin")).alias("origin_m49"),
        codes.alias("affected"),
        text.parse_classification(F.col("classification")).alias("classification"),
        text.parse_risk_decision(F.col("risk_decision")).alias("risk_decision"),
        text.parse_hazard_type(_optional(raw, "hazard_category")).alias("hazard_type"),
        F.coalesce(F.col("period"), F.lit(0)).alias("period"),
    )
    return rows.where(
        F.col("origin_m49").isNotNull()
        & (F.size("affected") > 0)
        & (F.col("commodity_hs") != "")
        & (F.col("period") != 0)
    )


def hazard_category_map(events: DataFrame) -> DataFrame:
    """The category text seen first for each reference; blank references have none."""
    named = events.where(F.col("reference") != "")
    return named.groupBy("reference").agg(_first_seen("hazard_category").alias("hazard_category"))


def latest_period(notifications: DataFrame) -> DataFrame:
    """One row: the latest known period."""
    latest = F.max(F.when(F.col("period") > 0, F.col("period")))
    return notifications.agg(F.coalesce(latest, F.lit(DEFAULT_PERIOD)).alias("current_period"))


def corridor_base(events: DataFrame) -> DataFrame:
    """Unique corridors with the names seen first and the counts of each role.

    Events are reduced to the names a corridor goes by before one is chosen:
    numbers are summed up in hash tables, texts would have to be sorted.
    """
    names = ["commodity_name", "origin_country", "destination_country"]
    roles = [f"role_{role}" for role in text.ROLES]
    counts = [F.sum(F.array_contains("destination_roles", r).cast("int")).alias(f"role_{r}") for r in text.ROLES]
    # the rows of files have no number but a place
    place = F.struct("row_id", "pos") if dict(events.dtypes)["row_id"].startswith("struct") else _place()
    spelled = events.where(F.col("commodity_hs") != "").groupBy(*CORRIDOR, *names).agg(
        F.min(place).alias("_place"), F.count("*").alias("event_count"), *counts
    )
    grouped = spelled.groupBy(CORRIDOR).agg(
        F.min_by(F.struct(*names), "_place").alias("first"), *[F.sum(c).alias(c) for c in ("event_count", *roles)]
    )
    present = F.filter(
        F.array(*[F.when(F.col(f"role_{r}") > 0, F.lit(r)) for r in sorted(text.ROLES)]),
        lambda role: role.isNotNull(),
    )
    return grouped.select(
        *CORRIDOR,
        "first.*",
        "event_count",
        present.alias("destination_roles"),
        *[f"role_{r}" for r in text.ROLES],
        active_destination(present).alias("is_active_destination"),
    )


def unique_corridors(events: DataFrame) -> DataFrame:
    return corridor_base(events).select(
        *CORRIDOR, "commodity_name", "origin_country", "destination_country"
    )


def role_counts(events: DataFrame) -> DataFrame:
    return corridor_base(events).select(
        *CORRIDOR,
        "destination_roles",
        *[f"role_{r}" for r in text.ROLES],
        "is_active_destination",
    )


def _unmapped() -> Column:
    """(kind, name) of the names a notification mentions that have no code."""

    def of(kind: str, names: str) -> Column:
        return F.transform(names, lambda n: F.struct(F.lit(kind).alias("kind"), n.alias("name")))

    nothing = F.array().cast("array<struct<kind:string,name:string>>")
    destinations = F.when(F.size("origins") > 0, of("destination", "unmapped_destinations"))
    return F.concat(of("origin", "unmapped_origins"), destinations.otherwise(nothing))


def unmapped_countries(raw: DataFrame, book: CountryBook) -> DataFrame:
    """Distinct names without a code: those of origins, and those of destinations.

    Destinations are looked at only where an origin was mapped.
    """
    return parse_notifications(raw, book).select(F.inline(_unmapped())).distinct()


def hazard_summary(raw: DataFrame, book: CountryBook) -> DataFrame:
    """One row of ingestion counters.

    One pass reduces the notifications to the distinct (origin, destination,
    commodity) triples and the distinct unmapped names, with partial sums;
    the counters are taken from those. :func:`unmapped_countries` lists the
    names. ``unread_dates`` counts the notifications with a date that isn't
    understood: their alerts have no month and don't weigh anywhere.
    """
    parsed = parse_notifications(raw, book, _date_columns(raw)).withColumn("_pairs", _pairs())
    has_origin = F.size("origins") > 0
    has_both = has_origin & (F.size("destinations") > 0)

    def item(o: Column, d: Column, roles: Column, kind: Column, name: Column) -> Column:
        return F.struct(
            o.alias("o"), d.alias("d"), roles.alias("roles"), kind.alias("kind"), name.alias("name")
        )

    no_code, no_text = F.lit(None).cast("int"), F.lit(None).cast("string")
    no_roles = F.lit(None).cast("array<string>")
    pairs = F.transform(
        "_pairs", lambda p: item(p["o"]["m49"], p["d"]["m49"], p["d"]["roles"], no_text, no_text)
    )
    strangers = F.transform(
        _unmapped(), lambda u: item(no_code, no_code, no_roles, u["kind"], u["name"])
    )
    rows = parsed.select(
        "commodity_hs",
        has_origin.alias("has_origin"),
        has_both.alias("has_both"),
        is_unread(F.col("period"), *_dates(raw)).alias("unread"),
        (F.size("origins") * F.size("destinations") - F.size("_pairs")).alias("self_pairs"),
        F.posexplode_outer(F.concat(pairs, strangers)).alias("pos", "item"),
    )
    first = F.coalesce(F.col("pos"), F.lit(0)) == 0
    pair, roles = F.col("item.o").isNotNull(), F.col("item.roles")

    def tally(condition: Column) -> Column:
        return F.sum(condition.cast("int"))

    counters = {
        "total_notifications": tally(first),
        "total_corridors": tally(pair),
        "active_corridors": tally(F.coalesce(active_destination(roles), F.lit(False))),
        "notifications_without_origin": tally(first & ~F.col("has_origin")),
        "notifications_without_destination": tally(first & F.col("has_origin") & ~F.col("has_both")),
        "self_trade_pairs_skipped": F.sum(F.when(first, F.col("self_pairs"))),
        "unread_dates": tally(first & F.col("unread")),
    }
    for role in text.ROLES:
        counters[f"role_{role}"] = tally(F.coalesce(F.array_contains(roles, role), F.lit(False)))
    groups = rows.groupBy(
        F.col("item.o").alias("o"),
        F.col("item.d").alias("d"),
        F.when(pair & (F.col("commodity_hs") != ""), F.col("commodity_hs")).alias("commodity_hs"),
        F.col("item.kind").alias("kind"),
        F.col("item.name").alias("name"),
    ).agg(*[value.alias(name) for name, value in counters.items()])
    return groups.agg(
        *[F.coalesce(F.sum(name), F.lit(0)).alias(name) for name in counters],
        F.count_distinct("o").alias("unique_origins"),
        F.count_distinct("d").alias("unique_destinations"),
        F.count_distinct("commodity_hs").alias("unique_commodities"),
        F.count_if(F.col("kind") == "origin").alias("unmapped_origins"),
        F.count_if(F.col("kind") == "destination").alias("unmapped_destinations"),
    )


# ------------------------------------------------------------------ trade pairs


def extract_trade_pairs(raw: DataFrame, book: CountryBook) -> DataFrame:
    """Single origin text by each follow-up country; unmapped codes stay NULL."""
    origin = F.trim("origin")
    named = raw.where(F.length("origin") > 0).select(
        "row_id",
        F.col("reference").cast("string").alias("reference"),
        origin.alias("from_country"),
        book.code_of(origin).alias("from_code"),
        F.when(F.col("hs_code").isNotNull(), text.normalise_hs(F.col("hs_code"))).alias("hs_code"),
        F.col("commodities").alias("commodity"),
        F.posexplode(text.split_tokens(F.col("for_followUp"))).alias("pos", "to_country"),
    )
    return named.withColumn("to_code", book.code_of(F.col("to_country")))


def unique_country_pairs(pairs: DataFrame) -> DataFrame:
    both = F.col("from_code").isNotNull() & F.col("to_code").isNotNull()
    return pairs.where(both).select("from_code", "to_code", "from_country", "to_country").distinct()


def unique_origins(raw: DataFrame, book: CountryBook) -> DataFrame:
    names = raw.where(F.col("origin").isNotNull()).select(F.trim("origin").alias("country")).distinct()
    return names.withColumn("m49", book.code_of(F.col("country"))).where("m49 <> 0")


def unique_followups(raw: DataFrame, book: CountryBook) -> DataFrame:
    names = raw.select(F.explode(text.split_tokens(F.col("for_followUp"))).alias("country")).distinct()
    return names.withColumn("m49", book.code_of(F.col("country"))).where("m49 <> 0")


def pair_hs_codes(pairs: DataFrame, exclude_self: bool = True) -> DataFrame:
    """Commodity codes of each country pair, and how many.

    Codes are reduced to distinct (pair, code) rows first, so the list of a
    pair is no longer than the commodity nomenclature.
    """
    usable = pairs.where(
        F.col("from_code").isNotNull()
        & F.col("to_code").isNotNull()
        & (F.length("hs_code") > 0)
    )
    if exclude_self:
        usable = usable.where(F.col("from_code") != F.col("to_code"))
    distinct = usable.groupBy("from_code", "to_code", "hs_code").agg(
        F.min(F.struct("row_id", "pos", "from_country", "to_country")).alias("first")
    )
    return distinct.groupBy("from_code", "to_code").agg(
        F.min("first").alias("first"),
        F.sort_array(F.collect_set("hs_code")).alias("hs_codes"),
        F.count("*").alias("hs_code_count"),
    ).select(
        F.col("first.from_country").alias("from_country"),
        "from_code",
        F.col("first.to_country").alias("to_country"),
        "to_code",
        "hs_codes",
        "hs_code_count",
    )


def country_pair_summary(raw: DataFrame, book: CountryBook) -> DataFrame:
    """One row: mapped origins and follow-up countries, country pairs, codes over all pairs.

    Only the distinct texts matter, so the notifications are reduced to them once.
    """
    texts = materialise(raw.select("origin", "for_followUp", "hs_code").distinct())
    rows = texts.withColumns(
        {"row_id": F.lit(0), "reference": F.lit(None).cast("string"), "commodities": F.lit(None).cast("string")}
    )
    pairs = pair_hs_codes(extract_trade_pairs(rows, book))
    origins = unique_origins(texts, book).agg(F.count("*")).scalar()
    followups = unique_followups(texts, book).agg(F.count("*")).scalar()
    return pairs.agg(
        F.count("*").alias("country_pairs"),
        F.coalesce(F.sum("hs_code_count"), F.lit(0)).alias("hs_codes_over_pairs"),
    ).withColumns({"from_countries": origins, "to_countries": followups})
