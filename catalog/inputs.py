"""Scans, sinks, resumable loading, and column cleaning."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catalog.base import query
from tradelanes.functions import formulas, guards, periods, text
from tradelanes.operators import alerts, flows, reports
from tradelanes.plans.shared_tables import SharedTables
from tradelanes.session import materialise, scratch_folder
from tradelanes.sources import resume, scans, sinks


def _tally(trade: DataFrame) -> DataFrame:
    return trade.groupBy("flowCode", "reporterCode", "partnerCode").agg(
        F.count("*").alias("rows"),
        F.count("netWgt").alias("weighed"),
        F.sum("netWgt").alias("weight_kg"),
        F.sum("primaryValue").alias("value_usd"),
    )


_TALLY = """
SELECT "flowCode", "reporterCode", "partnerCode", count(*) AS rows, count("netWgt") AS weighed,
       sum("netWgt") AS weight_kg, sum("primaryValue") AS value_usd FROM {source} GROUP BY 1, 2, 3"""
_DOUBLES = "weight_kg value_usd"


@query("scan_trade", _TALLY.format(source="trade"), _DOUBLES)
def scan_trade(t: SharedTables) -> DataFrame:
    path = sinks.write_csv(t.trade, scratch_folder(t.spark, "trade"))
    return _tally(scans.scan_trade(t.spark, path))


@query(
    "scan_trade_coerced",
    _TALLY.format(
        source="""(SELECT * REPLACE (CASE WHEN "reporterCode" % 7 <> 0 THEN "netWgt" END AS "netWgt") FROM trade) AS q"""
    ),
    _DOUBLES,
)
def scan_trade_coerced(t: SharedTables) -> DataFrame:
    spoilt = F.when(F.col("reporterCode") % 7 == 0, F.lit("n/a")).otherwise(F.col("netWgt").cast("string"))
    path = sinks.write_csv(t.trade.withColumn("netWgt", spoilt), scratch_folder(t.spark, "trade"))
    return _tally(scans.scan_trade_coerced(t.spark, path))


@query("merge_trade_files", _TALLY.format(source="(SELECT DISTINCT * FROM trade) AS q"), _DOUBLES)
def merge_trade_files(t: SharedTables) -> DataFrame:
    """Imports and exports in files of different layouts, the imports twice."""
    folder = scratch_folder(t.spark, "files")
    trade = materialise(t.trade)
    imports, exports = flows.filter_flow(trade, "M"), flows.filter_flow(trade, "X")
    sinks.write_csv(imports, folder, compression="gzip")
    sinks.write_csv(imports, folder, mode="append", compression="gzip")
    tagged = exports.withColumn("source_from_country", F.col("reporterDesc"))
    sinks.write_csv(tagged, folder, mode="append", compression="gzip")
    return _tally(scans.merge_trade_files(t.spark, folder))


def _by_reporter(t: SharedTables) -> str:
    """Trade in a file for each reporter, each in a folder of its own."""
    path = scratch_folder(t.spark, "trade")
    rows = t.trade.withColumn("reporter", F.col("reporterCode")).repartition("reporter")
    rows.write.option("header", True).option("escape", '"').partitionBy("reporter").csv(path)
    return path


@query("list_input_files", """SELECT "reporterCode" AS reporter, 1 AS files FROM trade GROUP BY 1""")
def list_input_files(t: SharedTables) -> DataFrame:
    """Files by reporter; their names and sizes are the writer's choice."""
    files = scans.list_input_files(t.spark, _by_reporter(t))
    reporter = F.regexp_extract("path", "/reporter=([0-9]+)/", 1).cast("int").alias("reporter")
    return files.groupBy(reporter).agg(F.count("*").alias("files"))


@query("trade_file_report", """SELECT "reporterCode" AS reporter, 'merged' AS status, 13 AS names FROM trade GROUP BY 1""")
def trade_file_report(t: SharedTables) -> DataFrame:
    report = scans.trade_file_report(t.spark, _by_reporter(t))
    reporter = F.regexp_extract("path", "/reporter=([0-9]+)/", 1).cast("int").alias("reporter")
    return report.select(reporter, "status", F.size(F.split("header", ",")).alias("names"))


_RAW = scans.schemas.NOTIFICATIONS_RAW.fieldNames()


_WHOLE_RAW = ", ".join(f'{c} AS "{c}"' for c in _RAW)


@query("scan_notifications", f"SELECT {_WHOLE_RAW} FROM raw")
def scan_notifications(t: SharedTables) -> DataFrame:
    """Every row and text, written and read back."""
    path = sinks.write_csv(t.raw.select(_RAW), scratch_folder(t.spark, "alerts"))
    return scans.scan_notifications(t.spark, path).select(_RAW)


@query("scan_commodities", "SELECT commodity, hs_code FROM commodities")
def scan_commodities(t: SharedTables) -> DataFrame:
    """Codes are written as numbers, which drops a leading zero, and read back with it."""
    number = F.col("hs_code").cast("int").alias("hs_code_comtrade")
    rows = t.commodities.select("commodity", number, F.lit(None).cast("string").alias("faostat_cpc"))
    path = sinks.write_csv(rows, scratch_folder(t.spark, "commodities"))
    return scans.scan_commodities(t.spark, path).select("commodity", "hs_code")


@query(
    "scan_production",
    "SELECT commodity_hs, country_m49, period, production_kg, domestic_supply_kg, population FROM production",
    "production_kg domestic_supply_kg population",
)
def scan_production(t: SharedTables) -> DataFrame:
    path = sinks.write_csv(t.production, scratch_folder(t.spark, "production"))
    return scans.scan_production(t.spark, path)


@query(
    "scan_food_balance",
    "SELECT commodity_hs, country_m49, period, domestic_supply_food_kg, population FROM balance",
    "domestic_supply_food_kg population",
)
def scan_food_balance(t: SharedTables) -> DataFrame:
    path = sinks.write_csv(t.balance, scratch_folder(t.spark, "balance"))
    return scans.scan_food_balance(t.spark, path)


@query(
    "json_payload_to_rows",
    _TALLY.format(source="""(SELECT * FROM trade WHERE "netWgt" IS NOT NULL) AS q"""),
    _DOUBLES,
)
def json_payload_to_rows(t: SharedTables) -> DataFrame:
    """One document per row; rows without weight become documents with an empty list."""
    row = F.struct(*[F.col(c) for c in t.trade.columns])
    data = F.filter(F.array(row), lambda r: r["netWgt"].isNotNull())
    documents = t.trade.select(data.alias("data"))
    path = sinks.write_json(documents, scratch_folder(t.spark, "payload"), compression="gzip")
    return _tally(scans.json_payload_to_rows(t.spark, path))


@query(
    "write_tables",
    """SELECT 'by_year' AS name, count(*) AS rows FROM (SELECT DISTINCT "reporterDesc", "partnerDesc", period FROM exports)""",
)
def write_tables(t: SharedTables) -> DataFrame:
    folder = scratch_folder(t.spark, "tables")
    tables = {"by_year": reports.exports_by_route_year(t.exports), "none": t.exports.where("period < 0")}
    written = sinks.write_tables(tables, folder)
    counts = [
        t.spark.read.parquet(f"{folder}/{name}").agg(F.count("*").alias("rows")).select(F.lit(name).alias("name"), "rows")
        for name in written
    ]
    return scans.union_frames(counts)


@query("write_csv", _TALLY.format(source="exports"), _DOUBLES)
def write_csv(t: SharedTables) -> DataFrame:
    return _tally(scans.scan_trade(t.spark, sinks.write_csv(t.exports, scratch_folder(t.spark, "csv"))))


@query("write_json", _TALLY.format(source="exports"), _DOUBLES)
def write_json(t: SharedTables) -> DataFrame:
    path = sinks.write_json(t.exports, scratch_folder(t.spark, "json"))
    return _tally(t.spark.read.schema(scans.schemas.TRADE).json(path))


_EXPORT = """
SELECT origin_country, destination_country, commodity_hs, commodity_name, his, hdi, notification_count,
       severity_total, cvs, array_to_string(roles, ';') AS destination_roles FROM scored"""


@query("export_corridors", _EXPORT, "his hdi severity_total cvs")
def export_corridors(t: SharedTables) -> DataFrame:
    path = sinks.export_corridors(t.scored, scratch_folder(t.spark, "export"))
    kinds = sinks.corridor_export(t.scored).schema
    back = t.spark.read.schema(kinds).option("header", True).option("escape", '"').csv(path)
    return back.withColumn("commodity_name", F.coalesce("commodity_name", F.lit("")))


def _pairs(t: SharedTables) -> DataFrame:
    return materialise(alerts.pair_hs_codes(alerts.extract_trade_pairs(t.raw, t.book)))


def _progress(pairs: DataFrame) -> DataFrame:
    rest = (F.col("from_code") + F.col("to_code")) % 3
    status = F.when(rest == 0, "completed").otherwise("failed")
    records = F.when(rest == 0, F.col("hs_code_count")).otherwise(0).cast("int")
    return pairs.where(rest < 2).select("from_code", "to_code", status.alias("status"), records.alias("records"))


@query(
    "pending_pairs",
    """SELECT from_code, to_code, array_to_string(codes, ';') AS hs_codes FROM pair_codes
       WHERE (from_code + to_code) % 3 <> 0""",
)
def pending_pairs(t: SharedTables) -> DataFrame:
    pairs = _pairs(t)
    pending = resume.pending_pairs(pairs, _progress(pairs))
    return pending.select("from_code", "to_code", "hs_codes")


@query(
    "record_progress",
    """SELECT c.from_code, c.to_code, CASE WHEN coalesce(n, 0) > 0 THEN 'completed' ELSE 'failed' END AS status,
       CAST(coalesce(n, 0) AS INTEGER) AS records
       FROM pair_codes c LEFT JOIN (SELECT "reporterCode" AS f, "partnerCode" AS o, count(*) AS n FROM trade
       WHERE "flowCode" = 'X' GROUP BY 1, 2) ON f = c.from_code AND o = c.to_code""",
)
def record_progress(t: SharedTables) -> DataFrame:
    pairs = _pairs(t)
    return resume.record_progress(pairs, flows.filter_flow(t.trade, "X"))


@query(
    "checkpoint_status",
    """SELECT count(*) AS total_pairs, count(*) FILTER (WHERE (from_code + to_code) % 3 = 0) AS completed_pairs,
       count(*) FILTER (WHERE (from_code + to_code) % 3 = 1) AS failed_pairs,
       CAST(coalesce(sum(hs_code_count) FILTER (WHERE (from_code + to_code) % 3 = 0), 0) AS BIGINT) AS total_records
       FROM pair_codes""",
)
def checkpoint_status(t: SharedTables) -> DataFrame:
    pairs = _pairs(t)
    return resume.checkpoint_status(pairs, _progress(pairs))


@query(
    "tag_source_pair",
    """SELECT c.from_country AS source_from_country, c.to_country AS source_to_country, count(*) AS rows
       FROM exports e JOIN pair_codes c ON e."reporterCode" = c.from_code AND e."partnerCode" = c.to_code GROUP BY 1, 2""",
)
def tag_source_pair(t: SharedTables) -> DataFrame:
    pairs = _pairs(t)
    tagged = resume.tag_source_pair(t.exports, pairs)
    return tagged.groupBy("source_from_country", "source_to_country").agg(F.count("*").alias("rows"))


@query(
    "null_out_nonfinite",
    """SELECT "reporterCode", count(*) AS rows, count(CASE WHEN "reporterCode" % 5 > 1 THEN "netWgt" END) AS finite,
       sum(CASE WHEN "reporterCode" % 5 > 1 THEN "netWgt" END) AS weight_kg FROM trade GROUP BY 1""",
    "weight_kg",
)
def null_out_nonfinite(t: SharedTables) -> DataFrame:
    rest = F.col("reporterCode") % 5
    spoilt = (
        F.when(rest == 0, F.lit(float("nan"))).when(rest == 1, F.lit(float("-inf"))).otherwise(F.col("netWgt"))
    )
    clean = guards.null_out_nonfinite(t.trade.withColumn("netWgt", spoilt))
    return clean.groupBy("reporterCode").agg(
        F.count("*").alias("rows"), F.count("netWgt").alias("finite"), F.sum("netWgt").alias("weight_kg")
    )


# --------------------------------------------------------------- column cleaning


def _count_by(df: DataFrame, *columns) -> DataFrame:
    return df.groupBy(*columns).agg(F.count("*").alias("rows"))


@query(
    "normalise_hs",
    """SELECT given, CASE WHEN given IS NULL THEN ''
          WHEN regexp_full_match(trim(given), '[0-9]+(\\.[0-9]+)?')
          THEN CAST(CAST(trunc(CAST(trim(given) AS DOUBLE)) AS BIGINT) AS VARCHAR) ELSE trim(given) END AS hs, count(*) AS rows
       FROM (SELECT CASE row_id % 4 WHEN 1 THEN ' ' || hs_code WHEN 2 THEN 'ex ' || hs_code || ' '
                    ELSE hs_code END AS given FROM raw) GROUP BY 1, 2""",
)
def normalise_hs(t: SharedTables) -> DataFrame:
    rest = F.col("row_id") % 4
    given = (
        F.when(rest == 1, F.concat(F.lit(" "), "hs_code"))
        .when(rest == 2, F.concat(F.lit("ex "), "hs_code", F.lit(" ")))
        .otherwise(F.col("hs_code"))
    )
    rows = t.raw.select(given.alias("given"))
    return _count_by(rows, "given", text.normalise_hs(F.col("given")).alias("hs"))


@query(
    "hs_int_text",
    """SELECT hs_code, CAST(TRY_CAST(hs_code AS BIGINT) AS VARCHAR) AS hs, count(*) AS rows FROM commodities GROUP BY 1, 2""",
)
def hs_int_text(t: SharedTables) -> DataFrame:
    return _count_by(t.commodities, "hs_code", text.hs_int_text(F.col("hs_code")).alias("hs"))


@query("hs_chapter", """SELECT substr("cmdCode", 1, 2) AS chapter, count(*) AS rows FROM trade GROUP BY 1""")
def hs_chapter(t: SharedTables) -> DataFrame:
    return _count_by(t.trade, text.hs_chapter(F.col("cmdCode")).alias("chapter"))


@query(
    "split_country_list",
    """SELECT role, name, count(*) AS rows FROM pieces WHERE name <> '' AND role IN ('origin', 'attention') GROUP BY 1, 2""",
)
def split_country_list(t: SharedTables) -> DataFrame:
    lists = F.array(
        *[
            F.struct(F.lit(role).alias("role"), text.split_country_list(F.col(column)).alias("names"))
            for role, column in (("origin", "origin"), ("attention", "for_attention"))
        ]
    )
    rows = t.raw.select(F.inline(lists)).select("role", F.explode("names").alias("name"))
    return _count_by(rows, "role", "name")


@query(
    "country_to_m49",
    """SELECT name, m49, count(*) AS rows FROM (
         SELECT s.name, coalesce(
           (SELECT arg_min(b.m49, b.ord) FROM book b WHERE lower(b.name) = lower(trim(s.name))),
           (SELECT arg_min(b.m49, b.ord) FROM book b
            WHERE contains(lower(b.name), lower(trim(s.name))) OR contains(lower(trim(s.name)), lower(b.name)))) AS m49
         FROM (SELECT CASE s_suppkey % 4 WHEN 0 THEN n_name WHEN 1 THEN ' ' || lower(n_name) || ' '
               WHEN 2 THEN 'Republic of ' || n_name ELSE 'Land ' || s_nationkey END AS name
               FROM supplier JOIN nation ON s_nationkey = n_nationkey) s) GROUP BY 1, 2""",
)
def country_to_m49(t: SharedTables) -> DataFrame:
    named = t.table("supplier").join(t.table("nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    rest = F.col("s_suppkey") % 4
    name = (
        F.when(rest == 0, F.col("n_name"))
        .when(rest == 1, F.concat(F.lit(" "), F.lower("n_name"), F.lit(" ")))
        .when(rest == 2, F.concat(F.lit("Republic of "), "n_name"))
        .otherwise(F.concat(F.lit("Land "), F.col("s_nationkey").cast("string")))
    )
    rows = named.select(name.alias("name"))
    return _count_by(rows, "name", t.book.code_of(F.col("name")).alias("m49"))


@query(
    "m49_to_name",
    """SELECT "reporterCode", name, count(*) AS rows FROM trade JOIN book ON m49 = "reporterCode" GROUP BY 1, 2""",
)
def m49_to_name(t: SharedTables) -> DataFrame:
    return _count_by(t.trade, "reporterCode", t.book.name_of(F.col("reporterCode")).alias("name"))


@query(
    "is_eu27",
    """SELECT "partnerCode", is_eu27, count(*) AS rows FROM trade JOIN book ON m49 = "partnerCode" GROUP BY 1, 2""",
)
def is_eu27(t: SharedTables) -> DataFrame:
    return _count_by(t.trade, "partnerCode", t.book.is_eu(F.col("partnerCode")).alias("is_eu27"))


@query(
    "extract_hazard_categories",
    """SELECT hazards, hazard_category, count(*) AS rows FROM raw JOIN cleaned USING (row_id) GROUP BY 1, 2""",
)
def extract_hazard_categories(t: SharedTables) -> DataFrame:
    category = text.extract_hazard_categories(F.col("hazards")).alias("hazard_category")
    return _count_by(t.raw, "hazards", category)


@query(
    "parse_classification",
    """SELECT r.classification, coalesce(c.kind, 'InfoAttention') AS kind, count(*) AS rows
       FROM raw r LEFT JOIN classes c ON c.spelling = lower(trim(r.classification)) GROUP BY 1, 2""",
)
def parse_classification(t: SharedTables) -> DataFrame:
    return _count_by(t.raw, "classification", text.parse_classification(F.col("classification")).alias("kind"))


@query(
    "parse_risk_decision",
    """SELECT r.risk_decision, coalesce(d.kind, 'PotentialRisk') AS kind, count(*) AS rows
       FROM raw r LEFT JOIN decisions d ON d.spelling = lower(trim(r.risk_decision)) GROUP BY 1, 2""",
)
def parse_risk_decision(t: SharedTables) -> DataFrame:
    return _count_by(t.raw, "risk_decision", text.parse_risk_decision(F.col("risk_decision")).alias("kind"))


def _categories(t: SharedTables) -> DataFrame:
    return t.raw.select(text.extract_hazard_categories(F.col("hazards")).alias("category"))


@query(
    "parse_hazard_type",
    """SELECT hazard_category AS category, family, count(*) AS rows
       FROM cleaned JOIN families ON txt = trim(hazard_category) GROUP BY 1, 2""",
)
def parse_hazard_type(t: SharedTables) -> DataFrame:
    return _count_by(_categories(t), "category", text.parse_hazard_type(F.col("category")).alias("family"))


@query(
    "parse_hazard_types",
    """SELECT hazard_category AS category, string_agg(family, ';' ORDER BY pos) AS families, max(n) AS rows FROM (
         SELECT hazard_category, n, generate_subscripts(parts, 1) AS pos, trim(unnest(parts)) AS part FROM (
           SELECT hazard_category, string_split(hazard_category, ',') AS parts, count(*) AS n FROM cleaned GROUP BY 1, 2))
       JOIN families ON txt = part WHERE part <> '' GROUP BY 1
       UNION ALL SELECT '' AS category, '' AS families, count(*) FROM cleaned WHERE hazard_category = ''""",
)
def parse_hazard_types(t: SharedTables) -> DataFrame:
    families = text.parse_hazard_types(F.col("category")).alias("families")
    return _count_by(_categories(t), "category", families)


@query("to_period_yyyymm", "SELECT period, count(*) AS rows FROM cleaned GROUP BY 1")
def to_period_yyyymm(t: SharedTables) -> DataFrame:
    return _count_by(t.raw, periods.to_period_yyyymm(F.col("date"), F.col("notification_date")).alias("period"))


@query(
    "months_between_yyyymm",
    """SELECT period, CASE WHEN period = 0 THEN 65535
          ELSE greatest(1999 * 12 + 6 - (period // 100) * 12 - period % 100, 0) END AS months, count(*) AS rows
       FROM cleaned GROUP BY 1, 2""",
)
def months_between_yyyymm(t: SharedTables) -> DataFrame:
    period = periods.to_period_yyyymm(F.col("date"), F.col("notification_date"))
    rows = t.raw.select(period.alias("period"))
    months = periods.months_between_yyyymm(F.lit(199906), F.col("period"))
    return _count_by(rows, "period", months.alias("months"))


@query(
    "coerce_double",
    """SELECT event_type, count(*) AS rows, count(TRY_CAST(given AS DOUBLE)) AS numbers,
       coalesce(sum(TRY_CAST(given AS DOUBLE)), 0.0) AS total FROM (
         SELECT event_type, CASE WHEN event_id % 3 = 0 THEN props ELSE regexp_extract(props, '([0-9]+)', 1) END AS given
         FROM events) GROUP BY 1""",
    "total",
)
def coerce_double(t: SharedTables) -> DataFrame:
    number = F.regexp_extract("props", "([0-9]+)", 1)
    given = F.when(F.col("event_id") % 3 == 0, F.col("props")).otherwise(number)
    value = guards.coerce_double(given)
    return t.table("events").groupBy("event_type").agg(
        F.count("*").alias("rows"), F.count(value).alias("numbers"), guards.total(value).alias("total")
    )


@query("route_label", "SELECT route, count(*) AS rows FROM routed GROUP BY 1")
def route_label(t: SharedTables) -> DataFrame:
    return _count_by(t.exports, text.route_label(F.col("reporterDesc"), F.col("partnerDesc")).alias("route"))


@query(
    "short_label",
    """SELECT CASE WHEN length("cmdDesc") > 23 THEN substr("cmdDesc", 1, 20) || '...' ELSE "cmdDesc" END AS label,
       CASE WHEN length("cmdDesc") > 23 THEN substr("cmdDesc", 1, 23) || '...' ELSE "cmdDesc" END AS cut,
       count(*) AS rows FROM trade GROUP BY 1, 2""",
)
def short_label(t: SharedTables) -> DataFrame:
    description = F.col("cmdDesc")
    return _count_by(
        t.trade, text.short_label(description, 23).alias("label"), text.truncate(description, 23).alias("cut")
    )


@query(
    "risk_band",
    """SELECT commodity_hs, destination_m49, origin_m49, CASE WHEN r < 0.25 THEN 'low' WHEN r < 0.5 THEN 'moderate'
       WHEN r < 0.75 THEN 'elevated' ELSE 'high' END AS band
       FROM (SELECT *, least(stable(his) / (SELECT max(stable(his)) FROM metrics), 1.0) AS r FROM metrics)""",
)
def risk_band(t: SharedTables) -> DataFrame:
    his = guards.stable(F.col("his"))
    largest = t.metrics.agg(F.max(his)).scalar()
    return t.metrics.select(*alerts.CORRIDOR, formulas.risk_band(his, largest).alias("band"))


@query(
    "concentration_band",
    """SELECT "reporterDesc", period, CASE WHEN stable(h) > 2500 THEN 'high' WHEN stable(h) > 1500 THEN 'moderate' ELSE 'low' END AS band
       FROM (SELECT "reporterDesc", period, sum(v * v) / pow(sum(v), 2) * 10000 AS h FROM (
         SELECT "reporterDesc", period, "cmdDesc", sum("primaryValue") AS v FROM exports GROUP BY 1, 2, 3) GROUP BY 1, 2)""",
)
def concentration_band(t: SharedTables) -> DataFrame:
    sums = t.exports.groupBy("reporterDesc", "period", "cmdDesc").agg(F.sum("primaryValue").alias("v"))
    hhi = sums.groupBy("reporterDesc", "period").agg(reports.hhi_percent(F.col("v")).alias("hhi"))
    return hhi.select(
        "reporterDesc", "period", formulas.concentration_band(guards.stable(F.col("hhi"))).alias("band")
    )
