"""The trade report, its pivots and folds, set operations and quality checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from catalog.base import query
from tradelanes import schemas
from tradelanes.functions import guards
from tradelanes.operators import flows, quality, reports
from tradelanes.plans.shared_tables import COMMODITY_NAMES, COUNTRY_NAMES, SharedTables
from tradelanes.sources import scans

_V, _W = 'coalesce(sum("primaryValue"), 0.0)', 'coalesce(sum("netWgt"), 0.0)'
_SUMS = f'{_V} AS value_usd, {_W} AS weight_kg, count("primaryValue") AS n_transactions'


def _top(column: str, n: int, source: str = "routed") -> str:
    return f'(SELECT {column} FROM {source} GROUP BY 1 ORDER BY stable(sum("primaryValue")) DESC, 1 LIMIT {n})'


def _pivot(names: list[str], column: str, value: str) -> str:
    return ", ".join(f"coalesce(sum(CASE WHEN {column} = '{n}' THEN {value} END), 0.0) AS \"{n}\"" for n in names)


def _not_in(column: str, names: list[str]) -> str:
    return f'"{column}" NOT IN ({", ".join(f"{chr(39)}{n}{chr(39)}" for n in names)})'


def _names(names: list[str]) -> str:
    """Pivot columns for the double list; names with blanks cannot be listed and are money anyway."""
    return " ".join(names)


@query(
    "exports_by_route_year",
    f'SELECT "reporterDesc", "partnerDesc", period, {_SUMS} FROM exports GROUP BY 1, 2, 3',
    "value_usd weight_kg",
)
def exports_by_route_year(t: SharedTables) -> DataFrame:
    return reports.exports_by_route_year(t.exports)


_ROUTES = f"""
SELECT *, sum(share_pct) OVER (ORDER BY rk) AS cumulative_share_pct FROM (
  SELECT *, row_number() OVER (ORDER BY stable(total_value_usd) DESC, route) AS rk,
         total_value_usd / (SELECT sum("primaryValue") FROM exports) * 100 AS share_pct FROM (
    SELECT route, min("reporterDesc") AS "reporterDesc", min("partnerDesc") AS "partnerDesc", {_V} AS total_value_usd,
           {_W} AS total_weight_kg, count("primaryValue") AS n_transactions FROM routed GROUP BY 1)) WHERE rk <= 15"""


@query(
    "top_routes",
    f"SELECT * EXCLUDE (rk) FROM ({_ROUTES})",
    "total_value_usd total_weight_kg share_pct cumulative_share_pct",
)
def top_routes(t: SharedTables) -> DataFrame:
    return reports.top_routes(t.exports)


@query("cumulative_share", f"SELECT route, share_pct, cumulative_share_pct FROM ({_ROUTES})", "share_pct cumulative_share_pct")
def cumulative_share(t: SharedTables) -> DataFrame:
    return reports.top_routes(t.exports).select("route", "share_pct", "cumulative_share_pct")


_YOY = """
SELECT *, value_last - value_prev AS abs_change_usd,
       CASE WHEN value_prev <> 0 THEN (value_last - value_prev) / value_prev * 100 END AS yoy_pct FROM (
  SELECT route, sum("primaryValue") FILTER (WHERE period = (SELECT max(period) FROM exports WHERE period < (SELECT max(period) FROM exports))) AS value_prev,
         sum("primaryValue") FILTER (WHERE period = (SELECT max(period) FROM exports)) AS value_last FROM routed GROUP BY 1)"""


@query("yoy_by_route", _YOY, "value_prev value_last abs_change_usd yoy_pct")
def yoy_by_route(t: SharedTables) -> DataFrame:
    return reports.yoy_by_route(t.exports)


@query(
    "yoy_movers",
    f"""SELECT * FROM ({_YOY}) WHERE abs_change_usd IS NOT NULL QUALIFY row_number() OVER (ORDER BY stable(abs_change_usd) DESC, route) <= 10
        OR row_number() OVER (ORDER BY stable(abs_change_usd), route) <= 10""",
    "value_prev value_last abs_change_usd yoy_pct",
)
def yoy_movers(t: SharedTables) -> DataFrame:
    return reports.yoy_movers(reports.yoy_by_route(t.exports))


@query(
    "yoy_movers_pct",
    f"""SELECT * FROM ({_YOY}) WHERE yoy_pct IS NOT NULL QUALIFY row_number() OVER (ORDER BY stable(yoy_pct) DESC, route) <= 7
        OR row_number() OVER (ORDER BY stable(yoy_pct), route) <= 7""",
    "value_prev value_last abs_change_usd yoy_pct",
)
def yoy_movers_pct(t: SharedTables) -> DataFrame:
    return reports.yoy_movers(reports.yoy_by_route(t.exports), 7, "yoy_pct")


@query(
    "reporter_partner_matrix",
    f'SELECT "reporterDesc", {_pivot(COUNTRY_NAMES, "q.\"partnerDesc\"", "\"primaryValue\"")}, '
    + f'coalesce(sum("primaryValue") FILTER ({_not_in("partnerDesc", COUNTRY_NAMES)}), 0.0) AS other FROM exports AS q GROUP BY 1',
    _names([*COUNTRY_NAMES, "other"]),
)
def reporter_partner_matrix(t: SharedTables) -> DataFrame:
    return reports.reporter_partner_matrix(t.exports, COUNTRY_NAMES, "other")


_PAIRS = 'SELECT "reporterDesc", "partnerDesc", sum("primaryValue") AS value_usd FROM exports GROUP BY 1, 2'


def _within(group: str, member: str, share: str) -> str:
    return f"""SELECT "{group}", "{member}", value_usd, {share} FROM (
        SELECT *, value_usd / sum(value_usd) OVER (PARTITION BY "{group}") * 100 AS {share},
               row_number() OVER (PARTITION BY "{group}" ORDER BY stable(value_usd) DESC, "{member}") AS rk FROM ({_PAIRS}))
        WHERE rk <= 10"""


@query(
    "partners_per_reporter",
    _within("reporterDesc", "partnerDesc", "share_of_reporter_pct"),
    "value_usd share_of_reporter_pct",
)
def partners_per_reporter(t: SharedTables) -> DataFrame:
    return reports.partners_per_reporter(t.exports)


@query(
    "reporters_per_partner",
    _within("partnerDesc", "reporterDesc", "share_of_partner_pct"),
    "value_usd share_of_partner_pct",
)
def reporters_per_partner(t: SharedTables) -> DataFrame:
    return reports.reporters_per_partner(t.exports)


@query(
    "share_of_group",
    f"""SELECT "cmdDesc", "reporterDesc", value_usd, value_usd / sum(value_usd) OVER (PARTITION BY "cmdDesc") * 100 AS share_pct FROM (
        SELECT "cmdDesc", "reporterDesc", {_V} AS value_usd FROM exports GROUP BY 1, 2)""",
    "value_usd share_pct",
)
def share_of_group(t: SharedTables) -> DataFrame:
    sums = t.exports.groupBy("cmdDesc", "reporterDesc").agg(guards.total(F.col("primaryValue")).alias("value_usd"))
    whole = F.sum("value_usd").over(Window.partitionBy("cmdDesc"))
    return sums.withColumn("share_pct", F.col("value_usd") / whole * 100)


def _top_of_top(group: str, member: str) -> str:
    return f"""SELECT *, value_usd / sum(value_usd) OVER (PARTITION BY "{group}") * 100 AS share_of_shown_pct FROM (
        SELECT * FROM ({_PAIRS}) WHERE "{group}" IN {_top(f'"{group}"', 5)}
        QUALIFY row_number() OVER (PARTITION BY "{group}" ORDER BY stable(value_usd) DESC, "{member}") <= 8)"""


@query(
    "top_partners_of_top_reporters",
    f'SELECT "reporterDesc", "partnerDesc", value_usd, share_of_shown_pct FROM ({_top_of_top("reporterDesc", "partnerDesc")})',
    "value_usd share_of_shown_pct",
)
def top_partners_of_top_reporters(t: SharedTables) -> DataFrame:
    return reports.top_partners_of_top_reporters(t.exports)


@query(
    "top_reporters_of_top_partners",
    f'SELECT "reporterDesc", "partnerDesc", value_usd, share_of_shown_pct FROM ({_top_of_top("partnerDesc", "reporterDesc")})',
    "value_usd share_of_shown_pct",
)
def top_reporters_of_top_partners(t: SharedTables) -> DataFrame:
    return reports.top_reporters_of_top_partners(t.exports)


@query(
    "top_heatmap",
    f"""SELECT "reporterDesc", "partnerDesc", value_usd / 1e6 AS value_musd FROM ({_PAIRS})
        WHERE "reporterDesc" IN {_top('"reporterDesc"', 12)} AND "partnerDesc" IN {_top('"partnerDesc"', 12)}""",
    "value_musd",
)
def top_heatmap(t: SharedTables) -> DataFrame:
    return reports.top_heatmap(t.exports)


# ----------------------------------------------------------------- commodities


@query(
    "semi_top_routes",
    f"""SELECT * FROM routed WHERE route IN {_top("route", 10)}""",
    "primaryValue netWgt qty",
)
def semi_top_routes(t: SharedTables) -> DataFrame:
    return reports.semi_top_routes(t.exports)


@query(
    "route_commodity_breakdown",
    f"""SELECT *, value_usd / sum(value_usd) OVER (PARTITION BY route) * 100 AS share_of_route_pct FROM (
        SELECT route, "reporterDesc", "partnerDesc", "cmdCode", "cmdDesc", {_SUMS} FROM routed
        WHERE route IN {_top("route", 10)} GROUP BY 1, 2, 3, 4, 5)""",
    "value_usd weight_kg share_of_route_pct",
)
def route_commodity_breakdown(t: SharedTables) -> DataFrame:
    return reports.route_commodity_breakdown(t.exports)


def _per_route(routes: int, keep: int) -> str:
    return f"""SELECT route, "cmdDesc", value_usd, weight_kg, value_usd / nullif(weight_kg, 0) AS unit_value_usd_per_kg FROM (
        SELECT route, "cmdDesc", {_V} AS value_usd, {_W} AS weight_kg FROM routed WHERE route IN {_top("route", routes)}
        GROUP BY 1, 2) QUALIFY row_number() OVER (PARTITION BY route ORDER BY stable(value_usd) DESC, "cmdDesc") <= {keep}"""


@query("top_commodities_per_route", _per_route(10, 10), "value_usd weight_kg unit_value_usd_per_kg")
def top_commodities_per_route(t: SharedTables) -> DataFrame:
    return reports.top_commodities_per_route(t.exports)


@query("top_route_commodities", _per_route(1, 3), "value_usd weight_kg unit_value_usd_per_kg")
def top_route_commodities(t: SharedTables) -> DataFrame:
    return reports.top_route_commodities(t.exports, 3)


_CELLS = ["c0", "c1", "c2", "c3", "c4", "c5"]


def _wide(df: DataFrame, key: str) -> DataFrame:
    """Commodity columns under short names."""
    return df.select(key, *[F.col(f"`{name}`").alias(c) for name, c in zip(COMMODITY_NAMES, _CELLS)])


def _wide_sql(routes: int, keep: int, inner: str) -> str:
    cells = ", ".join(
        f"coalesce(sum(CASE WHEN \"cmdDesc\" = '{n}' THEN value_usd END), 0.0) AS {c}" for n, c in zip(COMMODITY_NAMES, _CELLS)
    )
    return f"""SELECT route, {cells} FROM (SELECT * FROM ({inner}) AS i WHERE route IN {_top("route", routes)}
        AND "cmdDesc" IN (SELECT "cmdDesc" FROM ({inner}) AS k WHERE route IN {_top("route", routes)} GROUP BY 1
                          ORDER BY stable(sum(value_usd)) DESC, 1 LIMIT {keep})) GROUP BY 1"""


_BY_ROUTE = f'SELECT route, "cmdDesc", {_V} AS value_usd FROM routed GROUP BY 1, 2'


@query("commodity_summary_by_route", _wide_sql(10, 15, _BY_ROUTE), " ".join(_CELLS))
def commodity_summary_by_route(t: SharedTables) -> DataFrame:
    return _wide(reports.commodity_summary_by_route(t.exports, columns=COMMODITY_NAMES), "route")


@query("route_commodity_mix", _wide_sql(8, 4, _BY_ROUTE), " ".join(_CELLS))
def route_commodity_mix(t: SharedTables) -> DataFrame:
    return _wide(reports.route_commodity_mix(t.exports, commodities=4, columns=COMMODITY_NAMES), "route")


@query(
    "top_commodities_overall",
    f"""SELECT *, total_value_usd / (SELECT sum("primaryValue") FROM exports) * 100 AS share_pct,
        total_value_usd / nullif(total_weight_kg, 0) AS unit_value_usd_per_kg FROM (
        SELECT "cmdCode", "cmdDesc", {_V} AS total_value_usd, {_W} AS total_weight_kg,
               count(DISTINCT "reporterDesc") AS n_routes, count("primaryValue") AS n_transactions FROM exports GROUP BY 1, 2)
        ORDER BY stable(total_value_usd) DESC LIMIT 15""",
    "total_value_usd total_weight_kg share_pct unit_value_usd_per_kg",
)
def top_commodities_overall(t: SharedTables) -> DataFrame:
    return reports.top_commodities_overall(t.exports)


# ------------------------------------------------- unit values, concentrations


def _uv(key: str, source: str = "exports") -> str:
    return f"""SELECT {key}, period, value_usd, weight_kg, value_usd / nullif(weight_kg, 0) AS unit_value_usd_per_kg FROM (
        SELECT {key}, period, {_V} AS value_usd, {_W} AS weight_kg FROM {source} GROUP BY 1, 2)"""


_UV_DOUBLES = "value_usd weight_kg unit_value_usd_per_kg"


@query("unit_values_by_commodity_year", _uv('"cmdDesc"'), _UV_DOUBLES)
def unit_values_by_commodity_year(t: SharedTables) -> DataFrame:
    return reports.unit_values_by_commodity_year(t.exports)


@query("unit_values_by_route_year", _uv("route", "routed"), _UV_DOUBLES)
def unit_values_by_route_year(t: SharedTables) -> DataFrame:
    return reports.unit_values_by_route_year(t.exports)


_YEARS = list(range(1995, 2002))


@query(
    "unit_value_matrix",
    'SELECT "cmdDesc", '
    + ", ".join(f'max(CASE WHEN period = {y} THEN unit_value_usd_per_kg END) AS "{y}"' for y in _YEARS)
    + f" FROM ({_uv('\"cmdDesc\"')}) GROUP BY 1",
    " ".join(map(str, _YEARS)),
)
def unit_value_matrix(t: SharedTables) -> DataFrame:
    return reports.unit_value_matrix(t.exports, _YEARS)


@query(
    "unit_value_slope",
    f"""SELECT "cmdDesc", uv_first, uv_last, (uv_last - uv_first) / uv_first * 100 AS change_pct FROM (
        SELECT "cmdDesc", arg_min(unit_value_usd_per_kg, period) AS uv_first, arg_max(unit_value_usd_per_kg, period) AS uv_last
        FROM ({_uv('"cmdDesc"')}) GROUP BY 1 HAVING count(*) = (SELECT count(DISTINCT period) FROM exports))""",
    "uv_first uv_last change_pct",
)
def unit_value_slope(t: SharedTables) -> DataFrame:
    return reports.unit_value_slope(t.exports)


def _concentration(keys: str, member: str, count: str, hhi: str, top: str, share: str) -> str:
    return f"""SELECT {keys}, sum(v) AS total_export_usd, count(*) AS {count}, sum(pow(100 * v / whole, 2)) AS {hhi},
        CASE WHEN stable(sum(pow(100 * v / whole, 2))) > 2500 THEN 'high'
             WHEN stable(sum(pow(100 * v / whole, 2))) > 1500 THEN 'moderate' ELSE 'low' END AS concentration,
        min(CASE WHEN rk = 1 THEN {member} END) AS {top}, max(100 * v / whole) AS {share} FROM (
          SELECT *, sum(v) OVER (PARTITION BY {keys}) AS whole,
                 row_number() OVER (PARTITION BY {keys} ORDER BY stable(v) DESC, {member}) AS rk FROM (
            SELECT {keys}, {member}, {_V} AS v FROM exports GROUP BY ALL)) WHERE whole <> 0 GROUP BY {keys}"""


_MARKET = _concentration('"reporterDesc"', '"partnerDesc"', "n_partners", "hhi", "top_partner", "top_partner_share_pct")
_MARKET_YEAR = _concentration('"reporterDesc", period', '"partnerDesc"', "n_partners", "hhi", "top_p", "top_s")
_PRODUCT = _concentration(
    '"reporterDesc"', '"cmdDesc"', "n_commodities", "commodity_hhi", "top_commodity", "top_commodity_share_pct"
)


@query(
    "hhi_percent",
    f'SELECT "reporterDesc", period, hhi FROM ({_MARKET_YEAR})',
    "hhi",
)
def hhi_percent(t: SharedTables) -> DataFrame:
    pairs = reports.exports_by_route_year(t.exports)
    return pairs.groupBy("reporterDesc", "period").agg(reports.hhi_percent(F.col("value_usd")).alias("hhi"))


@query("market_concentration", _MARKET, "total_export_usd hhi top_partner_share_pct")
def market_concentration(t: SharedTables) -> DataFrame:
    return reports.market_concentration(t.exports)


@query("market_concentration_by_year", f"SELECT * EXCLUDE (top_p, top_s) FROM ({_MARKET_YEAR})", "total_export_usd hhi")
def market_concentration_by_year(t: SharedTables) -> DataFrame:
    return reports.market_concentration_by_year(t.exports)


@query("commodity_concentration", _PRODUCT, "total_export_usd commodity_hhi top_commodity_share_pct")
def commodity_concentration(t: SharedTables) -> DataFrame:
    return reports.commodity_concentration(t.exports)


@query(
    "hhi_year_shift",
    f"""SELECT "reporterDesc", hhi_first, hhi_second, hhi_second - hhi_first AS delta FROM (
        SELECT "reporterDesc", max(CASE WHEN period = (SELECT min(period) FROM exports) THEN hhi END) AS hhi_first,
               max(CASE WHEN period = (SELECT min(period) + 1 FROM exports) THEN hhi END) AS hhi_second
        FROM ({_MARKET_YEAR}) GROUP BY 1)""",
    "hhi_first hhi_second delta",
)
def hhi_year_shift(t: SharedTables) -> DataFrame:
    return reports.hhi_year_shift(t.exports)


@query(
    "dual_concentration",
    f"""SELECT m."reporterDesc", m.hhi, m.total_export_usd, p.commodity_hhi,
        CASE WHEN stable(commodity_hhi) > 2500 AND stable(hhi) > 2500 THEN 'both concentrated'
             WHEN stable(commodity_hhi) > 2500 THEN 'product concentrated'
             WHEN stable(hhi) > 2500 THEN 'destination concentrated' ELSE 'diversified' END AS quadrant
        FROM ({_MARKET}) m JOIN ({_PRODUCT}) p ON m."reporterDesc" = p."reporterDesc" """,
    "hhi total_export_usd commodity_hhi",
)
def dual_concentration(t: SharedTables) -> DataFrame:
    return reports.dual_concentration(t.exports)


_SHARES = f"""SELECT *, value_usd / sum(value_usd) OVER (PARTITION BY "cmdDesc") * 100 AS market_share_pct FROM (
    SELECT "cmdDesc", "reporterDesc", {_V} AS value_usd FROM exports GROUP BY 1, 2)"""


@query("market_share_by_commodity", _SHARES, "value_usd market_share_pct")
def market_share_by_commodity(t: SharedTables) -> DataFrame:
    return reports.market_share_by_commodity(t.exports)


@query(
    "market_share_matrix",
    f'SELECT "cmdDesc", '
    + ", ".join(
        f"coalesce(sum(CASE WHEN \"reporterDesc\" = '{n}' THEN \"primaryValue\" END), 0.0) / 1e6 AS musd_{i}"
        for i, n in enumerate(COUNTRY_NAMES)
    )
    + f', coalesce(sum("primaryValue") FILTER ({_not_in("reporterDesc", COUNTRY_NAMES)}), 0.0) / 1e6 AS musd_other'
    + " FROM exports GROUP BY 1",
    " ".join(f"musd_{i}" for i in [*range(25), "other"]),
)
def market_share_matrix(t: SharedTables) -> DataFrame:
    wide = reports.market_share_matrix(t.exports, COUNTRY_NAMES, "other")
    cells = [F.col(n).alias(f"musd_{i}") for i, n in enumerate(COUNTRY_NAMES)]
    return wide.select("cmdDesc", *cells, F.col("other").alias("musd_other"))


@query(
    "route_commodity_other",
    f"""SELECT route, CASE WHEN stable(share) >= 15 THEN "cmdDesc" ELSE 'Other' END AS label, sum(value_usd) AS value_usd FROM (
        SELECT *, value_usd / sum(value_usd) OVER (PARTITION BY route) * 100 AS share FROM ({_BY_ROUTE}) WHERE route IN {_top("route", 5)})
        GROUP BY 1, 2 HAVING label <> 'Other' OR sum(value_usd) > 0""",
    "value_usd",
)
def route_commodity_other(t: SharedTables) -> DataFrame:
    return reports.route_commodity_other(t.exports, least_pct=15.0)


@query(
    "reporter_commodity_other",
    f"""SELECT "reporterDesc", CASE WHEN "cmdDesc" IN (SELECT "cmdDesc" FROM exports WHERE "reporterDesc" IN {_top('"reporterDesc"', 10)}
          GROUP BY 1 ORDER BY stable(sum("primaryValue")) DESC, 1 LIMIT 4) THEN "cmdDesc" ELSE 'Other' END AS label,
        sum("primaryValue") AS value_usd FROM exports WHERE "reporterDesc" IN {_top('"reporterDesc"', 10)} GROUP BY 1, 2""",
    "value_usd",
)
def reporter_commodity_other(t: SharedTables) -> DataFrame:
    return reports.reporter_commodity_other(t.exports, commodities=4)


@query(
    "trade_totals",
    """SELECT sum("primaryValue") AS total_value_usd, count(DISTINCT period) AS periods, count(DISTINCT "reporterDesc") AS reporters,
       count(DISTINCT "partnerDesc") AS partners, count(DISTINCT "cmdDesc") AS commodities FROM exports""",
    "total_value_usd",
)
def trade_totals(t: SharedTables) -> DataFrame:
    return reports.trade_totals(t.exports)


# ------------------------------------------------------------- sets and quality


@query(
    "union_frames",
    """SELECT "flowCode", source, count(*) AS rows, sum("primaryValue") AS value_usd FROM (
       SELECT *, NULL::VARCHAR AS source FROM trade WHERE "flowCode" = 'M' UNION ALL
       SELECT *, "reporterDesc" FROM trade WHERE "flowCode" = 'X') GROUP BY 1, 2""",
    "value_usd",
)
def union_frames(t: SharedTables) -> DataFrame:
    imports = flows.filter_flow(t.trade, "M").drop("qty")
    merged = scans.union_frames([imports, t.exports.withColumn("source", F.col("reporterDesc"))])
    return merged.groupBy("flowCode", "source").agg(
        F.count("*").alias("rows"), F.sum("primaryValue").alias("value_usd")
    )


@query(
    "drop_duplicate_trade",
    """SELECT (SELECT count(*) FROM trade) * 2 AS rows_before, count(*) AS rows_after FROM (SELECT DISTINCT * FROM trade)""",
)
def drop_duplicate_trade(t: SharedTables) -> DataFrame:
    """Every row comes twice; the counts are partial sums over the distinct rows."""
    doubled = scans.union_frames([t.trade, t.trade])
    distinct = doubled.groupBy(t.trade.columns).agg(F.count("*").alias("copies"))
    return distinct.agg(F.sum("copies").alias("rows_before"), F.count("*").alias("rows_after"))


@query(
    "missing_columns",
    """SELECT 'netWgt' AS missing, count(*) AS rows FROM trade UNION ALL SELECT 'partnerDesc', count(*) FROM trade""",
)
def missing_columns(t: SharedTables) -> DataFrame:
    lacking = t.trade.drop("netWgt", "partnerDesc", "qty")
    missing = schemas.missing_columns(lacking, schemas.TRADE_REQUIRED)
    names = F.array(*[F.lit(m) for m in missing])
    return lacking.agg(F.count("*").alias("rows")).select(F.explode(names).alias("missing"), "rows")


_CHECKS = """
SELECT 'expected_columns_present' AS "check", true AS passed, 'all present' AS detail
UNION ALL SELECT 'total_rows', true, CAST(count(*) AS VARCHAR) FROM trade
UNION ALL SELECT 'periods', true, string_agg(period, ', ' ORDER BY period) FROM (SELECT DISTINCT period FROM trade)
UNION ALL SELECT 'export_only', count(*) = 1 AND min("flowDesc") = 'Export', string_agg("flowDesc", ', ' ORDER BY "flowDesc")
  FROM (SELECT DISTINCT "flowDesc" FROM trade)
UNION ALL SELECT 'negative_primaryValue', count(*) FILTER (WHERE "primaryValue" < 0) = 0,
  CAST(count(*) FILTER (WHERE "primaryValue" < 0) AS VARCHAR) FROM trade
UNION ALL SELECT 'zero_primaryValue', true, CAST(count(*) FILTER (WHERE "primaryValue" = 0) AS VARCHAR) FROM trade
UNION ALL SELECT 'unique_reporters', true, CAST(count(DISTINCT "reporterDesc") AS VARCHAR) FROM trade
UNION ALL SELECT 'unique_partners', true, CAST(count(DISTINCT "partnerDesc") AS VARCHAR) FROM trade
UNION ALL SELECT 'unique_commodities', true, CAST(count(DISTINCT "cmdDesc") AS VARCHAR) FROM trade
UNION ALL SELECT 'max_subtransactions_per_group', true, CAST(max(n) AS VARCHAR) FROM (
  SELECT count(*) AS n FROM trade GROUP BY "reporterDesc", "partnerDesc", "cmdCode", period)
UNION ALL SELECT 'mean_subtransactions_per_group', true, printf('%.1f', avg(n)) FROM (
  SELECT count(*) AS n FROM trade GROUP BY "reporterDesc", "partnerDesc", "cmdCode", period)
""" + "".join(
    f"""UNION ALL SELECT 'null_{c}', count(*) = count("{c}"), CAST(count(*) - count("{c}") AS VARCHAR) FROM trade
"""
    for c in quality.NULL_CHECKED
)


@query("validate_trade", _CHECKS)
def validate_trade(t: SharedTables) -> DataFrame:
    return quality.validate_trade(t.trade)


@query(
    "describe_trade",
    " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", count("{c}") AS count, avg("{c}") AS mean, stddev_samp("{c}") AS std, min("{c}") AS min,
            max("{c}") AS max, sum("{c}") AS total, count(*) - count("{c}") AS null_count, quantile_cont("{c}", 0.25) AS q25,
            quantile_cont("{c}", 0.5) AS q50, quantile_cont("{c}", 0.75) AS q75 FROM trade"""
        for c in ("primaryValue", "netWgt")
    ),
    "mean std min max total q25 q50 q75",
)
def describe_trade(t: SharedTables) -> DataFrame:
    return quality.describe_trade(t.trade)
