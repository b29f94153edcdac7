"""Corridor, country and commodity queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catalog.base import query
from catalog.prelude import FAMILY_LIST
from tradelanes.operators import explore
from tradelanes.operators.alerts import CORRIDOR
from tradelanes.plans.shared_tables import SharedTables

_KEY = "commodity_hs, destination_m49, origin_m49"
_SHORT = f"{_KEY}, origin_country, destination_country, his, hdi, notification_count, severity_total"
_SHORT_LIST = [*CORRIDOR, "origin_country", "destination_country", "his", "hdi", "notification_count", "severity_total"]
_DOUBLES = "his hdi severity_total"
_BY_HIS = f"ORDER BY stable(his) DESC, {_KEY}"


@query(
    "filter_corridors",
    f"""SELECT {_SHORT} FROM metrics WHERE stable(his) >= 0.5 AND stable(hdi) >= 0.3 AND notification_count >= 3
        AND is_active_destination AND list_contains(roles, 'notifier')
        AND origin_m49 NOT IN (SELECT m49 FROM book WHERE is_eu27)
        AND destination_m49 IN (SELECT m49 FROM book WHERE is_eu27) {_BY_HIS}""",
    _DOUBLES,
)
def filter_corridors(t: SharedTables) -> DataFrame:
    found = explore.filter_corridors(
        t.metrics,
        t.book,
        min_his=0.5,
        min_hdi=0.3,
        min_notification_count=3,
        active_only=True,
        role="notifier",
        origin_eu=False,
        dest_eu=True,
        has_cvs=False,
    )
    return found.select(_SHORT_LIST)


@query(
    "count_corridors",
    "SELECT count(*) AS count FROM scored WHERE commodity_hs = '100630' AND stable(cvs) >= 0.05",
)
def count_corridors(t: SharedTables) -> DataFrame:
    return explore.count_corridors(t.scored, t.book, commodity="100630", min_cvs=0.05, has_cvs=True)


_EU = "IN (SELECT m49 FROM book WHERE is_eu27)"


@query(
    "corridor_presets",
    f"""SELECT 'high_hazard' AS preset, count(*) FILTER (WHERE stable(his) >= 0.5) AS corridors FROM metrics
        UNION ALL SELECT 'active_destination', count(*) FILTER (WHERE is_active_destination) FROM metrics
        UNION ALL SELECT 'notifier', count(*) FILTER (WHERE list_contains(roles, 'notifier')) FROM metrics
        UNION ALL SELECT 'eu_to_eu', count(*) FROM metrics WHERE origin_m49 {_EU} AND destination_m49 {_EU}
        UNION ALL SELECT 'non_eu_to_eu', count(*) FROM metrics WHERE NOT origin_m49 {_EU} AND destination_m49 {_EU}""",
)
def corridor_presets(t: SharedTables) -> DataFrame:
    return explore.corridor_presets(t.metrics, t.book)


_ONE = "commodity_hs = '100630' AND destination_m49 = 2 AND origin_m49 = 16"


@query("corridor_lookup", f"SELECT {_SHORT}, {FAMILY_LIST} FROM metrics WHERE {_ONE}", _DOUBLES + " " + FAMILY_LIST.replace(",", ""))
def corridor_lookup(t: SharedTables) -> DataFrame:
    found = explore.corridor_lookup(t.metrics, "100630", 2, 16)
    return found.select(_SHORT_LIST + FAMILY_LIST.split(", "))


@query(
    "corridor_hazard_lookup",
    f"SELECT {_KEY}, his, hdi, notification_count, severity_total FROM metrics WHERE {_ONE}",
    _DOUBLES,
)
def corridor_hazard_lookup(t: SharedTables) -> DataFrame:
    return explore.corridor_hazard_lookup(t.metrics, "100630", 2, 16)


@query(
    "text_search",
    f"""SELECT {_SHORT} FROM metrics WHERE contains(lower(origin_country), 'nation_1')
        OR contains(lower(commodity_hs), 'nation_1')""",
    _DOUBLES,
)
def text_search(t: SharedTables) -> DataFrame:
    return explore.text_search(t.metrics, ["origin_country", "commodity_hs"], "Nation_1").select(_SHORT_LIST)


@query(
    "top_corridors",
    f"""SELECT {_SHORT} FROM metrics ORDER BY stable(severity_total) DESC, {_KEY} LIMIT 50""",
    _DOUBLES,
)
def top_corridors(t: SharedTables) -> DataFrame:
    return explore.top_corridors(t.metrics, 50, "severity_total").select(_SHORT_LIST)


@query(
    "commodity_corridors",
    f"""SELECT {_SHORT}, names, '090421' AS hs_code FROM metrics LEFT JOIN hs_names ON hs_code = '090421'
        WHERE commodity_hs IN ('90421', '090421')""",
    _DOUBLES,
)
def commodity_corridors(t: SharedTables) -> DataFrame:
    found = explore.commodity_corridors(t.metrics, explore.hs_code_names(t.commodities), "090421")
    return found.select(*_SHORT_LIST, "names", "hs_code")


@query(
    "exposure_profile",
    f"""SELECT {_KEY}, his, position, corridor_count FROM (
        SELECT *, row_number() OVER (PARTITION BY destination_m49 {_BY_HIS}) AS position,
               count(*) OVER (PARTITION BY destination_m49) AS corridor_count FROM metrics) WHERE position <= 50""",
    "his",
)
def exposure_profile(t: SharedTables) -> DataFrame:
    return explore.exposure_profile(t.metrics).select(*CORRIDOR, "his", "position", "corridor_count")


@query(
    "sort_page",
    f"""SELECT {_KEY}, cvs FROM scored ORDER BY stable(cvs) ASC NULLS LAST, {_KEY} LIMIT 25 OFFSET 50""",
    "cvs",
)
def sort_page(t: SharedTables) -> DataFrame:
    page = explore.sort_page(t.scored, "cvs", CORRIDOR, descending=False, page=2)
    return page.select(*CORRIDOR, "cvs")


@query(
    "list_countries",
    """SELECT m49, min(name) AS name, bool_or(is_eu27) AS is_eu27, coalesce(max(n), 0) AS suppliers FROM book
       LEFT JOIN (SELECT s_nationkey, count(*) AS n FROM supplier GROUP BY 1) ON s_nationkey = ord
       WHERE is_eu27 AND m49 <> 0 GROUP BY 1""",
)
def list_countries(t: SharedTables) -> DataFrame:
    """All member states, with the suppliers each has, if any."""
    suppliers = t.table("supplier").groupBy((F.col("s_nationkey") + 1).alias("m49")).agg(F.count("*").alias("suppliers"))
    states = explore.list_countries(t.countries, eu_only=True).join(suppliers, "m49", "left")
    return states.na.fill(0, ["suppliers"])


@query(
    "country_detail",
    """SELECT m49, name, is_eu27, (SELECT count(*) FROM metrics WHERE destination_m49 = m49) AS corridors_as_destination,
       (SELECT count(*) FROM metrics WHERE origin_m49 = m49) AS corridors_as_origin FROM book
       WHERE m49 IN (SELECT origin_m49 FROM metrics UNION SELECT destination_m49 FROM metrics)""",
)
def country_detail(t: SharedTables) -> DataFrame:
    return explore.country_detail(t.metrics, t.book)


@query("inbound_his_total", "SELECT destination_m49, sum(his) AS inbound_his FROM metrics GROUP BY 1", "inbound_his")
def inbound_his_total(t: SharedTables) -> DataFrame:
    return explore.inbound_his_total(t.metrics)


def _top(column: str) -> str:
    return f"(SELECT {column} FROM scored GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)"


@query(
    "corridor_view_stats",
    f"""SELECT count(*) AS corridors, CAST(sum(notification_count) AS BIGINT) AS sum_alerts, avg(his) AS mean_his,
        max(his) AS max_his, count(cvs) AS with_cvs, {_top("destination_country")} AS top_destination,
        {_top("origin_country")} AS top_origin, {_top("commodity_hs")} AS top_commodity FROM scored""",
    "mean_his max_his",
)
def corridor_view_stats(t: SharedTables) -> DataFrame:
    return explore.corridor_view_stats(t.scored)


@query(
    "dashboard_kpis",
    """SELECT count(*) AS corridors, count(cvs) > 0 AS cvs_available,
       count(*) FILTER (WHERE stable(coalesce(cvs, 0)) > 0.3) AS flagged, max(coalesce(cvs, 0)) AS max_score FROM scored""",
    "max_score",
)
def dashboard_kpis(t: SharedTables) -> DataFrame:
    return explore.dashboard_kpis(t.scored)


@query(
    "hazard_heatmap",
    """WITH whole AS (SELECT *, substr(CASE WHEN length(commodity_hs) IN (3, 5) AND TRY_CAST(commodity_hs AS BIGINT) IS NOT NULL
                                      THEN '0' ELSE '' END || commodity_hs, 1, 2) AS chapter FROM metrics)
       SELECT origin_country, chapter, max(his) AS max_his FROM whole
       WHERE origin_country IN (SELECT origin_country FROM whole GROUP BY 1 ORDER BY stable(sum(his)) DESC, 1 LIMIT 15)
       AND chapter IN (SELECT chapter FROM whole GROUP BY 1 ORDER BY stable(sum(his)) DESC, 1 LIMIT 4) GROUP BY 1, 2""",
    "max_his",
)
def hazard_heatmap(t: SharedTables) -> DataFrame:
    return explore.hazard_heatmap(t.metrics, columns=4)


# ------------------------------------------------------------------ commodities


@query("hs_code_names", "SELECT hs_code, names FROM hs_names")
def hs_code_names(t: SharedTables) -> DataFrame:
    return explore.hs_code_names(t.commodities)


@query("hs_names_lookup", "SELECT hs_code, names FROM hs_names WHERE hs_code = '090421'")
def hs_names_lookup(t: SharedTables) -> DataFrame:
    return explore.hs_names_lookup(explore.hs_code_names(t.commodities), "090421")


@query(
    "hs_code_summary",
    """SELECT hs_code, CAST(n AS INTEGER) AS commodity_count,
       array_to_string(name_list[1:3], ', ') || CASE WHEN n > 3 THEN '...' ELSE '' END AS sample_commodities FROM hs_names""",
)
def hs_code_summary(t: SharedTables) -> DataFrame:
    return explore.hs_code_summary(t.commodities)


@query("unique_hs_codes", "SELECT DISTINCT hs_code FROM commodities WHERE hs_code IS NOT NULL")
def unique_hs_codes(t: SharedTables) -> DataFrame:
    return explore.unique_hs_codes(t.commodities)


@query("hs_by_chapter", "SELECT DISTINCT hs_code FROM commodities WHERE hs_code LIKE '09%'")
def hs_by_chapter(t: SharedTables) -> DataFrame:
    return explore.hs_by_chapter(t.commodities, "09")
