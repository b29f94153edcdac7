"""Dependency, consumption, trade-flow anomalies and the exposure network."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from catalog.base import query
from tradelanes.functions import formulas, guards
from tradelanes.operators import consumption, dependency, flows, hazard, network, ranking, trade_flow
from tradelanes.operators.alerts import CORRIDOR
from tradelanes.operators.flows import LANE
from tradelanes.plans import runs
from tradelanes.plans.shared_tables import SharedTables
from tradelanes.session import materialise
from tradelanes.sources import scans

_LANE = "commodity_hs, destination_m49, origin_m49, period"


def _lanes(t: SharedTables) -> DataFrame:
    return flows.lanes(flows.trade_cube(t.trade))


def _dependency(t: SharedTables) -> DataFrame:
    return dependency.corridor_dependency(t.trade, t.production)


@query(
    "filter_flow",
    """SELECT * FROM trade WHERE "flowCode" = 'M' AND "cmdCode" = '100630' AND "reporterCode" = 5""",
    "primaryValue netWgt qty",
)
def filter_flow(t: SharedTables) -> DataFrame:
    return flows.filter_flow(t.trade, "M", commodity="100630", reporter=5)


@query(
    "project_trade_columns",
    """SELECT * EXCLUDE ("qtyUnitAbbr") FROM trade""",
    "primaryValue netWgt qty",
)
def project_trade_columns(t: SharedTables) -> DataFrame:


    return scans.project_trade_columns(t.trade.withColumn("isReported", F.lit(True)).drop("qtyUnitAbbr"))


@query(
    "total_imports",
    "SELECT commodity_hs, destination_m49, period, total_imports_kg FROM import_sums",
    "total_imports_kg",
)
def total_imports(t: SharedTables) -> DataFrame:
    return flows.total_imports(t.trade)


@query("total_exports", "SELECT commodity_hs, country_m49, period, total_exports_kg FROM export_sums", "total_exports_kg")
def total_exports(t: SharedTables) -> DataFrame:
    return flows.total_exports(t.trade)


@query("bilateral_imports", f"SELECT {_LANE}, bilateral_import_kg FROM bilateral", "bilateral_import_kg")
def bilateral_imports(t: SharedTables) -> DataFrame:
    return flows.bilateral_imports(t.trade)


@query(
    "dependency_hhi",
    "SELECT commodity_hs, destination_m49, period, total_imports_kg, hhi FROM import_sums",
    "total_imports_kg hhi",
)
def dependency_hhi(t: SharedTables) -> DataFrame:
    return flows.dependency_hhi(t.trade)


@query("herfindahl", f"SELECT {_LANE}, hhi FROM lanes", "hhi")
def herfindahl(t: SharedTables) -> DataFrame:
    return _lanes(t).select(*LANE, "hhi")


def _metric(key: str, column: str, sql_column: str | None = None) -> None:
    """One dependency metric per lane."""

    @query(key, f"SELECT {_LANE}, {sql_column or column} AS {column} FROM dep", column)
    def build(t: SharedTables) -> DataFrame:
        return _dependency(t).select(*LANE, column)


_metric("supply_balance", "ds_prime")
_metric("import_dependency_ratio", "idr")
_metric("origin_country_share", "ocs")
_metric("bilateral_dependency", "bdi")
_metric("self_sufficiency", "ssr")
_metric("supply_criticality", "sci")


@query(
    "corridor_dependency",
    f"""SELECT {_LANE}, bilateral_import_kg, import_usd AS bilateral_import_usd, total_imports_kg, total_exports_kg,
        production_kg, domestic_supply_kg, ds_prime, idr, ocs, bdi, ssr, hhi, sci, sci_half, dq_flag FROM dep""",
    "bilateral_import_kg bilateral_import_usd total_imports_kg total_exports_kg production_kg domestic_supply_kg "
    "ds_prime idr ocs bdi ssr hhi sci sci_half",
)
def corridor_dependency(t: SharedTables) -> DataFrame:
    return _dependency(t)


@query(
    "supply_flag",
    f"""SELECT {_LANE}, total_imports_kg, total_exports_kg FROM lanes WHERE total_imports_kg - total_exports_kg <= 0""",
    "total_imports_kg total_exports_kg",
)
def supply_flag(t: SharedTables) -> DataFrame:
    """Lanes left out when no production is known."""
    flagged = dependency.supply_flag(dependency.corridor_dependency(t.trade))
    return flagged.select(*LANE, "total_imports_kg", "total_exports_kg")


# ------------------------------------------------------------------ consumption


def _pcc(t: SharedTables) -> DataFrame:
    return consumption.per_capita_consumption(t.balance)


@query("per_capita_consumption", "SELECT commodity_hs, country_m49, period, pcc FROM pcc", "pcc")
def per_capita_consumption(t: SharedTables) -> DataFrame:
    return _pcc(t).select("commodity_hs", "country_m49", "period", "pcc")


@query("consumption_rank_score", "SELECT commodity_hs, country_m49, period, pcc, crs FROM crs", "pcc crs")
def consumption_rank_score(t: SharedTables) -> DataFrame:
    return consumption.consumption_rank_score(_pcc(t)).select("commodity_hs", "country_m49", "period", "pcc", "crs")


_CV = """
SELECT commodity_hs, country_m49, count(pcc) AS n_periods, avg(pcc) AS pcc_mean, stddev_samp(pcc) AS pcc_std,
       CASE WHEN avg(pcc) > 0 THEN stddev_samp(pcc) / avg(pcc) END AS cv FROM {source} GROUP BY 1, 2"""


@query("demand_variability", _CV.format(source="pcc"), "pcc_mean pcc_std cv")
def demand_variability(t: SharedTables) -> DataFrame:
    return consumption.demand_variability(_pcc(t))


@query(
    "demand_inelasticity",
    "SELECT *, 1 - least(cv, 1.0) AS dis FROM ("
    + _CV.format(source="(SELECT * FROM pcc WHERE period > (SELECT max(period) FROM pcc) - 6)")
    + ")",
    "pcc_mean pcc_std cv dis",
)
def demand_inelasticity(t: SharedTables) -> DataFrame:
    return consumption.demand_inelasticity(_pcc(t), periods=6)


# ------------------------------------------------------------------- trade flow


@query(
    "unit_value",
    f"SELECT {_LANE}, unit_value FROM priced",
    "unit_value",
)
def unit_value(t: SharedTables) -> DataFrame:
    uv = formulas.unit_value(F.col("bilateral_import_usd"), F.col("bilateral_import_kg"))
    return _lanes(t).select(*LANE, uv.alias("unit_value"))


@query("unit_value_zscore", f"SELECT {_LANE}, unit_value, z_uv FROM uv", "unit_value z_uv")
def unit_value_zscore(t: SharedTables) -> DataFrame:
    return trade_flow.unit_value_zscore(_lanes(t)).select(*LANE, "unit_value", "z_uv")


@query(
    "peer_unit_values",
    """SELECT commodity_hs, destination_m49, period, count(*) OVER (PARTITION BY commodity_hs, destination_m49, period) AS peers,
       row_number() OVER (PARTITION BY commodity_hs, destination_m49, period ORDER BY origin_m49) - 1 AS position,
       origin_m49, unit_value, z_uv FROM uv""",
    "unit_value z_uv",
)
def peer_unit_values(t: SharedTables) -> DataFrame:
    gathered = trade_flow.peer_unit_values(_lanes(t))
    keys = ["commodity_hs", "destination_m49", "period"]
    placed = gathered.select(*keys, F.size("peers").alias("peers"), F.posexplode("peers").alias("position", "peer"))
    return placed.select(*keys, "peers", "position", "peer.*")


@query("volume_anomaly", f"SELECT {_LANE}, bilateral_import_kg, z_volume FROM volume", "bilateral_import_kg z_volume")
def volume_anomaly(t: SharedTables) -> DataFrame:
    return trade_flow.volume_anomaly(_lanes(t)).select(*LANE, "bilateral_import_kg", "z_volume")


def _rolled(t: SharedTables) -> DataFrame:
    return trade_flow.with_rolling(_lanes(t), CORRIDOR, "period", "bilateral_import_kg")


@query("rolling_mean", f"SELECT {_LANE}, rolling_mean FROM volume", "rolling_mean")
def rolling_mean(t: SharedTables) -> DataFrame:
    return _rolled(t).select(*LANE, "rolling_mean")


@query("rolling_std", f"SELECT {_LANE}, rolling_std FROM volume", "rolling_std")
def rolling_std(t: SharedTables) -> DataFrame:
    return _rolled(t).select(*LANE, "rolling_std")


def _statistic(key: str, sql: str, build_value) -> None:
    @query(key, f"SELECT commodity_hs, destination_m49, {sql} AS value FROM bilateral GROUP BY 1, 2", "value")
    def build(t: SharedTables) -> DataFrame:
        lanes = flows.bilateral_imports(t.trade)
        value: Column = build_value("bilateral_import_kg")
        return lanes.groupBy("commodity_hs", "destination_m49").agg(value.alias("value"))


_statistic("mean", "avg(bilateral_import_kg)", F.avg)
_statistic("std_dev", "stddev_samp(bilateral_import_kg)", F.stddev_samp)


@query(
    "zscore",
    f"""SELECT {_LANE}, CASE WHEN sd > abs(mu) * 1e-12 THEN (bilateral_import_kg - mu) / sd END AS z FROM bilateral
        JOIN (SELECT commodity_hs, avg(bilateral_import_kg) AS mu, stddev_samp(bilateral_import_kg) AS sd
              FROM bilateral GROUP BY 1) USING (commodity_hs)""",
    "z",
)
def zscore(t: SharedTables) -> DataFrame:
    """Against all lanes of a commodity: an aggregate joined back, not a window over a hot key."""
    lanes = materialise(flows.bilateral_imports(t.trade))
    stats = lanes.groupBy("commodity_hs").agg(
        F.avg("bilateral_import_kg").alias("mu"), F.stddev_samp("bilateral_import_kg").alias("sd")
    )
    z = formulas.zscore(F.col("bilateral_import_kg"), F.col("mu"), F.col("sd"))
    return lanes.join(stats, "commodity_hs").select(*LANE, z.alias("z"))


@query("mirror_join", f"SELECT {_LANE}, m_reported, x_reported FROM mirror", "m_reported x_reported")
def mirror_join(t: SharedTables) -> DataFrame:
    return trade_flow.mirror_join(flows.trade_cube(t.trade))


@query("mirror_discrepancy", f"SELECT {_LANE}, mtd FROM mirror", "mtd")
def mirror_discrepancy(t: SharedTables) -> DataFrame:
    return trade_flow.mirror_discrepancy(flows.trade_cube(t.trade)).select(*LANE, "mtd")


@query(
    "concentration_shifts",
    "SELECT commodity_hs, destination_m49, period, hhi_current, hhi_previous, delta_hhi FROM shifts",
    "hhi_current hhi_previous delta_hhi",
)
def concentration_shifts(t: SharedTables) -> DataFrame:
    cube = materialise(flows.trade_cube(t.trade))
    return trade_flow.concentration_shifts(trade_flow.importer_hhi(flows.lanes(cube)), flows.trade_periods(cube))


@query("delta_hhi", "SELECT commodity_hs, destination_m49, period, delta_hhi FROM shifts", "delta_hhi")
def delta_hhi(t: SharedTables) -> DataFrame:
    return concentration_shifts(t).select("commodity_hs", "destination_m49", "period", "delta_hhi")


@query("delta_ocs", f"SELECT {_LANE}, ocs, ocs_previous, delta_ocs FROM share_shift", "ocs ocs_previous delta_ocs")
def delta_ocs(t: SharedTables) -> DataFrame:
    cube = materialise(flows.trade_cube(t.trade))
    return trade_flow.delta_ocs(flows.lanes(cube), flows.trade_periods(cube))


_ANOMALIES = f"SELECT {_LANE}, unit_value, z_uv, mtd, delta_hhi FROM anomalies"


@query("trade_anomalies", _ANOMALIES, "unit_value z_uv mtd delta_hhi")
def trade_anomalies(t: SharedTables) -> DataFrame:
    return trade_flow.trade_anomalies(materialise(flows.trade_cube(t.trade)))


@query(
    "anomaly_flags",
    f"""SELECT {_LANE}, coalesce(z_uv, 0) < -2 AS low_price, coalesce(z_uv, 0) > 2 AS high_price,
        coalesce(mtd, 0) > 0.3 AS mirror_alert FROM anomalies""",
)
def anomaly_flags(t: SharedTables) -> DataFrame:
    flagged = trade_flow.anomaly_flags(trade_anomalies(t))
    return flagged.select(*LANE, "low_price", "high_price", "mirror_alert")


# ---------------------------------------------------------------- normalisation


def _ranked(t: SharedTables) -> DataFrame:
    return materialise(_lanes(t).select(*LANE, "bilateral_import_kg"))


def _rank_sql(measure: str) -> str:
    return f"""SELECT {_LANE}, (row_number() OVER (ORDER BY stable({measure}),
        md5(concat_ws('|', {_LANE}))) - 1) / (count(*) OVER () - 1)::DOUBLE AS norm FROM bilateral"""


@query("normalise_percentile_rank", _rank_sql("bilateral_import_kg"), "norm")
def normalise_percentile_rank(t: SharedTables) -> DataFrame:
    ranked = ranking.normalise_percentile_rank(_ranked(t), "bilateral_import_kg", LANE, "norm")
    return ranked.select(*LANE, "norm")


@query("normalise_log_percentile", _rank_sql("ln(1 + bilateral_import_kg)"), "norm")
def normalise_log_percentile(t: SharedTables) -> DataFrame:
    ranked = ranking.normalise_log_percentile(_ranked(t), "bilateral_import_kg", LANE, "norm")
    return ranked.select(*LANE, "norm")


@query(
    "normalise_min_max",
    f"""SELECT {_LANE}, (bilateral_import_kg - lo) / (hi - lo) AS norm FROM bilateral
        CROSS JOIN (SELECT min(bilateral_import_kg) AS lo, max(bilateral_import_kg) AS hi FROM bilateral)""",
    "norm",
)
def normalise_min_max(t: SharedTables) -> DataFrame:
    return ranking.normalise_min_max(_ranked(t), "bilateral_import_kg", "norm").select(*LANE, "norm")


# ---------------------------------------------------------------------- network

_EDGES = """(SELECT origin_m49, destination_m49, commodity_hs, coalesce(bilateral_import_kg, 0.0) AS trade_weight,
  his AS hazard_weight, coalesce(bdi, severity_total) AS dep_weight FROM enriched) AS e"""
_WEIGHTS = "trade_weight hazard_weight dep_weight"


def _edges(t: SharedTables) -> DataFrame:
    """Edges need the dependency of a corridor, and nothing else of the trade side."""
    return network.exposure_edges(runs.with_dependency(t.metrics, t.cube, t.renamed(t.production)))


@query("exposure_edges", f"SELECT * FROM {_EDGES}", _WEIGHTS)
def exposure_edges(t: SharedTables) -> DataFrame:
    return _edges(t)


@query("edges_from", f"SELECT * FROM {_EDGES} WHERE origin_m49 = 3", _WEIGHTS)
def edges_from(t: SharedTables) -> DataFrame:
    return network.edges_from(_edges(t), 3)


@query("edges_to", f"SELECT * FROM {_EDGES} WHERE destination_m49 = 3", _WEIGHTS)
def edges_to(t: SharedTables) -> DataFrame:
    return network.edges_to(_edges(t), 3)


@query("all_nodes", "SELECT origin_m49 AS m49 FROM metrics UNION SELECT destination_m49 FROM metrics")
def all_nodes(t: SharedTables) -> DataFrame:
    return network.all_nodes(t.metrics)


@query(
    "origin_risk_propagation",
    f"""SELECT origin_m49, e.commodity_hs, sum(dep_weight * hazard_weight * coalesce(pcc, 0.0)) AS orps FROM {_EDGES}
        LEFT JOIN (SELECT CAST(CAST(commodity_hs AS BIGINT) AS VARCHAR) AS hs, country_m49, pcc FROM pcc
                   WHERE period = (SELECT last_period FROM last_year)) p
        ON p.hs = e.commodity_hs AND p.country_m49 = e.destination_m49 GROUP BY 1, 2""",
    "orps",
)
def origin_risk_propagation(t: SharedTables) -> DataFrame:
    latest = flows.last_period(t.cube)
    pcc = t.renamed(_pcc(t)).where(F.col("period") == latest)
    return network.origin_risk_propagation(_edges(t), pcc)


@query(
    "attention_exposure",
    f"""SELECT destination_m49, sum(dep_weight * hazard_weight * coalesce(crs, 0.0)) AS acep FROM {_EDGES}
        LEFT JOIN (SELECT commodity_hs AS hs, country_m49, crs FROM crs_short
                   WHERE period = (SELECT last_period FROM last_year)) p
        ON p.hs = e.commodity_hs AND p.country_m49 = e.destination_m49 GROUP BY 1""",
    "acep",
)
def attention_exposure(t: SharedTables) -> DataFrame:
    latest = flows.last_period(t.cube)
    ranks = consumption.consumption_rank_score(t.renamed(_pcc(t))).where(F.col("period") == latest)
    return network.attention_exposure(_edges(t), ranks)


@query(
    "orps_by_commodity",
    """SELECT origin_m49, commodity_hs, sum(severity_total * his) AS orps FROM metrics GROUP BY 1, 2""",
    "orps",
)
def orps_by_commodity(t: SharedTables) -> DataFrame:
    scores = network.origin_risk_propagation(network.exposure_edges(t.metrics))
    return scores.orderBy("origin_m49", guards.stable(F.col("orps")).desc(), "commodity_hs")


@query(
    "run_network",
    "SELECT origin_m49, destination_m49, commodity_hs, 0.0 AS trade_weight, his AS hazard_weight, severity_total AS dep_weight FROM metrics",
    _WEIGHTS,
)
def run_network(t: SharedTables) -> DataFrame:
    return runs.run_network(t.metrics)


@query(
    "hazard_probability",
    """SELECT commodity_hs, destination_m49, origin_m49, import_kg, coalesce(n.alerts, 0) AS alerts,
       CASE WHEN import_kg > 0 THEN coalesce(n.alerts, 0) / (import_kg / (import_kg / shipments)) END AS hazard_probability
       FROM (SELECT CAST(CAST(commodity_hs AS BIGINT) AS VARCHAR) AS commodity_hs, destination_m49, origin_m49,
             sum(bilateral_import_kg) AS import_kg, CAST(sum(import_rows) AS BIGINT) AS shipments FROM bilateral GROUP BY 1, 2, 3)
       LEFT JOIN (SELECT commodity_hs, destination_m49, origin_m49, count(*) AS alerts FROM touched GROUP BY 1, 2, 3) n
       USING (commodity_hs, destination_m49, origin_m49)""",
    "import_kg hazard_probability",
)
def hazard_probability(t: SharedTables) -> DataFrame:
    lanes = flows.trade_cube(t.trade, normalise=True).where("import_rows > 0").select(
        "commodity_hs",
        F.col("reporterCode").alias("destination_m49"),
        F.col("partnerCode").alias("origin_m49"),
        F.col("import_kg").alias("bilateral_import_kg"),
        F.col("import_rows").alias("shipments"),
    )
    counts = hazard.notification_counts(t.notifications)
    table = network.shipment_probability(counts, lanes)
    return table.select(*CORRIDOR, "import_kg", "alerts", "hazard_probability")


_NODES = """(SELECT origin_m49 AS m49, his FROM {0} UNION ALL SELECT destination_m49, his FROM {0})"""


@query(
    "network_nodes",
    f"""SELECT n.m49, b.name, b.is_eu27, count(*) AS corridor_count, sum(his) AS total_his
        FROM {_NODES.format("metrics")} n JOIN book b ON b.m49 = n.m49 GROUP BY 1, 2, 3""",
    "total_his",
)
def network_nodes(t: SharedTables) -> DataFrame:
    return network.network_nodes(t.metrics, t.book)


@query(
    "network_edges",
    "SELECT origin_m49, destination_m49, commodity_hs, his, severity_total FROM metrics",
    "his severity_total",
)
def network_edges(t: SharedTables) -> DataFrame:
    return network.network_edges(t.metrics)


_SUMMARY = f"""
SELECT count(DISTINCT m49) AS node_count, (SELECT count(*) FROM metrics) AS edge_count,
       (SELECT count(*) FROM metrics) / pow(count(DISTINCT m49), 2) AS density FROM {_NODES.format("metrics")}"""


@query("network_summary", f"SELECT node_count, edge_count FROM ({_SUMMARY})")
def network_summary(t: SharedTables) -> DataFrame:
    return network.network_summary(t.metrics).select("node_count", "edge_count")


@query("network_density", _SUMMARY, "density")
def network_density(t: SharedTables) -> DataFrame:
    return network.network_summary(t.metrics)


@query(
    "origin_risk",
    """SELECT origin_m49, name, sum(his) AS total_his, sum(severity_total) AS total_severity, count(*) AS corridor_count
       FROM metrics JOIN book ON m49 = origin_m49 GROUP BY 1, 2 ORDER BY stable(sum(his)) DESC, 1""",
    "total_his total_severity",
)
def origin_risk(t: SharedTables) -> DataFrame:
    return network.origin_risk(t.metrics, t.book)


_LINKS = """
SELECT origin_m49, destination_m49, sum(his) AS his, count(*) AS corridor_count,
       sum(his) / greatest((SELECT max(his) FROM metrics), 0.001) AS rel_his FROM metrics GROUP BY 1, 2"""


@query("merge_links", _LINKS, "his rel_his")
def merge_links(t: SharedTables) -> DataFrame:
    return network.merge_links(t.metrics)


@query("edge_floor", f"SELECT * FROM ({_LINKS}) WHERE stable(rel_his) >= 0.25", "his rel_his")
def edge_floor(t: SharedTables) -> DataFrame:
    return network.edge_floor(network.merge_links(t.metrics), 25)
