"""Notifications, corridors and hazard signals."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catalog.base import query
from catalog.prelude import FAMILIES, FAMILY_LIST
from tradelanes import dimensions
from tradelanes.functions import formulas
from tradelanes.functions.periods import to_period_yyyymm
from tradelanes.functions.text import extract_hazard_categories
from tradelanes.operators import alerts, calibration, consumption, dependency, explore, hazard, scoring
from tradelanes.operators.alerts import CORRIDOR
from tradelanes.plans import runs
from tradelanes.plans.shared_tables import SharedTables
from tradelanes.session import materialise

_KEY = "commodity_hs, destination_m49, origin_m49"
_ROLES = "array_to_string(roles, ';') AS destination_roles"
_ROLE_COUNTS = 'role_notifier, role_distribution, "role_followUp", role_attention'


@query("explode_origins", "SELECT row_id, origin_country, origin_m49 FROM origins")
def explode_origins(t: SharedTables) -> DataFrame:
    return alerts.explode_origins(t.raw, t.book).select("row_id", "origin_country", "origin_m49")


@query(
    "collect_destinations",
    f"SELECT row_id, destination_country, destination_m49, {_ROLES} FROM destinations",
)
def collect_destinations(t: SharedTables) -> DataFrame:
    return alerts.collect_destinations(t.raw, t.book).drop("reference")


@query(
    "extract_corridors",
    f"""SELECT row_id, reference, commodity_hs, commodity_name, classification, risk_decision, hazard_category, period,
        origin_country, origin_m49, destination_country, destination_m49, {_ROLES}, active AS is_active_destination
        FROM corridor_events""",
)
def extract_corridors(t: SharedTables) -> DataFrame:
    return t.events.drop("pos")


@query(
    "active_destination",
    f"SELECT {_ROLES}, active, count(*) AS rows FROM corridor_events GROUP BY 1, 2",
)
def active_destination(t: SharedTables) -> DataFrame:
    active = alerts.active_destination(F.col("destination_roles")).alias("active")
    return t.events.groupBy("destination_roles", active).agg(F.count("*").alias("rows"))


@query(
    "build_notifications",
    """SELECT reference, commodity_hs, origin_m49, array_to_string(affected, ';') AS affected, classification,
       risk_decision, hazard_type, period FROM notif""",
)
def build_notifications(t: SharedTables) -> DataFrame:
    return t.notifications


@query(
    "build_notifications_followup",
    """SELECT r.row_id, r.reference, c.commodity_hs, o.m49 AS origin_m49, a.affected,
       coalesce(k.kind, 'InfoAttention') AS classification, coalesce(d.kind, 'PotentialRisk') AS risk_decision,
       coalesce(f.family, 'chem_other') AS hazard_type, c.period
       FROM raw r JOIN cleaned c USING (row_id) JOIN name_map o ON o.name = trim(r.origin)
       JOIN (SELECT row_id, string_agg(m49, ';' ORDER BY pos) AS affected FROM mapped
             WHERE role = 'followUp' AND m49 IS NOT NULL GROUP BY 1) a ON a.row_id = r.row_id
       LEFT JOIN classes k ON k.spelling = lower(trim(r.classification))
       LEFT JOIN decisions d ON d.spelling = lower(trim(r.risk_decision))
       LEFT JOIN families f ON f.txt = trim(c.hazard_category)
       WHERE o.m49 IS NOT NULL AND c.commodity_hs <> '' AND c.period <> 0""",
)
def build_notifications_followup(t: SharedTables) -> DataFrame:
    rows = t.raw.withColumns(
        {
            "period": to_period_yyyymm(F.col("date"), F.col("notification_date")),
            "hazard_category": extract_hazard_categories(F.col("hazards")),
        }
    )
    return alerts.build_notifications_followup(rows, t.book)


@query(
    "extract_trade_pairs",
    "SELECT row_id, reference, from_country, from_code, to_country, to_code, hs_code, commodity FROM pairs",
)
def extract_trade_pairs(t: SharedTables) -> DataFrame:
    return alerts.extract_trade_pairs(t.raw, t.book).drop("pos")


@query(
    "unique_country_pairs",
    """SELECT DISTINCT from_code, to_code, from_country, to_country FROM pairs
       WHERE from_code IS NOT NULL AND to_code IS NOT NULL""",
)
def unique_country_pairs(t: SharedTables) -> DataFrame:
    return alerts.unique_country_pairs(alerts.extract_trade_pairs(t.raw, t.book))


@query(
    "unique_origins",
    """SELECT DISTINCT trim(r.origin) AS country, m.m49 FROM raw r JOIN name_map m ON m.name = trim(r.origin)
       WHERE m.m49 IS NOT NULL""",
)
def unique_origins(t: SharedTables) -> DataFrame:
    return alerts.unique_origins(t.raw, t.book)


@query(
    "unique_followups",
    "SELECT DISTINCT name AS country, m49 FROM mapped WHERE role = 'followUp' AND m49 IS NOT NULL",
)
def unique_followups(t: SharedTables) -> DataFrame:
    return alerts.unique_followups(t.raw, t.book)


@query(
    "pair_hs_codes",
    """SELECT from_country, from_code, to_country, to_code, array_to_string(codes, ';') AS hs_codes, hs_code_count
       FROM pair_codes""",
)
def pair_hs_codes(t: SharedTables) -> DataFrame:
    return alerts.pair_hs_codes(alerts.extract_trade_pairs(t.raw, t.book))


@query(
    "country_pair_summary",
    """SELECT count(*) AS country_pairs, CAST(sum(hs_code_count) AS BIGINT) AS hs_codes_over_pairs,
       (SELECT count(DISTINCT trim(r.origin)) FROM raw r JOIN name_map m ON m.name = trim(r.origin)
        WHERE m.m49 IS NOT NULL) AS from_countries,
       (SELECT count(DISTINCT name) FROM mapped WHERE role = 'followUp' AND m49 IS NOT NULL) AS to_countries
       FROM pair_codes""",
)
def country_pair_summary(t: SharedTables) -> DataFrame:
    return alerts.country_pair_summary(t.raw, t.book)


@query(
    "unmapped_countries",
    """SELECT DISTINCT CASE WHEN m.role = 'origin' THEN 'origin' ELSE 'destination' END AS kind, m.name FROM mapped m
       WHERE m.name <> '' AND m.m49 IS NULL AND (m.role = 'origin' OR m.row_id IN (SELECT row_id FROM origins))""",
)
def unmapped_countries(t: SharedTables) -> DataFrame:
    return alerts.unmapped_countries(t.raw, t.book)


@query(
    "notification_corridor_join",
    f"""SELECT reference, {_KEY}, period FROM touched JOIN (SELECT DISTINCT {_KEY} FROM corridor_events)
        USING ({_KEY})""",
)
def notification_corridor_join(t: SharedTables) -> DataFrame:
    joined = hazard.notification_corridor_join(t.hazard.notifications, t.hazard.events)
    return joined.select("reference", *CORRIDOR, "period")


@query("hazard_category_map", "SELECT reference, hazard_category FROM category_map")
def hazard_category_map(t: SharedTables) -> DataFrame:
    return alerts.hazard_category_map(t.events)


@query(
    "unique_corridors",
    f"SELECT {_KEY}, commodity_name, origin_country, destination_country FROM corridor_base",
)
def unique_corridors(t: SharedTables) -> DataFrame:
    return alerts.unique_corridors(t.events)


@query("role_counts", f"SELECT {_KEY}, {_ROLES}, {_ROLE_COUNTS}, is_active_destination FROM corridor_base")
def role_counts(t: SharedTables) -> DataFrame:
    return alerts.role_counts(t.events)


@query(
    "hazard_summary",
    """SELECT (SELECT count(*) FROM raw) AS total_notifications, count(*) AS total_corridors,
       count(*) FILTER (WHERE active) AS active_corridors,
       (SELECT count(*) FROM raw WHERE row_id NOT IN (SELECT row_id FROM origins)) AS notifications_without_origin,
       (SELECT count(*) FROM raw WHERE row_id IN (SELECT row_id FROM origins)
        AND row_id NOT IN (SELECT row_id FROM destinations)) AS notifications_without_destination,
       (SELECT count(*) FROM origins o JOIN destinations d ON o.row_id = d.row_id AND o.origin_m49 = d.destination_m49) AS self_trade_pairs_skipped,
       (SELECT count(*) FROM raw WHERE coalesce(nullif(trim(date), ''), nullif(trim(notification_date), '')) IS NOT NULL
        AND TRY_CAST(coalesce(nullif(trim(date), ''), nullif(trim(notification_date), '')) AS DATE) IS NULL) AS unread_dates,
       count(*) FILTER (WHERE list_contains(roles, 'notifier')) AS role_notifier,
       count(*) FILTER (WHERE list_contains(roles, 'distribution')) AS role_distribution,
       count(*) FILTER (WHERE list_contains(roles, 'followUp')) AS "role_followUp",
       count(*) FILTER (WHERE list_contains(roles, 'attention')) AS role_attention,
       count(DISTINCT origin_m49) AS unique_origins, count(DISTINCT destination_m49) AS unique_destinations,
       count(DISTINCT CASE WHEN commodity_hs <> '' THEN commodity_hs END) AS unique_commodities,
       (SELECT count(DISTINCT name) FROM mapped WHERE name <> '' AND m49 IS NULL AND role = 'origin') AS unmapped_origins,
       (SELECT count(DISTINCT name) FROM mapped WHERE name <> '' AND m49 IS NULL AND role <> 'origin'
        AND row_id IN (SELECT row_id FROM origins)) AS unmapped_destinations
       FROM corridor_events""",
)
def hazard_summary(t: SharedTables) -> DataFrame:
    return alerts.hazard_summary(t.raw, t.book)


@query("latest_period", "SELECT cur_period AS current_period FROM cur")
def latest_period(t: SharedTables) -> DataFrame:
    return alerts.latest_period(t.notifications)


@query(
    "severity_weight",
    """SELECT n.classification, n.risk_decision, cw.w * dw.w AS severity, count(*) AS rows FROM notif n
       JOIN class_weights cw ON cw.kind = n.classification JOIN decision_weights dw ON dw.kind = n.risk_decision
       GROUP BY 1, 2, 3""",
    "severity",
)
def severity_weight(t: SharedTables) -> DataFrame:
    rated = hazard.with_severity(t.notifications)
    return rated.groupBy("classification", "risk_decision", "severity").agg(F.count("*").alias("rows"))


@query("hazard_intensity", f"SELECT {_KEY}, his FROM metrics", "his")
def hazard_intensity(t: SharedTables) -> DataFrame:
    return t.metrics.select(*CORRIDOR, "his")


@query(
    "half_life",
    """SELECT period, CASE WHEN a > 0 AND a < 1 THEN -ln(2.0) / ln(a) END AS half_life
       FROM (SELECT period, (period % 100) / 10.0 AS a FROM (SELECT DISTINCT period FROM cleaned))""",
    "half_life",
)
def half_life(t: SharedTables) -> DataFrame:
    """A decay per notification month: the month over ten."""
    months = t.raw.select(to_period_yyyymm(F.col("date"), F.col("notification_date")).alias("period")).distinct()
    return months.withColumn("half_life", formulas.half_life((F.col("period") % 100) / 10.0))


@query("hazard_diversity", f"SELECT {_KEY}, hdi FROM metrics", "hdi")
def hazard_diversity(t: SharedTables) -> DataFrame:
    return t.metrics.select(*CORRIDOR, "hdi")


@query("hazard_breakdown", f"SELECT {_KEY}, {FAMILY_LIST} FROM metrics", " ".join(FAMILIES))
def hazard_breakdown(t: SharedTables) -> DataFrame:
    return t.metrics.select(*CORRIDOR, *hazard.HAZARD_COLUMNS)


_METRICS = f"""{_KEY}, commodity_name, origin_country, destination_country, {_ROLES}, {_ROLE_COUNTS},
    is_active_destination, his, hdi, notification_count, severity_total, {FAMILY_LIST}"""
_METRIC_DOUBLES = "his hdi severity_total " + " ".join(FAMILIES)


@query("run_hazard", f"SELECT {_METRICS} FROM metrics", _METRIC_DOUBLES)
def run_hazard(t: SharedTables) -> DataFrame:
    return t.metrics.drop("event_count")


@query(
    "corridor_hazard",
    f"""SELECT {_KEY}, sum(severity * pow(0.8, greatest(2001 * 12 + 12 - (period // 100) * 12 - period % 100, 0))) AS his,
        count(*) AS notification_count, sum(severity) AS severity_total
        FROM touched JOIN corridor_base USING ({_KEY}) GROUP BY 1, 2, 3
        UNION ALL SELECT {_KEY}, 0.0, 0, 0.0 FROM corridor_base ANTI JOIN touched USING ({_KEY})""",
    "his severity_total",
)
def corridor_hazard(t: SharedTables) -> DataFrame:
    """At a chosen period and decay, with one hazard type per notification."""
    table = hazard.corridor_hazard(
        alerts.corridor_base(t.hazard.events), t.hazard.notifications, F.lit(200112), alpha=0.8
    )
    return table.select(*CORRIDOR, "his", "notification_count", "severity_total")


@query(
    "hazard_mix_pct",
    f"""SELECT {_KEY}, {", ".join(f"CASE WHEN tot > 0 THEN {f} / tot * 100 END AS {f}_pct" for f in FAMILIES)}
        FROM (SELECT *, {" + ".join(FAMILIES)} AS tot FROM metrics)""",
    " ".join(f"{f}_pct" for f in FAMILIES),
)
def hazard_mix_pct(t: SharedTables) -> DataFrame:
    return hazard.hazard_mix_pct(t.metrics)


@query(
    "detection_gap",
    f"""SELECT commodity_hs, destination_m49, origin_m49, period, coalesce(n.alerts, 0) AS alerts,
        CAST(coalesce(a.all_alerts, 0) AS BIGINT) AS all_alerts,
        CASE WHEN total_imports_kg > 0 THEN bilateral_import_kg / total_imports_kg END
          - coalesce(n.alerts, 0) / a.all_alerts AS dgi
        FROM (SELECT * REPLACE (CAST(CAST(commodity_hs AS BIGINT) AS VARCHAR) AS commodity_hs) FROM lanes) l
        LEFT JOIN (SELECT {_KEY}, count(*) AS alerts FROM touched GROUP BY 1, 2, 3) n USING ({_KEY})
        LEFT JOIN (SELECT commodity_hs, destination_m49, count(*) AS all_alerts FROM touched GROUP BY 1, 2) a
        USING (commodity_hs, destination_m49)""",
    "dgi",
)
def detection_gap(t: SharedTables) -> DataFrame:
    lanes = dependency.corridor_dependency(t.trade, None, normalise=True)
    gaps = hazard.detection_gap(lanes, t.hazard.notifications)
    return gaps.select(*CORRIDOR, "period", "alerts", "all_alerts", "dgi")


@query(
    "hazard_types",
    """SELECT h.index, h.id, h.label, count(n.hazard_type) AS notifications FROM (VALUES
       (0, 'biological', 'Biological'), (1, 'chem_pesticides', 'Chemical - Pesticides'),
       (2, 'chem_heavy_metals', 'Chemical - Heavy Metals'), (3, 'chem_mycotoxins', 'Chemical - Mycotoxins'),
       (4, 'chem_other', 'Chemical - Other'), (5, 'regulatory', 'Regulatory')) AS h(index, id, label)
       LEFT JOIN notif n ON n.hazard_type = h.id GROUP BY 1, 2, 3""",
)
def hazard_types(t: SharedTables) -> DataFrame:
    counts = t.notifications.groupBy(F.col("hazard_type").alias("id")).agg(F.count("*").alias("notifications"))
    joined = dimensions.hazard_types(t.spark).join(counts, "id", "left")
    return joined.withColumn("notifications", F.coalesce("notifications", F.lit(0)))


@query(
    "readiness_counts",
    """SELECT count(*) AS notifications, max(period) AS current_period, (SELECT count(*) FROM metrics) AS corridor_metrics,
       (SELECT count(*) FROM trade) AS trade_rows FROM notif""",
)
def readiness_counts(t: SharedTables) -> DataFrame:
    return explore.readiness_counts(t.metrics, t.hazard.notifications, t.trade)


# ------------------------------------------------------------ enriched and scored

_TRADE_DOUBLES = (
    "bilateral_import_kg total_imports_kg ds_prime idr ocs bdi ssr hhi sci sci_half mtd unit_value z_uv delta_hhi pcc crs"
)
_TRADE_LIST = ", ".join(_TRADE_DOUBLES.split())


@query(
    "corridor_enrich",
    f"SELECT {_KEY}, his, hdi, {_TRADE_LIST}, dq_flag FROM enriched",
    "his hdi " + _TRADE_DOUBLES,
)
def corridor_enrich(t: SharedTables) -> DataFrame:
    return t.enriched.select(*CORRIDOR, "his", "hdi", *_TRADE_DOUBLES.split(), "dq_flag")


_NORMS = "sci_norm his_norm crs_norm"


@query(
    "normalise_corridors",
    f"SELECT {_KEY}, sci_norm, his_norm, crs_norm FROM normed",
    _NORMS,
)
def normalise_corridors(t: SharedTables) -> DataFrame:
    return t.scored.select(*CORRIDOR, *_NORMS.split())


@query(
    "composite_scores",
    f"SELECT {_KEY}, cvs, cvs_hazard_only, cvs_missing_inputs FROM scored",
    "cvs cvs_hazard_only",
)
def composite_scores(t: SharedTables) -> DataFrame:
    return t.scored.select(*CORRIDOR, "cvs", "cvs_hazard_only", "cvs_missing_inputs")


@query(
    "run_scoring",
    f"SELECT {_KEY}, origin_country, destination_country, his, cvs FROM scored",
    "his cvs",
)
def run_scoring(t: SharedTables) -> DataFrame:
    ranked = runs.run_scoring(t.enriched)
    return ranked.select(*CORRIDOR, "origin_country", "destination_country", "his", "cvs")


def _scored_with(t: SharedTables, **settings) -> DataFrame:
    return scoring.score(materialise(t.enriched), scoring.ScoringConfig(**settings)).select(*CORRIDOR, "cvs")


@query(
    "score_weighted_linear",
    f"""SELECT {_KEY}, CASE WHEN sci_norm IS NOT NULL AND crs_norm IS NOT NULL
        THEN (sci_norm + crs_norm + his_norm) * 0.2 END AS cvs FROM normed""",
    "cvs",
)
def score_weighted_linear(t: SharedTables) -> DataFrame:
    return _scored_with(t, composition="weighted_linear")


@query(
    "score_geometric_mean",
    f"""SELECT {_KEY}, pow(sci_norm, 0.4) * pow(crs_norm, 0.4) * pow(his_norm, 0.2) AS score FROM normed""",
    "score",
)
def score_geometric_mean(t: SharedTables) -> DataFrame:
    values = [F.col("sci_norm"), F.col("crs_norm"), F.col("his_norm")]
    score = formulas.score_geometric_mean(values, [0.4, 0.4, 0.2])
    return t.scored.select(*CORRIDOR, score.alias("score"))


@query(
    "score_hybrid",
    f"""SELECT {_KEY}, CASE WHEN sci_norm IS NOT NULL AND crs_norm IS NOT NULL
        THEN sci_norm * crs_norm * (1 + 2.0 * his_norm) / 3.5 END AS cvs FROM normed""",
    "cvs",
)
def score_hybrid(t: SharedTables) -> DataFrame:
    return _scored_with(t, w_hazard=2.0, w_price=0.5, w_supply_chain=0.0)


@query(
    "scoring_config",
    f"""SELECT {_KEY}, sum(severity * pow(0.5, greatest((cur_period // 100) * 12 + cur_period % 100
        - (period // 100) * 12 - period % 100, 0))) AS his FROM touched JOIN corridor_base USING ({_KEY}) CROSS JOIN cur
        GROUP BY 1, 2, 3""",
    "his",
)
def scoring_config(t: SharedTables) -> DataFrame:
    """The decay set in the configuration reaches the hazard intensity."""
    config = scoring.ScoringConfig(alpha=0.5)
    table = runs.run_hazard(t.raw, t.book, config.alpha).metrics
    return table.where("notification_count > 0").select(*CORRIDOR, "his")


@query(
    "equal_weights",
    f"SELECT {_KEY}, (his + hdi + severity_total + notification_count) / 4 AS mean_signal FROM metrics",
    "mean_signal",
)
def equal_weights(t: SharedTables) -> DataFrame:
    values = [F.col(c) for c in ("his", "hdi", "severity_total", "notification_count")]
    weighted = formulas.score_weighted_linear(values, formulas.equal_weights(4))
    return t.metrics.select(*CORRIDOR, weighted.alias("mean_signal"))


@query(
    "rank_scored",
    f"""SELECT {_KEY}, cvs FROM scored ORDER BY stable(cvs) DESC NULLS LAST, {_KEY}""",
    "cvs",
)
def rank_scored(t: SharedTables) -> DataFrame:
    return scoring.rank_scored(t.scored).select(*CORRIDOR, "cvs")


@query(
    "corridor_full_profile",
    f"""SELECT {_METRICS}, {_TRADE_LIST}, dq_flag, sci_norm, his_norm, crs_norm, cvs, cvs_hazard_only, cvs_missing_inputs,
        CASE WHEN total_imports_kg > 0 THEN bilateral_import_kg / total_imports_kg END
          - s.notification_count / a.all_alerts AS dgi
        FROM scored s LEFT JOIN (SELECT commodity_hs, destination_m49, count(*) AS all_alerts FROM touched GROUP BY 1, 2) a
        USING (commodity_hs, destination_m49)""",
    f"{_METRIC_DOUBLES} {_TRADE_DOUBLES} {_NORMS} cvs cvs_hazard_only dgi",
)
def corridor_full_profile(t: SharedTables) -> DataFrame:
    profile = runs.run_scoring(runs.with_detection_gap(t.enriched, t.hazard.notifications))
    return profile.drop("event_count")


# ------------------------------------------------------- documented follow-up views


@query(
    "cvs_band",
    f"""SELECT {_KEY}, CASE WHEN stable(cvs) < 0.2 THEN 'low' WHEN stable(cvs) < 0.4 THEN 'moderate'
        WHEN stable(cvs) < 0.6 THEN 'elevated' WHEN stable(cvs) < 0.8 THEN 'high'
        WHEN cvs IS NOT NULL THEN 'critical' END AS cvs_band FROM scored""",
)
def cvs_band(t: SharedTables) -> DataFrame:
    return runs.cvs_band(t.scored).select(*CORRIDOR, "cvs_band")


@query("alert_corridors", f"SELECT {_KEY}, cvs FROM scored WHERE stable(cvs) >= 0.3", "cvs")
def alert_corridors(t: SharedTables) -> DataFrame:
    return runs.alert_corridors(t.scored, 0.3).select(*CORRIDOR, "cvs")


@query(
    "structural_scan",
    """SELECT d.hs AS commodity_hs, d.destination_m49, d.origin_m49, d.period, d.sci_half, c.crs FROM (
         SELECT *, CAST(CAST(commodity_hs AS BIGINT) AS VARCHAR) AS hs FROM dep) d
       JOIN crs_short c ON c.commodity_hs = d.hs AND c.country_m49 = d.destination_m49 AND c.period = d.period
       WHERE sci_half >= 0.02 AND crs >= 0.5 AND NOT EXISTS (SELECT 1 FROM corridor_events e
         WHERE e.commodity_hs = d.hs AND e.destination_m49 = d.destination_m49 AND e.origin_m49 = d.origin_m49)""",
    "sci_half crs",
)
def structural_scan(t: SharedTables) -> DataFrame:
    lanes = dependency.corridor_dependency(t.trade, t.renamed(t.production), normalise=True)
    ranks = consumption.consumption_rank_score(consumption.per_capita_consumption(t.renamed(t.balance)))
    demand = ranks.select("commodity_hs", F.col("country_m49").alias("destination_m49"), "period", "crs")
    structure = lanes.join(demand, ["commodity_hs", "destination_m49", "period"])
    found = runs.structural_scan(structure, t.events, least_sci=0.02, least_crs=0.5)
    return found.select(*CORRIDOR, "period", "sci_half", "crs")


_INDICATORS = f"""
SELECT v.commodity_hs, v.destination_m49, v.origin_m49, v.z_volume, u.z_uv, s.delta_ocs,
       coalesce(v.z_volume, 0) > 2 AS trade_surge, coalesce(u.z_uv, 0) < -2 AS price_drop,
       coalesce(s.delta_ocs, 0) > 0.05 AS dependency_shift, coalesce(r.a > r.b, false) AS rising_alerts
FROM (SELECT CAST(CAST(v.commodity_hs AS BIGINT) AS VARCHAR) AS commodity_hs, v.commodity_hs AS code, v.destination_m49,
             v.origin_m49, v.period, v.z_volume FROM volume v JOIN last_year ON v.period = last_period) v
JOIN uv u ON u.commodity_hs = v.code AND u.destination_m49 = v.destination_m49 AND u.origin_m49 = v.origin_m49 AND u.period = v.period
JOIN share_shift s ON s.commodity_hs = v.code AND s.destination_m49 = v.destination_m49 AND s.origin_m49 = v.origin_m49 AND s.period = v.period
LEFT JOIN (SELECT {_KEY}, count(*) FILTER (WHERE age < 12) AS a, count(*) FILTER (WHERE age BETWEEN 12 AND 23) AS b
  FROM (SELECT *, (cur_period // 100) * 12 + cur_period % 100 - (period // 100) * 12 - period % 100 AS age
        FROM touched CROSS JOIN cur) GROUP BY 1, 2, 3) r
ON r.commodity_hs = v.commodity_hs AND r.destination_m49 = v.destination_m49 AND r.origin_m49 = v.origin_m49"""


def _indicators(t: SharedTables) -> DataFrame:
    return runs.leading_indicators(t.cube, t.hazard.notifications)


@query("leading_indicators", _INDICATORS, "z_volume z_uv delta_ocs")
def leading_indicators(t: SharedTables) -> DataFrame:
    return _indicators(t).select(
        *CORRIDOR, "z_volume", "z_uv", "delta_ocs", "trade_surge", "price_drop", "dependency_shift", "rising_alerts"
    )


@query(
    "convergent_signal",
    f"""SELECT {_KEY}, CAST(trade_surge AS INTEGER) + CAST(price_drop AS INTEGER) + CAST(rising_alerts AS INTEGER) AS signals,
        trade_surge AND price_drop AND rising_alerts AS convergent FROM ({_INDICATORS})""",
)
def convergent_signal(t: SharedTables) -> DataFrame:
    return runs.convergent_signal(_indicators(t)).select(*CORRIDOR, "signals", "convergent")


@query(
    "inspection_priority",
    f"""SELECT {_KEY}, priority, cvs, his FROM (SELECT *, row_number() OVER (PARTITION BY destination_m49
        ORDER BY stable(cvs) DESC NULLS LAST, stable(his) DESC, {_KEY}) AS priority FROM scored) WHERE priority <= 10""",
    "cvs his",
)
def inspection_priority(t: SharedTables) -> DataFrame:
    return runs.inspection_priority(t.scored).select(*CORRIDOR, "priority", "cvs", "his")


@query(
    "weight_calibration",
    """SELECT 'mixed' AS input, round(ln(with_both * neither / (only_mixed * only_high)), 4) AS coefficient,
       CASE WHEN with_both * neither > only_mixed * only_high THEN 1.0::DOUBLE END AS weight,
       round(ln(only_high / neither), 4) AS intercept FROM (
         SELECT count(*) FILTER (hdi > 0 AND his >= level)::DOUBLE AS with_both, count(*) FILTER (hdi > 0 AND his < level)::DOUBLE AS only_mixed,
                count(*) FILTER (NOT hdi > 0 AND his >= level)::DOUBLE AS only_high,
                count(*) FILTER (NOT hdi > 0 AND his < level)::DOUBLE AS neither
         FROM metrics, (SELECT avg(his) AS level FROM metrics))""",
    "coefficient weight intercept",
)
def weight_calibration(t: SharedTables) -> DataFrame:
    """Do hazards of several kinds tell an intensity above the mean? One 0/1 input has a closed form to compare with."""
    level = t.metrics.agg(F.avg("his")).scalar()
    rows = t.metrics.select((F.col("hdi") > 0).cast("int").alias("mixed"), (F.col("his") >= level).cast("int").alias("high"))
    found = calibration.weight_calibration(rows, "high", ("mixed",))
    return found.select("input", F.round("coefficient", 4).alias("coefficient"), "weight", F.round("intercept", 4).alias("intercept"))
