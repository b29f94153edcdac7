"""End-to-end runs: hazard, network, scoring and the full corridor profile."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tradelanes.dimensions import CountryBook
from tradelanes.functions.formulas import vulnerability_band
from tradelanes.functions.guards import stable, zero_if_null
from tradelanes.functions.periods import months_between_yyyymm
from tradelanes.operators import alerts, consumption, dependency, flows, hazard, network, scoring, trade_flow
from tradelanes.operators.alerts import CORRIDOR
from tradelanes.operators.scoring import ScoringConfig
from tradelanes.session import materialise


@dataclass(frozen=True)
class HazardRun:
    events: DataFrame
    notifications: DataFrame
    current_period: DataFrame
    metrics: DataFrame


def run_hazard(raw: DataFrame, book: CountryBook, alpha: float = hazard.DEFAULT_ALPHA) -> HazardRun:
    """Raw notifications to hazard metrics of every corridor.

    Notifications read are written once: the events of the corridor table
    are paired from them, the notifications grouped. So are the notifications,
    which give both the current period and the sums.
    """
    parsed = materialise(alerts.read_notifications(raw, book))
    events = alerts.events_of(parsed)
    groups = materialise(alerts.notifications_with_credit(parsed, book))
    notifications = alerts.usable(groups).select(
        "reference", "commodity_hs", "origin_m49", "affected", "classification", "risk_decision", "hazard_type", "period"
    )
    period = alerts.latest_period(notifications)
    credited = alerts.usable(hazard.with_listed_credit(groups))
    metrics = hazard.corridor_signals(alerts.corridor_base(events), credited, period.scalar(), alpha)
    return HazardRun(events, notifications, period, metrics)


def run_network(metrics: DataFrame) -> DataFrame:
    """Exposure edges from hazard alone: severity stands in for dependency, trade weight is 0."""
    proxied = metrics.drop("bilateral_import_kg").withColumn("bdi", F.col("severity_total"))
    return network.exposure_edges(proxied)


def _latest(table: DataFrame, latest: Column) -> DataFrame:
    return table.where(F.col("period") == latest).drop("period")


def with_dependency(metrics: DataFrame, cube: DataFrame, production: DataFrame | None = None) -> DataFrame:
    """Attach what a corridor's destination takes from its origin and how much it depends on it, at the latest period."""
    lanes = dependency.with_production(flows.lanes(cube), production)
    dep = _latest(dependency.dependency_of(lanes), flows.last_period(cube)).select(
        *CORRIDOR, "bilateral_import_kg", "total_imports_kg", "ds_prime", "idr", "ocs", "bdi", "ssr", "hhi",
        "sci", "sci_half", "dq_flag",
    )
    return metrics.join(dep, CORRIDOR, "left")


def with_anomalies(metrics: DataFrame, cube: DataFrame) -> DataFrame:
    """Attach price, volume, mirror and concentration anomalies, at the latest period."""
    return metrics.join(trade_flow.trade_anomalies(cube).drop("period"), CORRIDOR, "left")


def with_demand(metrics: DataFrame, cube: DataFrame, balance: DataFrame | None) -> DataFrame:
    """Attach consumption a head and its rank, at the latest period; NULL without ``balance``."""
    if balance is None:
        return metrics.withColumns({"pcc": F.lit(None).cast("double"), "crs": F.lit(None).cast("double")})
    ranks = consumption.consumption_rank_score(consumption.per_capita_consumption(balance))
    demand = _latest(ranks, flows.last_period(cube)).select(
        "commodity_hs", F.col("country_m49").alias("destination_m49"), "pcc", "crs"
    )
    return metrics.join(demand, ["commodity_hs", "destination_m49"], "left")


def corridor_enrich(
    metrics: DataFrame,
    cube: DataFrame,
    production: DataFrame | None = None,
    balance: DataFrame | None = None,
) -> DataFrame:
    """Attach dependency, consumption and trade-flow metrics to hazard corridors.

    The trade side is taken at its latest period. ``cube`` uses the
    commodity codes of the notifications and is materialised by the caller.
    An outer join stays in a plan even if nothing it brings is read, so a query
    that needs one part only attaches just that.
    """
    return with_demand(with_anomalies(with_dependency(metrics, cube, production), cube), cube, balance)


def with_detection_gap(enriched: DataFrame, notifications: DataFrame) -> DataFrame:
    return hazard.detection_gap(enriched, notifications).drop("alerts", "all_alerts")


def run_scoring(corridors: DataFrame, config: ScoringConfig = ScoringConfig()) -> DataFrame:
    """Normalise, compose and order. Materialises its input, which ranks read several times."""
    return scoring.rank_scored(scoring.score(materialise(corridors), config))


def corridor_full_profile(
    raw: DataFrame,
    trade: DataFrame,
    book: CountryBook,
    production: DataFrame | None = None,
    balance: DataFrame | None = None,
    config: ScoringConfig = ScoringConfig(),
) -> DataFrame:
    """One row per corridor with hazard, dependency, trade flow, demand, score and roles."""
    run = run_hazard(raw, book, config.alpha)
    cube = materialise(flows.trade_cube(trade, normalise=True))
    enriched = corridor_enrich(run.metrics, cube, production, balance)
    return run_scoring(with_detection_gap(enriched, run.notifications), config)


# --------------------------------------------------- documented follow-up views


def cvs_band(scored: DataFrame) -> DataFrame:
    return scored.withColumn("cvs_band", vulnerability_band(stable(F.col("cvs"))))


def alert_corridors(scored: DataFrame, least: float = 0.6) -> DataFrame:
    return scored.where(stable(F.col("cvs")) >= least)


def structural_scan(
    structure: DataFrame, events: DataFrame, least_sci: float = 0.5, least_crs: float = 0.5
) -> DataFrame:
    """Lanes high in criticality and demand that no notification ever named."""
    high = structure.where((stable(F.col("sci_half")) >= least_sci) & (stable(F.col("crs")) >= least_crs))
    return high.join(events.select(CORRIDOR).distinct(), CORRIDOR, "left_anti")


def rising_alerts(notifications: DataFrame) -> DataFrame:
    """Notifications per corridor in the latest twelve months and the twelve before."""
    latest = alerts.latest_period(notifications).scalar()
    age = months_between_yyyymm(latest, F.col("period"))
    touched = notifications.select(
        "commodity_hs", "origin_m49", age.alias("age"), F.explode("affected").alias("destination_m49")
    )
    return touched.groupBy(CORRIDOR).agg(
        F.count_if(F.col("age") < 12).alias("alerts_last_year"),
        F.count_if((F.col("age") >= 12) & (F.col("age") < 24)).alias("alerts_year_before"),
    )


def leading_indicators(cube: DataFrame, notifications: DataFrame, window: int = 5) -> DataFrame:
    """Trade surge, price drop, dependency shift and rising alerts per lane at the latest period."""
    latest = flows.last_period(cube)
    lanes = flows.lanes(cube)
    volume = _latest(trade_flow.volume_anomaly(lanes, window), latest).select(*CORRIDOR, "z_volume")
    price = _latest(trade_flow.unit_value_zscore(lanes.where(F.col("period") == latest)), latest).select(
        *CORRIDOR, "z_uv"
    )
    share = _latest(trade_flow.delta_ocs(lanes, flows.trade_periods(cube)), latest).select(*CORRIDOR, "delta_ocs")
    joined = volume.join(price, CORRIDOR).join(share, CORRIDOR).join(rising_alerts(notifications), CORRIDOR, "left")
    return joined.withColumns(
        {
            "trade_surge": zero_if_null(F.col("z_volume")) > 2,
            "price_drop": zero_if_null(F.col("z_uv")) < -2,
            "dependency_shift": zero_if_null(F.col("delta_ocs")) > 0.05,
            "rising_alerts": F.coalesce(F.col("alerts_last_year") > F.col("alerts_year_before"), F.lit(False)),
        }
    )


def convergent_signal(indicators: DataFrame) -> DataFrame:
    """Surge, price drop and rising alerts at the same time."""
    flags = ["trade_surge", "price_drop", "rising_alerts"]
    points = sum((F.col(f).cast("int") for f in flags[1:]), F.col(flags[0]).cast("int"))
    return indicators.withColumn("signals", points).withColumn("convergent", F.col("signals") == len(flags))


def inspection_priority(scored: DataFrame, n: int = 10) -> DataFrame:
    """The corridors each destination should look at first: by score, then by hazard."""
    order = Window.partitionBy("destination_m49").orderBy(
        stable(F.col("cvs")).desc_nulls_last(), stable(F.col("his")).desc(), *CORRIDOR
    )
    return scored.withColumn("priority", F.row_number().over(order)).where(F.col("priority") <= n)
