"""Hazard signals per corridor."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tradelanes.functions import formulas, text
from tradelanes.functions.guards import zero_if_null
from tradelanes.functions.periods import months_between_yyyymm
from tradelanes.operators.alerts import CORRIDOR

DEFAULT_ALPHA = 0.90
HAZARD_COLUMNS = [kind for kind, _ in text.HAZARD_TYPES]


def with_severity(notifications: DataFrame) -> DataFrame:
    weight = formulas.severity_weight(F.col("classification"), F.col("risk_decision"))
    return notifications.withColumn("severity", weight)


def with_hazard_families(notifications: DataFrame, categories: DataFrame | None) -> DataFrame:
    """Add ``families``: every category a notification lists, else its single type."""
    single = F.array("hazard_type")
    if categories is None:
        return notifications.withColumn("families", single)
    listed = categories.select("reference", F.col("hazard_category").alias("_listed"))
    joined = notifications.join(listed, "reference", "left")
    families = text.parse_hazard_types(F.col("_listed"))
    chosen = F.when(F.size(families) > 0, families).otherwise(single)
    return joined.withColumn("families", chosen).drop("_listed")


def _shares() -> dict[str, Column]:
    """Fractional credit: each of k listed categories counts 1/k, repeats included."""
    return {kind: F.size(_listed_as(kind)) / F.size("families") for kind in HAZARD_COLUMNS}


def _listed_as(kind: str) -> Column:
    return F.filter("families", lambda family: family == kind)


def notification_corridor_join(notifications: DataFrame, corridors: DataFrame) -> DataFrame:
    """Notifications by the corridors they touch: one row per corridor and notification."""
    touched = notifications.withColumn("destination_m49", F.explode("affected")).drop("affected")
    keys = corridors.select(CORRIDOR).distinct()
    return touched.join(keys, CORRIDOR, "left_semi")


def corridor_hazard(
    corridors: DataFrame,
    notifications: DataFrame,
    current_period: Column,
    categories: DataFrame | None = None,
    alpha: float = DEFAULT_ALPHA,
) -> DataFrame:
    """Intensity, diversity, counts and category credit for every corridor given.

    """
    credited = with_hazard_families(notifications, categories).withColumns(_shares())
    return corridor_signals(corridors, credited, current_period, alpha)


def with_listed_credit(groups: DataFrame) -> DataFrame:
    """Credit of each family for :func:`alerts.notifications_with_credit`: from the categories its reference lists first, else its own type.

    A reference has one row per origin at most, which bounds the window.
    """
    order = Window.partitionBy("reference", "_row").orderBy("first")
    listed = groups.withColumn("_listed", F.first("credit").over(order))
    given = F.when(F.col("reference") != "", F.col("_listed"))
    shares = {
        kind: F.coalesce(F.get(given, i), (F.col("hazard_type") == kind).cast("double"))
        for i, kind in enumerate(HAZARD_COLUMNS)
    }
    return listed.withColumns(shares).drop("_listed")


def corridor_signals(
    corridors: DataFrame, credited: DataFrame, current_period: Column, alpha: float = DEFAULT_ALPHA
) -> DataFrame:
    """As :func:`corridor_hazard`, of notifications that carry their credit to each family.

    Notifications are reduced to one row per corridor with map-side partial
    sums before they meet the corridors, so a corridor with a large part of
    all notifications shuffles as little as any other.
    """
    months = months_between_yyyymm(current_period, F.col("period"))
    decayed = formulas.decayed(F.col("severity"), alpha, months)
    weighed = with_severity(credited).withColumn("_decayed", decayed)
    touched = weighed.withColumn("destination_m49", F.explode("affected"))
    sums = touched.groupBy(CORRIDOR).agg(
        F.sum("_decayed").alias("his"),
        F.count("*").alias("notification_count"),
        F.sum("severity").alias("severity_total"),
        *[F.sum(kind).alias(kind) for kind in HAZARD_COLUMNS],
    )
    joined = corridors.join(sums, CORRIDOR, "left")
    filled = joined.withColumns(
        {
            "his": zero_if_null(F.col("his")),
            "notification_count": F.coalesce("notification_count", F.lit(0)),
            "severity_total": zero_if_null(F.col("severity_total")),
            **{kind: zero_if_null(F.col(kind)) for kind in HAZARD_COLUMNS},
        }
    )
    return filled.withColumn(
        "hdi", formulas.normalised_entropy([F.col(kind) for kind in HAZARD_COLUMNS])
    )


def notification_counts(notifications: DataFrame) -> DataFrame:
    """Notifications per corridor."""
    return (
        notifications.select("commodity_hs", "origin_m49", F.explode("affected").alias("destination_m49"))
        .groupBy(CORRIDOR)
        .agg(F.count("*").alias("alerts"))
    )


def detection_gap(dependency: DataFrame, notifications: DataFrame) -> DataFrame:
    """Trade share minus notification share for each row of ``dependency``.

    ``dependency`` carries bilateral and total imports. Undefined where the
    destination has no notification on the commodity, or no imports.
    """
    counts = notification_counts(notifications)
    totals = counts.groupBy("commodity_hs", "destination_m49").agg(F.sum("alerts").alias("all_alerts"))
    joined = dependency.join(counts, CORRIDOR, "left").join(
        totals, ["commodity_hs", "destination_m49"], "left"
    )
    alerts = F.coalesce("alerts", F.lit(0))
    gap = formulas.detection_gap(
        F.col("bilateral_import_kg"), F.col("total_imports_kg"), alerts, F.col("all_alerts")
    )
    return joined.withColumns(
        {"alerts": alerts, "all_alerts": F.coalesce("all_alerts", F.lit(0)), "dgi": gap}
    )


def hazard_mix_pct(metrics: DataFrame) -> DataFrame:
    """Each category's percentage of a corridor's categorised notifications."""
    whole = sum((F.col(k) for k in HAZARD_COLUMNS[1:]), F.col(HAZARD_COLUMNS[0]))
    return metrics.select(
        *CORRIDOR,
        *[F.when(whole > 0, F.col(k) / whole * 100).alias(f"{k}_pct") for k in HAZARD_COLUMNS],
    )
