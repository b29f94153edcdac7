"""Import dependency per lane and period."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tradelanes.functions import formulas
from tradelanes.functions.guards import zero_if_null
from tradelanes.operators import flows


def with_production(lanes: DataFrame, production: DataFrame | None) -> DataFrame:
    """Attach production and domestic supply; both are optional, production counts as 0."""
    if production is None:
        missing = F.lit(None).cast("double")
        return lanes.withColumns({"production_kg": F.lit(0.0), "domestic_supply_kg": missing})
    made = production.select(
        "commodity_hs",
        F.col("country_m49").alias("destination_m49"),
        "period",
        "production_kg",
        "domestic_supply_kg",
    )
    joined = lanes.join(made, ["commodity_hs", "destination_m49", "period"], "left")
    return joined.withColumn("production_kg", zero_if_null(F.col("production_kg")))


def dependency_of(lanes: DataFrame) -> DataFrame:
    """All dependency metrics from lanes that carry production.

    Lanes whose apparent supply is not positive keep their row, flagged, with
    every metric undefined.
    """
    supply = formulas.supply_balance(
        F.col("production_kg"), F.col("total_imports_kg"), F.col("total_exports_kg")
    )
    based = lanes.withColumn("ds_prime", supply)
    ds = F.col("ds_prime")
    known = ds.isNotNull()
    metrics = based.withColumns(
        {
            "idr": formulas.import_dependency_ratio(F.col("total_imports_kg"), ds),
            "ocs": F.when(
                known,
                formulas.origin_country_share(F.col("bilateral_import_kg"), F.col("total_imports_kg")),
            ),
            "bdi": formulas.bilateral_dependency(F.col("bilateral_import_kg"), ds),
            "ssr": F.when(
                known, formulas.self_sufficiency(F.col("production_kg"), F.col("domestic_supply_kg"), ds)
            ),
            "hhi": F.when(known, F.col("hhi")),
            "dq_flag": ~known,
        }
    )
    sci = formulas.supply_criticality(F.col("idr"), F.col("ocs"), F.col("hhi"))
    return metrics.withColumn("sci", sci).withColumn("sci_half", F.col("sci") / 2)


def corridor_dependency(
    trade: DataFrame, production: DataFrame | None = None, normalise: bool = False
) -> DataFrame:
    """Supply balance, IDR, OCS, BDI, SSR, HHI and SCI for every lane and period."""
    lanes = flows.lanes(flows.trade_cube(trade, normalise))
    return dependency_of(with_production(lanes, production))


def supply_flag(dependency: DataFrame) -> DataFrame:
    """The lanes a dependency analysis must leave out."""
    return dependency.where("dq_flag")
