"""Consumption per head, its rank among commodities, and its stability."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tradelanes.functions import formulas
from tradelanes.functions.guards import stable


def per_capita_consumption(balance: DataFrame) -> DataFrame:
    pcc = formulas.per_capita_consumption(F.col("domestic_supply_food_kg"), F.col("population"))
    return balance.withColumn("pcc", pcc)


def consumption_rank_score(pcc: DataFrame) -> DataFrame:
    """Rank of each commodity within a country and period; rows without PCC are not ranked.

    A window holds the commodities of one country and period, which the
    nomenclature bounds.
    """
    ranked = pcc.where(F.col("pcc").isNotNull())
    group = Window.partitionBy("country_m49", "period")
    order = group.orderBy(stable(F.col("pcc")).desc(), "commodity_hs")
    return ranked.withColumn(
        "crs",
        formulas.rank_score(F.row_number().over(order), F.count("*").over(group)),
    )


def demand_variability(pcc: DataFrame, periods: int | None = None) -> DataFrame:
    """Coefficient of variation of a country's consumption of a commodity.

    With ``periods`` only that many latest periods of the table count.
    """
    rows = pcc.where(F.col("pcc").isNotNull())
    if periods is not None:
        latest = pcc.agg(F.max("period")).scalar()
        rows = rows.where(F.col("period") > latest - periods)
    stats = rows.groupBy("commodity_hs", "country_m49").agg(
        F.count("*").alias("n_periods"),
        F.avg("pcc").alias("pcc_mean"),
        F.stddev_samp("pcc").alias("pcc_std"),
    )
    cv = formulas.demand_variability(F.col("pcc_std"), F.col("pcc_mean"))
    return stats.withColumn("cv", cv)


def demand_inelasticity(pcc: DataFrame, periods: int | None = None) -> DataFrame:
    stats = demand_variability(pcc, periods)
    return stats.withColumn("dis", formulas.demand_inelasticity(F.col("cv")))
