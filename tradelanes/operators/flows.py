"""The trade cube: one row per commodity, reporter, partner and period.

Every dependency and trade-flow metric starts from sums over this key. One
aggregation with map-side partial sums reduces the trade rows to it; what
follows works on a table no larger than the corridors times the periods.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tradelanes.functions import text
from tradelanes.functions.guards import total

LANE = ["commodity_hs", "destination_m49", "origin_m49", "period"]


def filter_flow(
    trade: DataFrame,
    flow: str,
    commodity: str | None = None,
    reporter: int | None = None,
    partner: int | None = None,
    period: int | None = None,
) -> DataFrame:
    """Rows of one flow direction, narrowed by whichever of the keys are given."""
    rows = trade.where(F.col("flowCode") == flow)
    wanted = {"cmdCode": commodity, "reporterCode": reporter, "partnerCode": partner, "period": period}
    for name, value in wanted.items():
        if value is not None:
            rows = rows.where(F.col(name) == value)
    return rows


def trade_cube(trade: DataFrame, normalise: bool = False) -> DataFrame:
    """Weights and values of both flows by commodity, reporter, partner and period.

    With ``normalise`` commodity codes take the form notifications use. The
    codes are read after the trade rows are summed by them as given.
    """
    keys = ["commodity_hs", "reporterCode", "partnerCode", "period"]
    keyed = trade.select(
        F.col("cmdCode").alias("commodity_hs"), *keys[1:], "flowCode", "netWgt", "primaryValue"
    ).dropna(subset=keys[1:] if normalise else keys)
    imported = F.col("flowCode") == "M"
    exported = F.col("flowCode") == "X"
    cube = keyed.where(imported | exported).groupBy(keys).agg(
        F.sum(imported.cast("int")).alias("import_rows"),
        total(F.when(imported, F.col("netWgt"))).alias("import_kg"),
        total(F.when(imported, F.col("primaryValue"))).alias("import_usd"),
        F.sum(exported.cast("int")).alias("export_rows"),
        total(F.when(exported, F.col("netWgt"))).alias("export_kg"),
    )
    if not normalise:
        return cube
    measures = ["import_rows", "import_kg", "import_usd", "export_rows", "export_kg"]
    named = cube.withColumn("commodity_hs", text.normalise_hs(F.col("commodity_hs")))
    return named.groupBy(keys).agg(*[F.sum(name).alias(name) for name in measures])


def lanes(cube: DataFrame) -> DataFrame:
    """Import lanes with the totals of their destination.

    A destination has at most one row per partner country here, which bounds
    the window.
    """
    destination = Window.partitionBy("commodity_hs", "reporterCode", "period")
    whole = cube.withColumns(
        {
            "total_imports_kg": F.sum("import_kg").over(destination),
            "total_exports_kg": F.sum("export_kg").over(destination),
            "_squares": F.sum(F.col("import_kg") * F.col("import_kg")).over(destination),
        }
    )
    hhi = F.when(
        F.col("total_imports_kg") > 0,
        F.col("_squares") / (F.col("total_imports_kg") * F.col("total_imports_kg")),
    )
    return whole.where("import_rows > 0").select(
        "commodity_hs",
        F.col("reporterCode").alias("destination_m49"),
        F.col("partnerCode").alias("origin_m49"),
        "period",
        F.col("import_kg").alias("bilateral_import_kg"),
        F.col("import_usd").alias("bilateral_import_usd"),
        "total_imports_kg",
        "total_exports_kg",
        hhi.alias("hhi"),
    )


def total_imports(trade: DataFrame) -> DataFrame:
    return _flow_total(trade, "M", "destination_m49", "total_imports_kg")


def total_exports(trade: DataFrame) -> DataFrame:
    return _flow_total(trade, "X", "country_m49", "total_exports_kg")


def _flow_total(trade: DataFrame, flow: str, country: str, out: str) -> DataFrame:
    rows = filter_flow(trade, flow).dropna(subset=["cmdCode", "reporterCode", "period"])
    return rows.groupBy(
        F.col("cmdCode").alias("commodity_hs"), F.col("reporterCode").alias(country), "period"
    ).agg(total(F.col("netWgt")).alias(out))


def bilateral_imports(trade: DataFrame) -> DataFrame:
    rows = filter_flow(trade, "M").dropna(subset=["cmdCode", "reporterCode", "partnerCode", "period"])
    return rows.groupBy(
        F.col("cmdCode").alias("commodity_hs"),
        F.col("reporterCode").alias("destination_m49"),
        F.col("partnerCode").alias("origin_m49"),
        "period",
    ).agg(total(F.col("netWgt")).alias("bilateral_import_kg"))


def dependency_hhi(trade: DataFrame) -> DataFrame:
    """Supplier concentration (0-1) of each importer, commodity and period."""
    lane = bilateral_imports(trade)
    kg = F.col("bilateral_import_kg")
    sums = lane.groupBy("commodity_hs", "destination_m49", "period").agg(
        F.sum(kg).alias("total_imports_kg"), F.sum(kg * kg).alias("_squares")
    )
    whole = F.col("total_imports_kg")
    return sums.withColumn("hhi", F.when(whole > 0, F.col("_squares") / (whole * whole))).drop("_squares")


def trade_periods(cube: DataFrame) -> DataFrame:
    """Periods present in the whole trade table, each with the one before it."""
    # one row per period: bounded by the calendar
    order = Window.orderBy("period")
    return cube.select("period").distinct().withColumn("previous", F.lag("period").over(order))


def last_period(table: DataFrame) -> Column:
    return table.agg(F.max("period")).scalar()


def period_before(table: DataFrame, latest: Column) -> Column:
    return table.where(F.col("period") < latest).agg(F.max("period")).scalar()
