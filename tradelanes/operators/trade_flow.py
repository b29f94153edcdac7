"""Price, volume, mirror and concentration anomalies of trade lanes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tradelanes.functions import formulas
from tradelanes.operators import flows
from tradelanes.operators.flows import LANE


def with_rolling(
    table: DataFrame, keys: list[str], order: str, value: str, window: int = 5
) -> DataFrame:
    """Mean and sample deviation of the ``window`` rows before each row.

    NULL until that many rows precede. A series has one row per period.
    """
    before = Window.partitionBy(*keys).orderBy(order).rowsBetween(-window, -1)
    full = F.count("*").over(before) == window
    return table.withColumns(
        {
            "rolling_mean": F.when(full, F.avg(value).over(before)),
            "rolling_std": F.when(full & F.lit(window >= 2), F.stddev_samp(value).over(before)),
        }
    )


def volume_anomaly(lanes: DataFrame, window: int = 5) -> DataFrame:
    """How far each lane's weight is from the periods before, in their deviations."""
    keys = [c for c in LANE if c != "period"]
    rolled = with_rolling(lanes, keys, "period", "bilateral_import_kg", window)
    z = formulas.zscore(F.col("bilateral_import_kg"), F.col("rolling_mean"), F.col("rolling_std"))
    return rolled.withColumn("z_volume", z)


def unit_value_zscore(lanes: DataFrame) -> DataFrame:
    """Unit value of each origin against the other origins of the same import."""
    priced = lanes.withColumn(
        "unit_value", formulas.unit_value(F.col("bilateral_import_usd"), F.col("bilateral_import_kg"))
    )
    peers = Window.partitionBy("commodity_hs", "destination_m49", "period")
    z = formulas.zscore(
        F.col("unit_value"), F.avg("unit_value").over(peers), F.stddev_samp("unit_value").over(peers)
    )
    return priced.withColumn("z_uv", z)


def peer_unit_values(lanes: DataFrame) -> DataFrame:
    """The (partner, unit value, z) rows of each import, gathered in partner order."""
    scored = unit_value_zscore(lanes)
    peer = F.struct("origin_m49", "unit_value", "z_uv")
    return scored.groupBy("commodity_hs", "destination_m49", "period").agg(
        F.sort_array(F.collect_list(peer)).alias("peers")
    )


def mirror_join(cube: DataFrame) -> DataFrame:
    """What the importer and the exporter report on the same lane.

    The two sides have their reporter and partner swapped. Instead of a self
    join, both are laid on the lane key and summed, so one shuffle of the cube
    does it; a side nobody reports is 0.
    """
    sides = F.array(
        F.struct(
            F.col("reporterCode").alias("destination_m49"),
            F.col("partnerCode").alias("origin_m49"),
            F.col("import_kg").alias("m_reported"),
            F.lit(0.0).alias("x_reported"),
            F.col("import_rows").alias("rows"),
        ),
        F.struct(
            F.col("partnerCode").alias("destination_m49"),
            F.col("reporterCode").alias("origin_m49"),
            F.lit(0.0).alias("m_reported"),
            F.col("export_kg").alias("x_reported"),
            F.col("export_rows").alias("rows"),
        ),
    )
    reported = F.filter(sides, lambda side: side["rows"] > 0)
    laid = cube.select("commodity_hs", "period", F.inline(reported))
    return laid.groupBy(LANE).agg(
        F.sum("m_reported").alias("m_reported"), F.sum("x_reported").alias("x_reported")
    )


def mirror_discrepancy(cube: DataFrame) -> DataFrame:
    sides = mirror_join(cube)
    mtd = formulas.mirror_discrepancy(F.col("m_reported"), F.col("x_reported"))
    return sides.withColumn("mtd", mtd)


def _shift(table: DataFrame, periods: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Add the value at the previous period of the whole trade table.

    Within a series the row before holds that value only if it is of exactly
    that period. A series has one row per period, which bounds the window.
    """
    series = Window.partitionBy(*keys).orderBy("period")
    dated = table.join(periods, "period", "left")
    adjacent = F.lag("period").over(series) == F.col("previous")
    return dated.withColumn(f"{value}_previous", F.when(adjacent, F.lag(value).over(series)))


def concentration_shifts(hhi: DataFrame, periods: DataFrame) -> DataFrame:
    """Supplier concentration of each importer against the previous trade period."""
    shifted = _shift(hhi, periods, ["commodity_hs", "destination_m49"], "hhi")
    return shifted.select(
        "commodity_hs",
        "destination_m49",
        "period",
        F.col("hhi").alias("hhi_current"),
        "hhi_previous",
        (F.col("hhi") - F.col("hhi_previous")).alias("delta_hhi"),
    )


def delta_ocs(lanes: DataFrame, periods: DataFrame) -> DataFrame:
    """Origin share of each lane against the previous trade period."""
    shares = lanes.withColumn(
        "ocs", formulas.origin_country_share(F.col("bilateral_import_kg"), F.col("total_imports_kg"))
    )
    shifted = _shift(shares, periods, [c for c in LANE if c != "period"], "ocs")
    return shifted.select(*LANE, "ocs", "ocs_previous", (F.col("ocs") - F.col("ocs_previous")).alias("delta_ocs"))


def importer_hhi(lanes: DataFrame) -> DataFrame:
    return lanes.select("commodity_hs", "destination_m49", "period", "hhi").distinct()


def trade_anomalies(cube: DataFrame) -> DataFrame:
    """Unit value, its z-score, mirror gap and concentration shift at the latest period.

    ``cube`` is read several times; pass a stored or materialised one. Lanes
    only the exporter reports have no unit value but do have a mirror gap.
    """
    latest = flows.last_period(cube)
    lanes = flows.lanes(cube)
    periods = flows.trade_periods(cube)
    prices = unit_value_zscore(lanes.where(F.col("period") == latest)).select(*LANE, "unit_value", "z_uv")
    mirror = mirror_discrepancy(cube.where(F.col("period") == latest))
    shifts = concentration_shifts(importer_hhi(lanes), periods).where(F.col("period") == latest)
    return (
        mirror.select(*LANE, "mtd")
        .join(prices, LANE, "left")
        .join(
            shifts.select("commodity_hs", "destination_m49", "period", "delta_hhi"),
            ["commodity_hs", "destination_m49", "period"],
            "left",
        )
    )


def anomaly_flags(anomalies: DataFrame) -> DataFrame:
    """Low and high price against peers, and a mirror gap worth checking."""
    z, gap = F.coalesce("z_uv", F.lit(0.0)), F.coalesce("mtd", F.lit(0.0))
    return anomalies.withColumns(
        {"low_price": z < -2, "high_price": z > 2, "mirror_alert": gap > 0.3}
    )
