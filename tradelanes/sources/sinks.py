"""Writers."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from tradelanes.functions.guards import null_out_nonfinite


def write_csv(df: DataFrame, path: str, mode: str = "overwrite", compression: str = "none") -> str:
    """Texts are written as they are: Spark would strip blanks at their ends."""
    writer = null_out_nonfinite(df).write.mode(mode).option("header", True).option("escape", '"')
    for side in ("Leading", "Trailing"):
        writer = writer.option(f"ignore{side}WhiteSpace", False)
    writer.option("emptyValue", "").option("compression", compression).csv(path)
    return path


def write_json(df: DataFrame, path: str, mode: str = "overwrite", compression: str = "none") -> str:
    null_out_nonfinite(df).write.mode(mode).option("compression", compression).json(path)
    return path


def write_tables(tables: dict[str, DataFrame], folder: str, prefix: str = "") -> list[str]:
    """Write each table to its own folder in one run; returns the names of those that have rows.

    Rows are counted while they are written. An empty table leaves a folder
    that holds its columns only.
    """
    written = []
    for name, table in tables.items():
        rows = Observation()
        counted = table.observe(rows, F.count(F.lit(1)).alias("rows"))
        counted.write.mode("overwrite").parquet(f"{folder}/{prefix}{name}")
        if rows.get["rows"]:
            written.append(name)
    return written


EXPORT_COLUMNS = [
    "origin_country",
    "destination_country",
    "commodity_hs",
    "commodity_name",
    "his",
    "hdi",
    "notification_count",
    "severity_total",
    "cvs",
    "destination_roles",
]


def corridor_export(corridors: DataFrame) -> DataFrame:
    """The ten export columns; roles are joined with ``;`` and a missing score is empty."""
    if "cvs" not in corridors.columns:
        corridors = corridors.withColumn("cvs", F.lit(None).cast("double"))
    roles = F.array_join(F.coalesce("destination_roles", F.array().cast("array<string>")), ";")
    return corridors.withColumn("destination_roles", roles).select(EXPORT_COLUMNS)


def export_corridors(corridors: DataFrame, path: str) -> str:
    return write_csv(corridor_export(corridors), path)
