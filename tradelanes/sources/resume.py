"""Resumable loading of country pairs, tracked in a progress table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PAIR = ["from_code", "to_code"]


def pending_pairs(pairs: DataFrame, progress: DataFrame) -> DataFrame:
    """Pairs not completed yet; failed ones come again."""
    done = progress.where(F.col("status") == "completed").select(PAIR).distinct()
    return pairs.join(done, PAIR, "left_anti")


def tag_source_pair(rows: DataFrame, pairs: DataFrame) -> DataFrame:
    """Stamp each trade row with the pair it was loaded for."""
    names = pairs.select(
        F.col("from_code").alias("reporterCode"),
        F.col("to_code").alias("partnerCode"),
        F.col("from_country").alias("source_from_country"),
        F.col("to_country").alias("source_to_country"),
    )
    return rows.join(names, ["reporterCode", "partnerCode"])


def record_progress(attempted: DataFrame, loaded: DataFrame) -> DataFrame:
    """Outcome per attempted pair; a pair without rows has failed."""
    counts = loaded.groupBy(
        F.col("reporterCode").alias("from_code"), F.col("partnerCode").alias("to_code")
    ).agg(F.count("*").alias("records"))
    outcome = attempted.select(PAIR).join(counts, PAIR, "left")
    records = F.coalesce("records", F.lit(0)).cast("int")
    status = F.when(records > 0, "completed").otherwise("failed")
    return outcome.select(*PAIR, status.alias("status"), records.alias("records"))


def append_progress(outcome: DataFrame, path: str) -> str:
    outcome.write.mode("append").parquet(path)
    return path


def checkpoint_status(pairs: DataFrame, progress: DataFrame) -> DataFrame:
    """One row: pairs in all, completed and failed, and records loaded.

    A pair completed at any time counts as completed, one that failed at any
    time as failed.
    """
    known = progress.groupBy(PAIR).agg(
        F.max((F.col("status") == "completed").cast("int")).alias("completed"),
        F.max((F.col("status") == "failed").cast("int")).alias("failed"),
        F.sum(F.when(F.col("status") == "completed", F.col("records"))).alias("records"),
    )
    joined = pairs.select(PAIR).distinct().join(known, PAIR, "left")
    return joined.agg(
        F.count("*").alias("total_pairs"),
        F.coalesce(F.sum("completed"), F.lit(0)).alias("completed_pairs"),
        F.coalesce(F.sum("failed"), F.lit(0)).alias("failed_pairs"),
        F.coalesce(F.sum("records"), F.lit(0)).alias("total_records"),
    )
