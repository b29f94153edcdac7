"""Session settings, and the one place that cuts lineage or picks a scratch folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_local_folders: dict[str, str] = {}


def build_session(app: str = "tradelanes", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators are written for.

    Adaptive execution re-plans joins and splits skewed join partitions at run
    time. Shuffle partitions are left to the cluster; pass
    ``spark.sql.shuffle.partitions`` to fix them.
    """
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.files.maxPartitionBytes", "256m")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def _shared_folder(spark: SparkSession) -> str:
    """The cluster's shared folder; a temporary one only in local mode."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError(
            "set spark.checkpoint.dir to a folder every executor can reach; "
            "a machine-local folder does not survive on a cluster"
        )
    application = spark.sparkContext.applicationId
    if application not in _local_folders:
        _local_folders[application] = tempfile.mkdtemp(prefix="tradelanes-")
    return _local_folders[application]


def materialise(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    Used only where a result feeds several branches of one plan. The files
    outlive a lost executor, so nothing upstream is computed again; being
    columnar, each branch reads only the columns it needs, and their size is
    known when joins are planned.
    """
    path = scratch_folder(df.sparkSession, "stage")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def scratch_folder(spark: SparkSession, label: str) -> str:
    """A new, not yet existing folder below the shared one."""
    return f"{_shared_folder(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"
