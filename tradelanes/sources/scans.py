"""Readers for the declared inputs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tradelanes import schemas
from tradelanes.functions.guards import coerce_double, null_out_nonfinite
from tradelanes.functions.text import hs_int_text, six_digit_hs


#: What CSV files are called; packed ones are read as they are.
_CSV_FILES = "{*.csv,*.csv.gz}"


def _by_header(spark: SparkSession, known: T.StructType, path: str | list[str], whole: bool = False) -> DataFrame:
    """Files that share one header, with the columns it names; those not ``known`` are text.

    Files whose header differs from the first one's raise when they are read.
    ``whole`` lets quoted fields hold line breaks; such files aren't split.
    """

    def reader():
        return spark.read.option("header", True).option("escape", '"').option("multiLine", whole)

    kinds = {f.name: f.dataType for f in known.fields}
    names = reader().csv(path).columns  # reads the first lines of one file
    layout = T.StructType([T.StructField(n, kinds.get(n, T.StringType())) for n in names])
    return reader().schema(layout or known).option("enforceSchema", False).csv(path)


def _csv(
    spark: SparkSession, schema: T.StructType, path: str | list[str], required: list[str] | None = None, whole: bool = False
) -> DataFrame:
    """The columns of ``schema``, found by name. ``required`` ones (all, if not given) must exist; others may be absent."""
    rows = _by_header(spark, schema, path, whole)
    schemas.require_columns(rows, schema.fieldNames() if required is None else required)
    return rows.select([c for c in schema.fieldNames() if c in rows.columns])


def scan_trade(spark: SparkSession, path: str | list[str], fmt: str = "csv") -> DataFrame:
    """Trade rows with the standard columns. A missing path raises."""
    if fmt == "csv":
        trade = _csv(spark, schemas.TRADE, path, schemas.TRADE_REQUIRED)
    else:
        trade = spark.read.format(fmt).load(path)
    schemas.require_columns(trade, schemas.TRADE_REQUIRED)
    return null_out_nonfinite(trade)


def scan_trade_coerced(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Trade rows whose four numeric columns may hold bad text, which becomes NULL."""
    text = T.StructType([T.StructField(name, T.StringType()) for name in schemas.TRADE_COLUMNS])
    return coerce_trade(_csv(spark, text, path, schemas.TRADE_REQUIRED))


def coerce_trade(rows: DataFrame) -> DataFrame:
    return rows.select(
        [
            coerce_double(F.col(f.name)).cast(f.dataType).alias(f.name)
            if f.name in ("primaryValue", "netWgt", "qty", "period")
            else F.col(f.name).cast(f.dataType).alias(f.name)
            for f in schemas.TRADE.fields
            if f.name in rows.columns
        ]
    )


def list_input_files(spark: SparkSession, folder: str) -> DataFrame:
    """The non-empty ``*.csv`` and ``*.csv.gz`` files of a folder, by name, with their sizes. Contents are not read."""
    return _files(spark, folder).where("length > 0").select("file_name", "path", "length").orderBy("file_name")


def _files(spark: SparkSession, folder: str) -> DataFrame:
    files = spark.read.format("binaryFile").option("pathGlobFilter", _CSV_FILES).load(folder)
    name = F.element_at(F.split("path", "/"), -1)
    return files.select(name.alias("file_name"), "path", "length", _plain(F.col("_metadata.file_path")).alias("at"))


def _heads(spark: SparkSession, folder: str) -> DataFrame:
    """The header line of each CSV file that has one, from the first block of the file.

    A header is a line with cells named ``reporterCode`` and ``cmdCode``; of
    several the first counts. Further blocks of a file are not read; a packed file is one block.
    """
    lines = spark.read.option("pathGlobFilter", _CSV_FILES).text(folder)
    cells = F.split(F.replace("value", F.lit('"'), F.lit("")), r"\s*,\s*")
    named = F.array_contains(cells, "reporterCode") & F.array_contains(cells, "cmdCode")
    # a line is looked at as a whole before it is cut into cells
    likely = F.contains("value", F.lit("reporterCode")) & F.contains("value", F.lit("cmdCode"))
    found = lines.where(F.col("_metadata.file_block_start") == 0).where(likely).where(named)
    line = F.struct(F.monotonically_increasing_id().alias("place"), F.trim(F.replace("value", F.lit('"'), F.lit(""))).alias("header"))
    return found.select(_plain(F.col("_metadata.file_path")).alias("at"), line.alias("line")).groupBy("at").agg(
        F.min("line")["header"].alias("header")
    )


def trade_file_report(spark: SparkSession, folder: str, skip: str | None = None) -> DataFrame:
    """What becomes of each CSV file of a folder when they are merged: ``file_name``, ``length``, ``header``, ``status``.

    The status is ``merged``, ``no header`` or ``left out``, which is the file
    named by ``skip``. Spark's readers don't see files of no bytes.
    """
    files = _files(spark, folder)
    status = (
        F.when(F.col("file_name") == F.lit(skip), "left out")
        .when(F.col("header").isNull(), "no header")
        .otherwise("merged")
    )
    told = files.join(_heads(spark, folder), "at", "left")
    return told.select("file_name", F.col("at").alias("path"), "length", "header", status.alias("status"))


def trade_layouts(spark: SparkSession, folder: str, skip: str | None = None) -> list[tuple[list[str], list[str]]]:
    """Group a folder's CSV files by their header line; files without one are in ``trade_file_report``.

    The driver gets each path once, as the reader that is given them needs.
    """
    merged = trade_file_report(spark, folder, skip).where("status = 'merged'")
    groups = merged.groupBy("header").agg(F.sort_array(F.collect_set("path")).alias("paths"))
    return [(r["header"].split(","), r["paths"]) for r in groups.orderBy("header").collect()]


def _plain(path: Column) -> Column:
    """A path as readers take it, from its escaped form."""
    return F.url_decode(F.replace(path, F.lit("+"), F.lit("%2B")))


def merge_trade_files(
    spark: SparkSession, folder: str, skip: str | None = None, drop_duplicates: bool = True
) -> DataFrame:
    """All CSV files of a folder, aligned by column name, exact repeats removed."""
    layouts = trade_layouts(spark, folder, skip)
    if not layouts:
        raise FileNotFoundError(f"no trade files in {folder}")
    merged = union_frames([_by_header(spark, schemas.TRADE, paths) for _, paths in layouts])
    return merged.dropDuplicates() if drop_duplicates else merged


def union_frames(frames: list[DataFrame]) -> DataFrame:
    """Bag union by column name; columns a frame lacks become NULL."""
    merged = frames[0]
    for frame in frames[1:]:
        merged = merged.unionByName(frame, allowMissingColumns=True)
    return merged


def scan_notifications(spark: SparkSession, path: str | list[str], fmt: str = "csv") -> DataFrame:
    """Raw notifications with a ``row_id`` that orders them by file name, then as they stand in the file.

    Quoted texts may hold line breaks. Columns are found by name; of those that
    aren't needed an absent one is NULL.
    """
    if fmt == "csv":
        rows = _csv(spark, schemas.NOTIFICATIONS_RAW, path, schemas.NOTIFICATIONS_REQUIRED, whole=True)
        for field in schemas.NOTIFICATIONS_RAW.fields:
            if field.name not in rows.columns:
                rows = rows.withColumn(field.name, F.lit(None).cast(field.dataType))
    else:
        rows = spark.read.format(fmt).load(path)
    return rows if "row_id" in rows.columns else rows.withColumn("row_id", _place())


def _place() -> Column:
    """Where a row of a file stands. Numbers alone won't do: Spark deals files to tasks by their size."""
    return F.struct(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("row"),
    )


def with_row_id(rows: DataFrame) -> DataFrame:
    return rows if "row_id" in rows.columns else rows.withColumn("row_id", F.monotonically_increasing_id())


def scan_commodities(spark: SparkSession, path: str, six_digits: bool = True) -> DataFrame:
    """Commodity names with their codes.

    Codes keep six digits, so chapter filters work; ``six_digits=False`` gives
    the whole-number text that drops leading zeros.
    """
    needed = ["commodity", "hs_code_comtrade"]
    rows = _csv(spark, schemas.COMMODITIES, path, needed, whole=True).withColumn("pos", _place())
    rule = six_digit_hs if six_digits else hs_int_text
    return rows.withColumn("hs_code", rule(F.col("hs_code_comtrade")))


def scan_production(spark: SparkSession, path: str | None = None) -> DataFrame:
    if path is None:
        return spark.createDataFrame([], schemas.PRODUCTION)
    return _csv(spark, schemas.PRODUCTION, path)


def scan_food_balance(spark: SparkSession, path: str | None = None) -> DataFrame:
    if path is None:
        return spark.createDataFrame([], schemas.FOOD_BALANCE)
    return _csv(spark, schemas.FOOD_BALANCE, path)


def json_payload_to_rows(
    spark: SparkSession, path: str, schema: T.StructType = schemas.TRADE, whole: bool = False
) -> DataFrame:
    """Rows of ``{"data": [...]}`` documents; an empty or absent list gives none.

    A file holds one document a line, or with ``whole`` one document of any
    number of lines. A document that can't be read raises.
    """
    payload = T.StructType([T.StructField("data", T.ArrayType(schema))])
    documents = spark.read.schema(payload).option("mode", "FAILFAST").option("multiLine", whole).json(path)
    return documents.select(F.explode("data").alias("row")).select("row.*")


def project_trade_columns(rows: DataFrame) -> DataFrame:
    """The standard columns that exist, in their standard order."""
    return rows.select([c for c in schemas.TRADE_COLUMNS if c in rows.columns])
