"""Daily severity per corridor, kept up to date while notifications arrive.

Alerts are revised and come late, by a year or more. So no day is ever final:
every batch leaves its own sums by day, and a day is the sum of what all
batches left for it. The decayed hazard intensity stays a batch query over the
days, because the decay depends on the period asked about.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tradelanes.dimensions import CountryBook
from tradelanes.functions import text
from tradelanes.functions.formulas import severity_weight
from tradelanes.operators.alerts import CORRIDOR, extract_corridors

EVENT_TIME = "event_time"
_SUMS = "day date, commodity_hs string, destination_m49 int, origin_m49 int, severity double, events bigint, batch bigint"


def daily_severity(raw: DataFrame, book: CountryBook) -> DataFrame:
    """Severity and events per corridor and day of ``event_time``, days being those of UTC.

    Rows without event time or commodity are left out, as their day or
    corridor is not known.
    """
    if "row_id" not in raw.columns:  # the order of the source plays no part in sums
        raw = raw.withColumn("row_id", F.lit(0).cast("long"))
    dated = raw.where(F.col(EVENT_TIME).isNotNull())
    events = extract_corridors(dated, book, keep=[EVENT_TIME]).where(F.col("commodity_hs") != "")
    severity = severity_weight(
        text.parse_classification(F.col("classification")),
        text.parse_risk_decision(F.col("risk_decision")),
    )
    return events.groupBy(utc_day(F.col(EVENT_TIME)).alias("day"), *CORRIDOR).agg(
        F.sum(severity).alias("severity"), F.count("*").alias("events")
    )


def utc_day(moment: Column) -> Column:
    """The date in UTC, whatever zone the session shows times in."""
    return F.date_from_unix_date(F.floor(F.unix_seconds(moment) / 86_400).cast("int"))


def stream_hazard(
    raw: DataFrame, book: CountryBook, path: str, checkpoint: str, until_caught_up: bool = True
) -> StreamingQuery:
    """Add each batch's daily sums to the table that ``hazard_days`` reads.

    A batch writes a folder named by its number and writes it anew when it is
    run again. A batch has the same rows and number each time, so a run that
    was cut off after or in the middle of writing changes nothing. There is no
    state: a late alert costs the sums of its batch only, no matter how old its
    day is. Restarting on the same checkpoint goes on where it stopped.
    """
    spark = raw.sparkSession
    # readers find a table even before the first alert
    spark.createDataFrame([], _SUMS).drop("batch").write.mode("overwrite").parquet(_folder(path, -1))

    def add(batch: DataFrame, number: int) -> None:
        daily_severity(batch, book).write.mode("overwrite").parquet(_folder(path, number))

    writer = raw.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint)
    if until_caught_up:
        writer = writer.trigger(availableNow=True)
    return writer.start()


def hazard_days(spark: SparkSession, path: str) -> DataFrame:
    """Severity and events per corridor and day, of all batches so far."""
    sums = spark.read.schema(_SUMS).parquet(path)
    return sums.groupBy("day", *CORRIDOR).agg(F.sum("severity").alias("severity"), F.sum("events").alias("events"))


def fold_batches(spark: SparkSession, path: str, into: str) -> None:
    """Write the sums of all batches but the last as one batch of a new table ``into``, and the last as it is.

    For a stream that is stopped; start it again on the same checkpoint with
    ``into`` as its path. If the last batch was not yet noted in the
    checkpoint, it is run again and replaces itself. Both tables stand until
    the caller drops the old one.
    """
    sums = spark.read.schema(_SUMS).parquet(path)
    last = sums.agg(F.max("batch")).first()[0]
    if last is None:
        return
    whole = [F.sum("severity").alias("severity"), F.sum("events").alias("events")]
    earlier = sums.where(F.col("batch") < last).groupBy("day", *CORRIDOR).agg(*whole)
    earlier.write.mode("overwrite").parquet(_folder(into, -2))
    sums.where(F.col("batch") == last).drop("batch").write.mode("overwrite").parquet(_folder(into, last))


def _folder(path: str, number: int) -> str:
    return f"{path.rstrip('/')}/batch={number}"
