"""Notifications read as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catalog.base import query
from tradelanes.operators.alerts import CORRIDOR
from tradelanes.plans.shared_tables import SharedTables
from tradelanes.session import scratch_folder
from tradelanes.streaming.hazard_stream import hazard_days, stream_hazard


@query(
    "stream_hazard",
    """SELECT strftime(day, '%Y-%m-%d') AS day, commodity_hs, destination_m49, origin_m49, sum(cw.w * dw.w) AS severity,
       count(*) AS events FROM (
         SELECT e.*, CAST(coalesce(r.date, r.notification_date) AS DATE) AS day,
                coalesce(c.kind, 'InfoAttention') AS ck, coalesce(d.kind, 'PotentialRisk') AS dk
         FROM corridor_events e JOIN raw r USING (row_id)
         LEFT JOIN classes c ON c.spelling = lower(trim(e.classification))
         LEFT JOIN decisions d ON d.spelling = lower(trim(e.risk_decision)) WHERE e.commodity_hs <> '') q
       JOIN class_weights cw ON cw.kind = ck JOIN decision_weights dw ON dw.kind = dk
       WHERE day IS NOT NULL GROUP BY 1, 2, 3, 4""",
    "severity",
)
def streamed_days(t: SharedTables) -> DataFrame:
    """All days, after notifications have arrived in four batches and in no order of time.

    A batch has a file for every core, so that none waits for another's part.
    """
    source, sink = scratch_folder(t.spark, "arrivals"), scratch_folder(t.spark, "days")
    dated = t.raw.withColumn("event_time", F.to_timestamp(F.concat(F.coalesce("date", "notification_date"), F.lit("T00:00:00Z"))))
    files = t.spark.sparkContext.defaultParallelism
    dated.repartition(4 * files, "row_id").write.parquet(source)
    arrivals = t.spark.readStream.schema(dated.schema).option("maxFilesPerTrigger", files).parquet(source)
    stream_hazard(arrivals, t.book, sink, scratch_folder(t.spark, "progress")).awaitTermination()
    days = hazard_days(t.spark, sink)
    return days.select(F.col("day").cast("string").alias("day"), *CORRIDOR, "severity", "events")
