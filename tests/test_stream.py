"""Notifications arriving late and in parts, with restarts in between and in the middle of a batch."""

import os

import pytest
from pyspark.sql import functions as F
from test_alerts import raw

from tradelanes.streaming.hazard_stream import daily_severity, fold_batches, hazard_days, stream_hazard


def arrivals(spark, book, folder, *rows):
    common = {"origin": "France", "notifying_country": "Spain", "risk_decision": "serious"}
    df = raw(spark, *[{**common, **row} for row in rows])
    df = df.withColumn("event_time", F.to_timestamp(F.concat("date", F.lit("T12:00:00Z"))))
    df.coalesce(1).write.mode("append").parquet(folder)
    return df


def days(frame):
    return sorted((str(r.day), r.destination_m49, round(r.severity, 9), r.events) for r in frame.collect())


@pytest.fixture
def places(tmp_path):
    return tuple(str(tmp_path / n) for n in ("in", "out", "progress"))


def test_an_alert_a_year_late_ends_up_in_its_day(spark, book, places):
    source, sink, progress = places
    first = arrivals(
        spark, book, source,
        {"date": "2025-01-01", "classification": "alert"},
        {"date": "2025-01-01", "classification": "border rejection"},
        {"date": "2025-02-15", "classification": "alert"},
        {"date": None},
    )
    stream = spark.readStream.schema(first.schema).parquet(source)

    def run():
        stream_hazard(stream, book, sink, progress).awaitTermination()
        return days(hazard_days(spark, sink))

    assert run() == [("2025-01-01", 724, 1.8, 2), ("2025-02-15", 724, 1.0, 1)]
    arrivals(spark, book, source, {"date": "2026-03-01", "classification": "alert"})
    assert len(run()) == 3
    arrivals(
        spark, book, source,
        {"date": "2025-01-01", "classification": "alert"},  # more than a year late
        {"date": "2025-02-15", "classification": "alert", "notifying_country": "Italy"},
    )
    want = [
        ("2025-01-01", 724, 2.8, 3), ("2025-02-15", 380, 1.0, 1), ("2025-02-15", 724, 1.0, 1), ("2026-03-01", 724, 1.0, 1),
    ]
    assert run() == want
    assert run() == want
    # batch and stream agree row for row
    assert days(daily_severity(spark.read.parquet(source), book)) == want


def test_a_batch_that_was_cut_off_is_not_counted_twice(spark, book, places):
    source, sink, progress = places
    rows = [{"date": f"2025-01-{k + 1:02d}", "classification": "alert"} for k in range(9)]
    for k in range(3):
        df = arrivals(spark, book, source, *rows[3 * k : 3 * k + 3], rows[0])
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(source)
    stream_hazard(stream, book, sink, progress).awaitTermination()
    want = days(daily_severity(spark.read.parquet(source), book))
    assert days(hazard_days(spark, sink)) == want
    last = max(int(name) for name in os.listdir(f"{progress}/commits") if name.isdigit())
    assert last == 2
    # as if the driver had died between writing the batch and noting it: no commit, and half of the files
    os.rename(f"{progress}/commits/{last}", f"{progress}/commits-{last}")
    if os.path.exists(f"{progress}/commits/.{last}.crc"):
        os.rename(f"{progress}/commits/.{last}.crc", f"{progress}/commits-{last}.crc")
    parts = [n for n in os.listdir(f"{sink}/batch={last}") if n.startswith("part-")]
    os.rename(f"{sink}/batch={last}/{parts[0]}", f"{sink}/../taken-{parts[0]}")
    stream_hazard(stream, book, sink, progress).awaitTermination()
    assert days(hazard_days(spark, sink)) == want


def test_folded_batches_go_on(spark, book, places, tmp_path):
    source, sink, progress = places
    for _ in range(3):
        df = arrivals(spark, book, source, {"date": "2025-01-01", "classification": "alert"})
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(source)
    stream_hazard(stream, book, sink, progress).awaitTermination()
    folded = str(tmp_path / "folded")
    fold_batches(spark, sink, folded)
    assert sorted(os.listdir(folded)) == ["batch=-2", "batch=2"]
    # the last batch runs again, then another comes
    os.rename(f"{progress}/commits/2", f"{progress}/commits-2")
    if os.path.exists(f"{progress}/commits/.2.crc"):
        os.rename(f"{progress}/commits/.2.crc", f"{progress}/commits-2.crc")
    arrivals(spark, book, source, {"date": "2025-01-01", "classification": "alert"})
    stream_hazard(stream, book, folded, progress).awaitTermination()
    assert days(hazard_days(spark, folded)) == [("2025-01-01", 724, 4.0, 4)]


def test_no_alert_yet(spark, book, places):
    source, sink, progress = places
    df = arrivals(spark, book, source, {"date": None})
    stream_hazard(spark.readStream.schema(df.schema).parquet(source), book, sink, progress).awaitTermination()
    assert hazard_days(spark, sink).collect() == []


def test_stream_of_the_declared_layout(spark, book, places, tmp_path):
    source, sink, progress = places
    rows = [{"date": "2025-01-01", "classification": "alert"}, {"date": "2025-06-01", "classification": "alert"}]
    df = arrivals(spark, book, str(tmp_path / "full"), *rows).drop("row_id")
    df.write.parquet(source)
    stream_hazard(spark.readStream.schema(df.schema).parquet(source), book, sink, progress).awaitTermination()
    assert [(d, n) for d, _, _, n in days(hazard_days(spark, sink))] == [("2025-01-01", 1), ("2025-06-01", 1)]


def test_a_batch_has_a_part_for_every_core(spark, shared, monkeypatch):
    from catalog import streams

    parts = []

    def look(arrivals, *rest):
        stream = arrivals.writeStream.foreachBatch(lambda batch, _: parts.append(batch.select(F.input_file_name().alias("f")).distinct().count()))
        return stream.option("checkpointLocation", rest[-1]).trigger(availableNow=True).start()

    monkeypatch.setattr(streams, "stream_hazard", look)
    monkeypatch.setattr(streams, "hazard_days", lambda session, path: session.createDataFrame([], "day date, commodity_hs string, destination_m49 int, origin_m49 int, severity double, events bigint"))
    streams.streamed_days(shared)
    cores = spark.sparkContext.defaultParallelism
    assert 1 < max(parts) <= cores and sum(parts) > cores
