"""Distributed ranks and quantiles against brute force, with hot values."""

import hashlib
import random

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tradelanes.operators import ranking


def brute(rows):
    """Percentile rank by value, then by the digest of the key."""
    valid = sorted(
        (float(f"{v:.11e}"), hashlib.md5(str(k).encode()).hexdigest(), k) for k, v in rows if v is not None
    )
    n = len(valid)
    return {k: (i / (n - 1) if n > 1 else 1.0) for i, (_, _, k) in enumerate(valid)}


def ranked(spark, rows):
    df = spark.createDataFrame(rows, "k int, v double").repartition(5)
    got = ranking.normalise_percentile_rank(df, "v", ["k"], "norm").collect()
    assert len(got) == len(rows)
    return {r.k: r.norm for r in got}


def test_a_third_of_all_rows_share_a_value(spark):
    random.seed(3)
    rows = [(i, 7.0 if i % 3 == 0 else (None if i % 11 == 0 else random.random() * 20)) for i in range(5000)]
    got, expected = ranked(spark, rows), brute(rows)
    for k, v in rows:
        assert got[k] == (pytest.approx(expected[k]) if v is not None else None)


def test_hot_value_is_spread_over_tasks(spark):
    rows = [(i, 7.0 if i % 3 else float(i)) for i in range(6000)]
    df = spark.createDataFrame(rows, "k int, v double")
    cuts = ranking.cut_points(df, ["v"])["v"]
    assert 7.0 in cuts
    slot, single = ranking._slot(ranking.stable(ranking.F.col("v")), cuts)
    part = ranking.F.conv(ranking.F.substring(ranking.tie_break(["k"]), 1, 4), 16, 10).cast("int")
    parts = df.where(single & (ranking.F.col("v") == 7.0)).select(
        (part * ranking.TIE_PARTS / 65536).cast("int").alias("p")
    ).groupBy("p").count().collect()
    assert len(parts) == ranking.TIE_PARTS
    assert max(r["count"] for r in parts) < 4000 / ranking.TIE_PARTS * 3


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.one_of(st.none(), st.integers(0, 6).map(float), st.floats(0, 1e6)), min_size=1, max_size=60))
def test_any_input(spark, items):
    rows = list(enumerate(items))
    got, expected = ranked(spark, rows), brute(rows)
    for k, v in rows:
        assert got[k] == (pytest.approx(expected[k]) if v is not None else None)


def test_log_percentile_keeps_the_order(spark):
    rows = [(i, float(v)) for i, v in enumerate([0, 1, 10, 100, 1000])]
    df = spark.createDataFrame(rows, "k int, v double")
    got = {r.k: r.norm for r in ranking.normalise_log_percentile(df, "v", ["k"], "norm").collect()}
    assert got == {0: 0.0, 1: 0.25, 2: 0.5, 3: 0.75, 4: 1.0}


def test_min_max(spark):
    df = spark.createDataFrame([(float(v),) for v in (10, 20, 30, 40, 50)] + [(None,)], "v double")
    got = [r.n for r in ranking.normalise_min_max(df, "v", "n").orderBy("v").collect()]
    assert got == [None, 0.0, 0.25, 0.5, 0.75, 1.0]
    same = spark.createDataFrame([(3.0,), (3.0,)], "v double")
    assert [r.n for r in ranking.normalise_min_max(same, "v", "n").collect()] == [0.5, 0.5]


@pytest.mark.parametrize("size", [1, 2, 7, 1000])
def test_exact_quantiles(spark, size):
    random.seed(size)
    numbers = [5.0 if random.random() < 0.34 else round(random.random() * 100, 1) for _ in range(size)]
    df = spark.createDataFrame([(v,) for v in numbers], "value double")
    counts = df.groupBy("value").count()
    probs = [0.0, 0.25, 0.5, 0.75, 1.0]
    got = list(ranking.exact_quantiles(counts, "value", probs).first())
    assert got == pytest.approx(list(np.quantile(numbers, probs)))


def test_small_values_keep_their_order(spark):
    rows = spark.createDataFrame([(i, (i + 1) * 1e-10) for i in range(4)] + [(9, None)], "k int, v double")
    got = ranking.normalise_percentile_rank(rows, "v", ["k"], "p").orderBy("k").collect()
    assert [r.p for r in got] == pytest.approx([0, 1 / 3, 2 / 3, 1, None])
    near = spark.range(1).select(ranking.stable(ranking.F.lit(0.1) + 0.2) == ranking.stable(ranking.F.lit(0.3)))
    assert near.first()[0]


@pytest.mark.parametrize("few", [3, 10_000])
def test_narrowed_quantiles_are_exact(spark, monkeypatch, few):
    monkeypatch.setattr(ranking, "_FEW", few)
    monkeypatch.setattr(ranking, "_ERROR", 100 if few == 3 else 10_000)
    rng = np.random.default_rng(4)
    columns = {
        "distinct": rng.normal(size=5000),
        "hot": np.where(rng.random(5000) < 0.4, 1.5, rng.normal(size=5000)),
        "two": rng.choice([1.0, 2.0], 5000),
        "same": np.full(5000, -3.25),
        "gaps": np.where(rng.random(5000) < 0.999, np.nan, rng.random(5000)),
        "none": np.full(5000, np.nan),
    }
    cells = zip(*[[None if np.isnan(x) else float(x) for x in c] for c in columns.values()], strict=True)
    df = spark.createDataFrame(list(cells), ", ".join(f"{c} double" for c in columns)).repartition(7)
    probs = [0.0, 0.25, 0.5, 0.75, 0.9, 1.0]
    got, row = ranking.narrowed_quantiles(df, list(columns), probs, (F.count("*").alias("rows"),))
    assert row["rows"] == 5000
    for name, values in columns.items():
        known = values[~np.isnan(values)]
        want = np.quantile(known, probs).tolist() if len(known) else [None] * len(probs)
        assert got[name] == (pytest.approx(want, rel=1e-12) if len(known) else want), name


def test_narrowed_quantiles_leave_the_column_where_it_is(spark):
    """What is grouped and ordered at the end is a few rows, of a column with no value twice."""
    df = spark.range(0, 400_000, numPartitions=8).selectExpr("CAST(id * 7919 % 400009 AS DOUBLE) AS x")
    got, _ = ranking.narrowed_quantiles(df, ["x"], [0.25, 0.5, 0.75])
    values = sorted(i * 7919 % 400_009 for i in range(400_000))
    assert got["x"] == pytest.approx(np.quantile(values, [0.25, 0.5, 0.75]).tolist())


def test_narrowed_quantiles_of_nothing(spark):
    df = spark.createDataFrame([], "x double")
    assert ranking.narrowed_quantiles(df, ["x"], [0.5])[0] == {"x": [None]}
