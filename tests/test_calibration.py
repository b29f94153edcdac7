"""Weights learnt from outcomes, against Newton's method and a closed form."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tradelanes.operators import calibration


def newton(x, y, rounds=40):
    x = np.column_stack([x, np.ones(len(x))])
    b = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-x @ b))
        b += np.linalg.solve(x.T * (p * (1 - p)) @ x, x.T @ (y - p))
    return b


def made_up(n=4000):
    rng = np.random.default_rng(11)
    x = rng.random((n, 3))
    y = (rng.random(n) < 1 / (1 + np.exp(-(3 * x[:, 0] + 1 * x[:, 1] - 2 * x[:, 2] - 1)))).astype(int)
    return x, y


@pytest.fixture(scope="module")
def scored(spark):
    x, y = made_up()
    rows = [(*map(float, r), int(t)) for r, t in zip(x, y, strict=True)]
    rows += [(0.5, None, 0.5, 1), (0.5, 0.5, 0.5, None)] * 50
    return spark.createDataFrame(rows, "sci_norm double, crs_norm double, his_norm double, confirmed int").repartition(5)


def test_same_as_newton(scored):
    want = newton(*made_up())
    got = {r["input"]: r for r in calibration.weight_calibration(scored, "confirmed").collect()}
    for name, b in zip(calibration.SUB_SCORES, want, strict=False):
        assert got[name]["coefficient"] == pytest.approx(b, abs=1e-5)
        assert got[name]["intercept"] == pytest.approx(want[-1], abs=1e-5)
    assert got["his_norm"]["weight"] == 0.0  # it lowers the odds
    assert got["sci_norm"]["weight"] == pytest.approx(want[0] / (want[0] + want[1]), abs=1e-5)
    assert sum(r["weight"] for r in got.values()) == pytest.approx(1.0)


def test_rows_given_once_with_their_number(spark):
    cells = [(1, 1, 30), (1, 0, 10), (0, 1, 5), (0, 0, 55)]
    df = spark.createDataFrame(cells, "x int, y int, n int")
    row = calibration.weight_calibration(df, "y", ("x",), weight="n").first()
    assert row["coefficient"] == pytest.approx(math.log(30 * 55 / (10 * 5)), abs=1e-6)
    assert row["intercept"] == pytest.approx(math.log(5 / 55), abs=1e-6)
    assert row["weight"] == 1.0


def test_outcomes_that_teach_nothing(scored):
    with pytest.raises(ValueError, match="both kinds"):
        calibration.weight_calibration(scored.where("confirmed = 1"), "confirmed")
    with pytest.raises(ValueError, match="both kinds"):
        calibration.weight_calibration(scored.where("false"), "confirmed")
    with pytest.raises(ValueError, match="0 or 1"):
        calibration.weight_calibration(scored.withColumn("confirmed", F.col("confirmed") * 2), "confirmed")


def test_no_input_raises_the_odds(spark):
    df = spark.createDataFrame([(1, 1, 5), (1, 0, 50), (0, 1, 30), (0, 0, 10)], "x int, y int, n int")
    row = calibration.weight_calibration(df, "y", ("x",), weight="n").first()
    assert row["coefficient"] < 0 and row["weight"] is None
