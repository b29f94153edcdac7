"""Worked examples with known answers."""

import math

import pytest
from pyspark.sql import functions as F

from tradelanes.functions import formulas as f
from tradelanes.functions import guards

c = F.col


def test_supply_balance(values):
    balance = lambda: f.supply_balance(c("p"), c("m"), c("x"))
    assert values(balance, p=500_000.0, m=12_000_000.0, x=1_500_000.0) == 11_000_000
    assert values(balance, p=0.0, m=100.0, x=200.0) is None
    assert values(balance, p=0.0, m=100.0, x=100.0) is None
    stocked = lambda: f.supply_balance(c("p"), c("m"), c("x"), c("s"))
    assert values(stocked, p=0.0, m=100.0, x=100.0, s=7.0) == 7.0


def test_ratios(values):
    assert values(lambda: f.import_dependency_ratio(c("m"), c("d")), m=12000.0, d=11000.0) == pytest.approx(1.0909090909)
    assert values(lambda: f.origin_country_share(c("b"), c("m")), b=8000.0, m=12000.0) == pytest.approx(2 / 3)
    assert values(lambda: f.bilateral_dependency(c("b"), c("d")), b=8000.0, d=11000.0) == pytest.approx(0.7272727273)
    assert values(lambda: f.import_dependency_ratio(c("m"), c("d")), m=1.0, d=0.0) is None


@pytest.mark.parametrize(
    "production, domestic, supply, expected",
    [(2000.0, 1000.0, 5.0, 2.0), (0.0, 1000.0, 5.0, 0.0), (10.0, 0.0, 5.0, 2.0), (10.0, None, 4.0, 2.5), (10.0, None, 0.0, None)],
)
def test_self_sufficiency_falls_back(values, production, domestic, supply, expected):
    got = values(lambda: f.self_sufficiency(c("p"), c("d"), c("s")), p=production, d=domestic, s=supply)
    assert got == expected


def test_supply_criticality(values):
    sci = lambda: f.supply_criticality(c("i"), c("o"), c("h"))
    assert values(sci, i=1.091, o=0.667, h=0.490) == pytest.approx(1.084, abs=0.002)
    assert values(sci, i=1.0, o=1.0, h=1.0) == 2.0
    assert values(sci, i=1.0, o=1.0, h=None) is None


def test_consumption(values):
    pcc = lambda: f.per_capita_consumption(c("d"), c("n"))
    assert values(pcc, d=1_000_000.0, n=100_000.0) == 10.0
    assert values(pcc, d=1.0, n=0.0) is None
    assert values(lambda: f.rank_score(c("r"), c("n")), r=1.0, n=10.0) == 1.0
    assert values(lambda: f.rank_score(c("r"), c("n")), r=10.0, n=10.0) == 0.0
    assert values(lambda: f.rank_score(c("r"), c("n")), r=1.0, n=1.0) == 1.0
    assert values(lambda: f.demand_inelasticity(c("v")), v=3.0) == 0.0
    assert values(lambda: f.demand_inelasticity(c("v")), v=None) is None


@pytest.mark.parametrize(
    "classification, decision, expected",
    [
        ("AlertNotification", "Serious", 1.0),
        ("InfoAttention", "NotSerious", 0.1),
        ("BorderRejection", "PotentiallySerious", 0.56),
        ("InfoFollowUp", "PotentialRisk", 0.28),
    ],
)
def test_severity(spark, classification, decision, expected):
    df = spark.createDataFrame([(classification, decision)], "a string, b string")
    got = df.select(f.severity_weight(c("a"), c("b")).alias("s")).first()["s"]
    assert got == pytest.approx(expected)


def test_half_life(values):
    assert values(lambda: f.half_life(c("a")), a=0.90) == pytest.approx(6.5788, abs=0.01)
    assert values(lambda: f.half_life(c("a")), a=0.95) == pytest.approx(13.5134, abs=0.01)
    assert values(lambda: f.half_life(c("a")), a=1.0) is None
    assert values(lambda: f.half_life(c("a")), a=0.0) is None


@pytest.mark.parametrize(
    "counts, expected",
    [([10, 0, 0, 0, 0, 0], 0.0), ([5] * 6, 1.0), ([10, 10, 0, 0, 0, 0], 0.387), ([0] * 6, 0.0)],
)
def test_hazard_diversity(values, counts, expected):
    names = "abcdef"
    numbers = {n: float(v) for n, v in zip(names, counts)}
    got = values(lambda: f.normalised_entropy([c(n) for n in names]), **numbers)
    assert got == pytest.approx(expected, abs=1e-3)


def test_detection_gap(values):
    gap = lambda: f.detection_gap(c("b"), c("m"), c("n"), c("t"))
    assert values(gap, b=60.0, m=100.0, n=2.0, t=10.0) == pytest.approx(0.4)
    assert values(gap, b=20.0, m=100.0, n=6.0, t=10.0) == pytest.approx(-0.4)
    assert values(gap, b=100.0, m=500.0, n=0.0, t=0.0) is None
    assert values(gap, b=1.0, m=0.0, n=1.0, t=2.0) is None


def test_trade_flow(values):
    assert values(lambda: f.unit_value(c("v"), c("w")), v=1000.0, w=500.0) == 2.0
    assert values(lambda: f.unit_value(c("v"), c("w")), v=1000.0, w=0.0) is None
    mtd = lambda: f.mirror_discrepancy(c("m"), c("x"))
    assert values(mtd, m=1000.0, x=1000.0) == 0.0
    assert values(mtd, m=1000.0, x=500.0) == 0.5
    assert values(mtd, m=0.0, x=0.0) is None
    z = lambda: f.zscore(c("v"), c("m"), c("s"))
    assert values(z, v=10.0, m=5.0, s=2.5) == 2.0
    assert values(z, v=10.0, m=5.0, s=0.0) is None
    assert values(z, v=10.0, m=5.0, s=None) is None


def test_hazard_probability(values):
    probability = lambda: f.hazard_probability(c("r"), c("m"), c("s"))
    assert values(probability, r=20.0, m=10_000_000.0, s=25_000.0) == pytest.approx(0.05)
    assert values(probability, r=10.0, m=0.0, s=25_000.0) is None


def test_scores(values):
    names = "abc"
    three = {"a": 0.8, "b": 0.6, "c": 0.4}
    assert values(lambda: f.score_weighted_linear([c(n) for n in names], [0.5, 0.3, 0.2]), **three) == pytest.approx(0.66)
    zero = {"a": 0.8, "b": 0.0, "c": 0.4}
    assert values(lambda: f.score_geometric_mean([c(n) for n in names], [0.5, 0.3, 0.2]), **zero) == 0.0
    hybrid = lambda: f.score_hybrid(c("s"), c("r"), c("h"), c("p"), c("k"))
    assert values(hybrid, s=0.5, r=0.8, h=0.6, p=0.3, k=0.4) == pytest.approx(0.23)
    assert f.equal_weights(4) == [0.25] * 4
    assert f.equal_weights(0) == []


@pytest.mark.parametrize("value, band", [(0.1, "low"), (0.25, "moderate"), (0.6, "elevated"), (0.75, "high"), (9.0, "high")])
def test_risk_band(values, value, band):
    assert values(lambda: f.risk_band(c("v")), v=value) == band


@pytest.mark.parametrize("hhi, band", [(1500.0, "low"), (1500.1, "moderate"), (2500.0, "moderate"), (2500.1, "high")])
def test_concentration_band(values, hhi, band):
    assert values(lambda: f.concentration_band(c("v")), v=hhi) == band


@pytest.mark.parametrize("cvs, band", [(0.1, "low"), (0.2, "moderate"), (0.4, "elevated"), (0.6, "high"), (0.8, "critical"), (None, None)])
def test_vulnerability_band(values, cvs, band):
    assert values(lambda: f.vulnerability_band(c("v")), v=cvs) == band


def test_undefined_is_null(spark):
    rows = [(float("nan"), [1.0, float("inf")]), (1.5, None), (float("-inf"), [])]
    df = spark.createDataFrame(rows, "x double, items array<double>")
    got = [tuple(r) for r in guards.null_out_nonfinite(df).collect()]
    assert got == [(None, [1.0, None]), (1.5, None), (None, [])]


@pytest.mark.parametrize(
    "text, number",
    [("12", 12.0), (" 1.5e2 ", 150.0), ("-3.", -3.0), ("1d", None), ("nan", None), ("", None), ("n/a", None), (None, None)],
)
def test_coerce_double(spark, text, number):
    df = spark.createDataFrame([(text,)], "t string")
    assert df.select(guards.coerce_double(c("t")).alias("n")).first()["n"] == number


def test_total_of_nothing_is_zero(spark):
    df = spark.createDataFrame([(None,), (None,)], "x double")
    assert df.agg(guards.total(c("x")).alias("t")).first()["t"] == 0.0
    assert not math.isnan(df.where("false").agg(guards.total(c("x")).alias("t")).first()["t"])
