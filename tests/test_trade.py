"""Dependency, consumption and trade-flow operators on small tables."""

import pytest
from pyspark.sql import functions as F

from tradelanes.operators import consumption, dependency, flows, trade_flow

TRADE = (
    "cmdCode string, reporterCode int, partnerCode int, period int, flowCode string, netWgt double, primaryValue double"
)


@pytest.fixture
def wheat(spark):
    """The worked example: four origins, exports, production."""
    rows = [("1001", 56, p, 2023, "M", kg, kg * 2) for p, kg in ((251, 8000.0), (276, 2000.0), (528, 1500.0), (804, 500.0))]
    rows += [("1001", 56, 442, 2023, "X", 1500.0, 1.0)]
    return spark.createDataFrame(rows, TRADE)


def test_worked_example(spark, wheat):
    production = spark.createDataFrame(
        [("1001", 56, 2023, 500.0, None)],
        "commodity_hs string, country_m49 int, period int, production_kg double, domestic_supply_kg double",
    )
    rows = {r.origin_m49: r for r in dependency.corridor_dependency(wheat, production).collect()}
    assert set(rows) == {251, 276, 528, 804}
    top = rows[251]
    assert top.ds_prime == 11000.0
    assert top.idr == pytest.approx(12 / 11)
    assert top.ocs == pytest.approx(2 / 3)
    assert top.bdi == pytest.approx(top.idr * top.ocs)
    assert top.hhi == pytest.approx(0.490, abs=0.001)
    assert top.sci == pytest.approx(1.084, abs=0.002)
    assert top.ssr == pytest.approx(500 / 11000)
    assert not top.dq_flag
    assert sum(r.ocs for r in rows.values()) == pytest.approx(1.0)


def test_non_positive_supply_is_flagged(spark):
    df = spark.createDataFrame(
        [("h", 1, 2, 2020, "M", 100.0, 1.0), ("h", 1, 2, 2020, "X", 200.0, 1.0)], TRADE
    )
    row = dependency.corridor_dependency(df).first()
    assert row.dq_flag and row.idr is None and row.ocs is None and row.hhi is None and row.sci is None
    assert dependency.supply_flag(dependency.corridor_dependency(df)).count() == 1


def test_null_weights_and_keys(spark):
    df = spark.createDataFrame(
        [("h", 1, 2, 2020, "M", None, 5.0), ("h", 1, None, 2020, "M", 3.0, 5.0), ("h", 1, 3, 2020, "M", 4.0, 8.0)], TRADE
    )
    rows = {r.origin_m49: r for r in flows.lanes(flows.trade_cube(df)).collect()}
    assert set(rows) == {2, 3}
    assert (rows[2].bilateral_import_kg, rows[2].total_imports_kg) == (0.0, 4.0)
    only_null = df.where("partnerCode = 2")
    assert flows.dependency_hhi(only_null).first().hhi is None


def test_mirror_sides(spark):
    df = spark.createDataFrame(
        [
            ("h", 1, 2, 2020, "M", 100.0, 1.0),
            ("h", 2, 1, 2020, "X", 50.0, 1.0),
            ("h", 3, 1, 2020, "X", 7.0, 1.0),
            ("h", 1, 4, 2020, "M", 0.0, 1.0),
        ],
        TRADE,
    )
    got = {(r.destination_m49, r.origin_m49): r for r in trade_flow.mirror_discrepancy(flows.trade_cube(df)).collect()}
    assert set(got) == {(1, 2), (1, 3), (1, 4)}
    assert got[(1, 2)].mtd == 0.5
    assert (got[(1, 3)].m_reported, got[(1, 3)].mtd) == (0.0, 1.0)
    assert got[(1, 4)].mtd is None


def series(spark, *numbers):
    rows = [("h", 1, 2, 2000 + i, float(v)) for i, v in enumerate(numbers)]
    return spark.createDataFrame(
        rows, "commodity_hs string, destination_m49 int, origin_m49 int, period int, bilateral_import_kg double"
    )


@pytest.mark.parametrize(
    "numbers, check",
    [
        ((95, 100, 105, 98, 102, 200), lambda z: z > 2),
        ((100, 200), lambda z: z is None),
        ((10, 10, 10, 10, 10, 10), lambda z: z is None),
        ((100, 100, 100, 100, 100, 500), lambda z: z is None),
    ],
)
def test_volume_anomaly(spark, numbers, check):
    rows = trade_flow.volume_anomaly(series(spark, *numbers)).orderBy("period").collect()
    assert check(rows[-1].z_volume)
    assert all(r.z_volume is None for r in rows[:-1])


def test_sample_deviation(spark):
    rolled = trade_flow.with_rolling(series(spark, 2, 4, 4, 4, 5, 5, 7, 9, 1), ["origin_m49"], "period", "bilateral_import_kg", 8)
    last = rolled.orderBy(F.desc("period")).first()
    assert last.rolling_std == pytest.approx(2.138089935299395)
    assert last.rolling_mean == 5.0


def test_unit_value_zscore_ignores_undefined_peers(spark):
    rows = [("h", 1, o, 2020, "M", kg, usd) for o, kg, usd in ((2, 10.0, 10.0), (3, 10.0, 20.0), (4, 0.0, 5.0), (5, 10.0, 30.0))]
    lanes = flows.lanes(flows.trade_cube(spark.createDataFrame(rows, TRADE)))
    got = {r.origin_m49: (r.unit_value, r.z_uv) for r in trade_flow.unit_value_zscore(lanes).collect()}
    assert got == {2: (1.0, -1.0), 3: (2.0, 0.0), 4: (None, None), 5: (3.0, 1.0)}


def test_shift_needs_the_previous_trade_period(spark):
    rows = [("h", 1, 2, y, "M", 1.0, 1.0) for y in (2019, 2021)] + [("h", 1, 3, 2021, "M", 1.0, 1.0)]
    rows += [("g", 9, 2, y, "M", 1.0, 1.0) for y in (2019, 2020, 2021)]
    cube = flows.trade_cube(spark.createDataFrame(rows, TRADE))
    periods = flows.trade_periods(cube)
    hhi = trade_flow.importer_hhi(flows.lanes(cube))
    got = {(r.commodity_hs, r.period): r.delta_hhi for r in trade_flow.concentration_shifts(hhi, periods).collect()}
    # 2020 exists in the table, so 2019 is not the period before 2021
    assert got[("h", 2021)] is None
    assert got[("g", 2021)] == 0.0
    both = cube.where("period <> 2020")
    again = trade_flow.concentration_shifts(trade_flow.importer_hhi(flows.lanes(both)), flows.trade_periods(both))
    assert {(r.commodity_hs, r.period): r.delta_hhi for r in again.collect()}[("h", 2021)] == -0.5
    shares = trade_flow.delta_ocs(flows.lanes(both), flows.trade_periods(both)).where("commodity_hs = 'h' AND origin_m49 = 2")
    assert [r.delta_ocs for r in shares.orderBy("period").collect()] == [None, -0.5]


def test_anomalies_keep_export_only_lanes(spark, wheat):
    got = {(r.destination_m49, r.origin_m49): r for r in trade_flow.trade_anomalies(flows.trade_cube(wheat)).collect()}
    assert (442, 56) in got and got[(442, 56)].unit_value is None and got[(442, 56)].mtd == 1.0
    flagged = trade_flow.anomaly_flags(trade_flow.trade_anomalies(flows.trade_cube(wheat))).where("mirror_alert").count()
    assert flagged == 5


def pcc(spark, rows):
    return spark.createDataFrame(rows, "commodity_hs string, country_m49 int, period int, pcc double")


def test_consumption_rank(spark):
    rows = [(h, 1, 2020, v) for h, v in zip("abcde", (10.0, 30.0, 20.0, 40.0, 5.0))] + [("a", 2, 2020, 7.0), ("z", 1, 2020, None)]
    got = {(r.country_m49, r.commodity_hs): r.crs for r in consumption.consumption_rank_score(pcc(spark, rows)).collect()}
    assert [got[(1, h)] for h in "abcde"] == [0.25, 0.75, 0.5, 1.0, 0.0]
    assert got[(2, "a")] == 1.0 and (1, "z") not in got


def test_equal_consumption_gets_distinct_ranks(spark):
    rows = [(h, 1, 2020, 3.0) for h in "abc"]
    got = {r.commodity_hs: r.crs for r in consumption.consumption_rank_score(pcc(spark, rows)).collect()}
    assert got == {"a": 1.0, "b": 0.5, "c": 0.0}


@pytest.mark.parametrize(
    "numbers, dis", [([10.0] * 5, 1.0), ([1.0, 100.0, 1.0, 100.0, 1.0], 0.0), ([10.0], None), ([8.0, 10.0, 12.0, 9.0, 11.0], 0.842)]
)
def test_demand_inelasticity(spark, numbers, dis):
    rows = [("h", 1, 2000 + i, v) for i, v in enumerate(numbers)]
    got = consumption.demand_inelasticity(pcc(spark, rows)).first().dis
    assert got == (None if dis is None else pytest.approx(dis, abs=1e-3))


def test_codes_are_read_after_the_sums(spark):
    row = {"period": 2022, "reporterCode": 1, "partnerCode": 2, "flowCode": "M", "netWgt": 1.0, "primaryValue": 2.0}
    codes = ["110220", "110220.0", " 110220", None, "", "ex 1"]
    trade = spark.createDataFrame(
        [(*row.values(), code) for code in codes],
        "period int, reporterCode int, partnerCode int, flowCode string, netWgt double, primaryValue double, cmdCode string",
    )
    cube = flows.trade_cube(trade, normalise=True)
    got = {r.commodity_hs: (r.import_rows, r.import_kg, r.import_usd, r.export_rows, r.export_kg) for r in cube.collect()}
    assert got == {"110220": (3, 3.0, 6.0, 0, 0.0), "": (2, 2.0, 4.0, 0, 0.0), "ex 1": (1, 1.0, 2.0, 0, 0.0)}
    plan = cube._jdf.queryExecution().optimizedPlan().toString()
    first_sums = plan.index("\n", plan.rindex("Aggregate"))
    assert "RLIKE" in plan and "RLIKE" not in plan[first_sums:]
