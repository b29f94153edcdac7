"""Invariants over the shared tables, and skewed inputs against brute force."""

from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tradelanes.operators import alerts, consumption, dependency, flows, hazard, reports, trade_flow


@pytest.fixture(scope="module")
def dep(shared):
    return dependency.corridor_dependency(shared.trade, shared.production).persist()


def none(df):
    assert df.count() == 0


def test_shares_sum_to_one(dep):
    sums = dep.where("ocs IS NOT NULL").groupBy("commodity_hs", "destination_m49", "period").agg(F.sum("ocs").alias("s"))
    none(sums.where(F.abs(F.col("s") - 1) > 1e-9))


def test_concentration_bounds(dep):
    groups = dep.where("hhi IS NOT NULL AND bilateral_import_kg > 0").groupBy("commodity_hs", "destination_m49", "period").agg(
        F.max("hhi").alias("hhi"), F.count("*").alias("n")
    )
    none(groups.where((F.col("hhi") > 1 + 1e-9) | (F.col("hhi") < 1 / F.col("n") - 1e-9)))


def test_dependency_identities(dep):
    none(dep.where(F.abs(F.col("bdi") - F.col("idr") * F.col("ocs")) > 1e-9))
    none(dep.where((F.col("idr") <= 1) & (F.col("sci") > 2 + 1e-9)))


def test_unit_intervals(shared):
    mtd = trade_flow.mirror_discrepancy(flows.trade_cube(shared.trade))
    none(mtd.where((F.col("mtd") < 0) | (F.col("mtd") > 1)))
    dis = consumption.demand_inelasticity(consumption.per_capita_consumption(shared.balance))
    none(dis.where((F.col("dis") < 0) | (F.col("dis") > 1)))
    none(shared.metrics.where((F.col("hdi") < -1e-9) | (F.col("hdi") > 1 + 1e-9)))


def test_ranks_cover_the_range(shared):
    row = shared.scored.agg(
        *[F.min(f"{n}_norm").alias(f"{n}_lo") for n in ("sci", "his", "crs")],
        *[F.max(f"{n}_norm").alias(f"{n}_hi") for n in ("sci", "his", "crs")],
        F.count("his_norm").alias("n"),
        F.count_distinct("his_norm").alias("distinct"),
    ).first()
    assert [row[f"{n}_lo"] for n in ("sci", "his", "crs")] == [0.0] * 3
    assert [row[f"{n}_hi"] for n in ("sci", "his", "crs")] == [1.0] * 3
    assert row.n == row.distinct


def test_category_credit_adds_up(shared):
    whole = sum((F.col(c) for c in hazard.HAZARD_COLUMNS[1:]), F.col(hazard.HAZARD_COLUMNS[0]))
    none(shared.metrics.where(F.abs(whole - F.col("notification_count")) > 1e-9))


def test_report_concentration_is_the_same_index(shared):
    """The report's index over value is the dependency index over weight, on its scale, when prices are equal."""
    priced = shared.trade.withColumn("primaryValue", F.coalesce("netWgt", F.lit(0.0)))
    one = priced.where("flowCode = 'M' AND cmdCode = '100630' AND period = 1998")
    report = reports.market_concentration(one).select("reporterDesc", (F.col("hhi") / 10000).alias("a"))
    names = one.select("reporterCode", "reporterDesc").distinct()
    own = flows.dependency_hhi(one).select(F.col("destination_m49").alias("reporterCode"), F.col("hhi").alias("b"))
    joined = report.join(names, "reporterDesc").join(own, "reporterCode")
    assert joined.count() > 10
    none(joined.where(F.abs(F.col("a") - F.col("b")) > 1e-9))


# ------------------------------------------------------------------------- skew


@pytest.fixture(scope="module")
def skewed(spark):
    """A third of all rows on one lane."""
    hot = F.col("id") % 3 == 0
    return spark.range(0, 60_000, numPartitions=16).select(
        F.when(hot, "1001").otherwise(F.concat(F.lit("h"), (F.col("id") % 50).cast("string"))).alias("cmdCode"),
        F.when(hot, "wheat").otherwise("other").alias("cmdDesc"),
        F.when(hot, 1).otherwise((F.col("id") % 20).cast("int")).alias("reporterCode"),
        F.when(hot, 2).otherwise((F.col("id") % 7 + 30).cast("int")).alias("partnerCode"),
        F.when(hot, "A").otherwise("B").alias("reporterDesc"),
        F.lit("C").alias("partnerDesc"),
        (F.col("id") % 4 + 2020).cast("int").alias("period"),
        F.when(F.col("id") % 2 == 0, "M").otherwise("X").alias("flowCode"),
        (F.col("id") % 10).cast("double").alias("netWgt"),
        (F.col("id") % 100).cast("double").alias("primaryValue"),
    )


def test_hot_lane_in_the_cube(skewed):
    expected = defaultdict(float)
    for r in skewed.collect():
        if r.flowCode == "M":
            expected[(r.cmdCode, r.reporterCode, r.partnerCode, r.period)] += r.netWgt
    got = {
        (r.commodity_hs, r.reporterCode, r.partnerCode, r.period): r.import_kg
        for r in flows.trade_cube(skewed).where("import_rows > 0").collect()
    }
    assert got == expected


def test_hot_lane_shuffles_few_rows(skewed):
    """Partial sums leave at most one row per key and input partition."""
    cube = flows.trade_cube(skewed)
    assert "partial_sum" in cube._jdf.queryExecution().executedPlan().toString()


def test_hot_corridor_in_hazard(spark):
    """Half of 20,000 notifications touch one corridor."""
    rows = spark.range(0, 20_000, numPartitions=8).select(
        F.concat(F.lit("R"), F.col("id").cast("string")).alias("reference"),
        F.lit("1001").alias("commodity_hs"),
        F.when(F.col("id") % 2 == 0, 1).otherwise((F.col("id") % 40 + 2).cast("int")).alias("origin_m49"),
        F.array(F.lit(99)).alias("affected"),
        F.lit("AlertNotification").alias("classification"),
        F.lit("Serious").alias("risk_decision"),
        F.lit("chem_other").alias("hazard_type"),
        F.lit(202501).alias("period"),
    )
    corridors = rows.select("commodity_hs", F.lit(99).alias("destination_m49"), "origin_m49").distinct()
    got = hazard.corridor_hazard(corridors, rows, F.lit(202503), alpha=0.5)
    hot = got.where("origin_m49 = 1").first()
    assert (hot.notification_count, hot.severity_total) == (10_000, 10_000.0)
    assert hot.his == pytest.approx(2_500.0)
    assert got.agg(F.sum("notification_count")).first()[0] == 20_000


def test_one_reference_for_a_third_of_all_events(spark):
    events = spark.range(0, 9_000, numPartitions=8).select(
        F.col("id").alias("row_id"),
        F.lit(0).alias("pos"),
        F.when(F.col("id") % 3 == 0, "").otherwise(F.concat(F.lit("R"), F.col("id").cast("string"))).alias("reference"),
        F.lit("1001").alias("commodity_hs"),
        F.lit(1).alias("origin_m49"),
        (F.col("id") % 200 + 2).cast("int").alias("destination_m49"),
        F.lit("alert").alias("classification"),
        F.lit("serious").alias("risk_decision"),
        F.lit("metals").alias("hazard_category"),
        F.lit(202501).alias("period"),
    )
    got = alerts.build_notifications(events)
    # without a reference, each row is a notification of its own
    assert got.count() == 9_000
    assert {len(r.affected) for r in got.where("reference = ''").select("affected").distinct().collect()} == {1}
