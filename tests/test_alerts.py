"""From raw notifications to hazard metrics, on hand-made cases."""

import re

import pytest
from pyspark.sql import functions as F

from tradelanes.operators import alerts, hazard
from tradelanes.plans import runs

FIELDS = [
    "row_id", "reference", "date", "origin", "notifying_country", "distribution", "for_followUp",
    "for_attention", "hs_code", "commodities", "classification", "risk_decision", "hazards",
]
SCHEMA = ", ".join(f"{f} {'bigint' if f == 'row_id' else 'string'}" for f in FIELDS)


def raw(spark, *rows):
    full = []
    for i, row in enumerate(rows):
        base = dict.fromkeys(FIELDS)
        base.update(row_id=i, reference=f"R{i}", date="2025-03-14", hs_code="110220", commodities="maize flour")
        base.update(row)
        full.append(tuple(base[f] for f in FIELDS))
    return spark.createDataFrame(full, SCHEMA)


def test_multiple_origins_skip_self_trade(spark, book):
    df = raw(spark, {"origin": "France,Ireland,Netherlands", "for_followUp": "Netherlands"})
    got = {(r.origin_country, r.destination_m49) for r in alerts.extract_corridors(df, book).collect()}
    assert got == {("France", 528), ("Ireland", 528)}
    summary = alerts.hazard_summary(df, book).first()
    assert (summary.total_corridors, summary.self_trade_pairs_skipped) == (2, 1)


def test_roles_are_united(spark, book):
    df = raw(spark, {"origin": "France", "notifying_country": "Spain", "for_attention": "spain,Italy"})
    got = {
        r.destination_m49: (r.destination_country, r.destination_roles, r.is_active_destination)
        for r in alerts.extract_corridors(df, book).collect()
    }
    assert got == {724: ("Spain", ["attention", "notifier"], True), 380: ("Italy", ["attention"], False)}


def test_destinations_are_worked_out_once(spark, book):
    df = raw(
        spark,
        {"notifying_country": "spain", "distribution": "Mu,UK,Spain", "for_followUp": "United Kingdom,UK", "for_attention": "Italy,Spain"},
        {"notifying_country": "Lemuria", "distribution": "nan"},
        {},
        {"row_id": None, "reference": None, "for_followUp": "Ghana,Mali,Italy,Malta,Ghana"},
    )
    found = alerts.collect_destinations(df, book)
    got = {(r.row_id, r.destination_m49): tuple(r)[1:3] + (r.destination_roles,) for r in found.collect()}
    assert got == {
        (0, 724): ("R0", "spain", ["attention", "distribution", "notifier"]),
        (0, 826): ("R0", "UK", ["distribution", "followUp"]),
        (0, 380): ("R0", "Italy", ["attention"]),
        (None, 288): ("", "Ghana", ["followUp"]), (None, 466): ("", "Mali", ["followUp"]),
        (None, 380): ("", "Italy", ["followUp"]), (None, 470): ("", "Malta", ["followUp"]),
    }
    assert found.count() == len(got)
    # a filter pushed below the lists would name all of them anew
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("array_except(") == 1


def test_unknown_countries(spark, book):
    df = raw(
        spark,
        {"origin": "Atlantis", "notifying_country": "Lemuria"},
        {"origin": "France", "distribution": "Mu"},
        {"origin": None, "distribution": "Spain"},
    )
    assert alerts.extract_corridors(df, book).count() == 0
    names = {tuple(r) for r in alerts.unmapped_countries(df, book).collect()}
    assert names == {("origin", "Atlantis"), ("destination", "Mu")}
    s = alerts.hazard_summary(df, book).first()
    assert (s.total_notifications, s.notifications_without_origin, s.notifications_without_destination) == (3, 2, 1)
    assert (s.unmapped_origins, s.unmapped_destinations) == (1, 1)


def test_summary_counts_dates_not_read(spark, book):
    df = raw(
        spark,
        {"origin": "France,Italy", "distribution": "Spain", "date": "the ides of March"},
        {"origin": "France", "distribution": "Spain", "date": "45366"},
        {"origin": "France", "distribution": "Spain", "date": "Fri, 15 Mar 2024 2:30 PM"},
        {"origin": None, "distribution": "Spain", "date": None},
    )
    summary = alerts.hazard_summary(df, book).first()
    assert (summary.total_notifications, summary.unread_dates) == (4, 2)


def test_missing_period_drops_notification_but_keeps_roles(spark, book):
    df = raw(
        spark,
        {"origin": "France", "notifying_country": "Spain", "date": None},
        {"origin": "France", "notifying_country": "Spain", "hs_code": None},
    )
    events = alerts.extract_corridors(df, book)
    assert alerts.build_notifications(events).count() == 0
    counts = alerts.role_counts(events).collect()
    assert len(counts) == 1 and counts[0].role_notifier == 1
    run = runs.run_hazard(df, book)
    row = run.metrics.first()
    assert (row.his, row.hdi, row.notification_count, row.severity_total) == (0.0, 0.0, 0, 0.0)
    assert run.current_period.first()[0] == 202600


def test_first_seen_attributes_win(spark, book):
    df = raw(
        spark,
        {"reference": "A", "origin": "France", "notifying_country": "Spain", "classification": "alert"},
        {"reference": "A", "origin": "France", "notifying_country": "Italy", "classification": "border rejection", "hs_code": "100630"},
    )
    got = alerts.build_notifications(alerts.extract_corridors(df, book)).collect()
    assert len(got) == 1
    assert got[0].affected == [380, 724]
    assert (got[0].classification, got[0].commodity_hs) == ("AlertNotification", "110220")


def test_hazard_metrics(spark, book):
    common = {"origin": "France", "notifying_country": "Spain", "classification": "alert", "risk_decision": "serious"}
    df = raw(
        spark,
        {**common, "hazards": "a - {mycotoxins},b - {pathogenic micro-organisms}"},
        {**common, "date": "2025-02-01", "hazards": "{mycotoxins},{mycotoxins}"},
        {**common, "date": "2024-12-01", "hazards": None, "classification": None, "risk_decision": "not serious"},
    )
    row = runs.run_hazard(df, book).metrics.first()
    assert row.his == pytest.approx(1.0 + 0.9 + 0.1 * 0.9**3)
    assert (row.notification_count, row.severity_total) == (3, pytest.approx(2.1))
    assert (row.biological, row.chem_mycotoxins, row.chem_other) == (0.5, 1.5, 1.0)
    assert 0 < row.hdi < 1
    single = hazard.corridor_hazard(
        alerts.corridor_base(alerts.extract_corridors(df, book)),
        alerts.build_notifications(alerts.extract_corridors(df, book)),
        F.lit(202503),
    ).first()
    # without the listed categories each notification counts under one type
    assert (single.biological, single.chem_mycotoxins, single.chem_other) == (1.0, 1.0, 1.0)


def test_duplicate_tokens_are_one_category(spark, book):
    df = raw(spark, {"origin": "France", "notifying_country": "Spain", "hazards": "{mycotoxins},{mycotoxins}"})
    row = runs.run_hazard(df, book).metrics.first()
    assert (row.chem_mycotoxins, row.hdi) == (1.0, 0.0)


def test_missing_role_columns_are_tolerated(spark, book):
    df = raw(spark, {"origin": "France", "notifying_country": "Spain"}).drop("distribution", "for_attention")
    assert alerts.extract_corridors(df, book).count() == 1


def test_blank_reference_has_no_category_map(spark, book):
    df = raw(spark, {"origin": "France", "notifying_country": "Spain", "reference": None, "hazards": "{metals}"})
    events = alerts.extract_corridors(df, book)
    assert alerts.hazard_category_map(events).count() == 0
    assert runs.run_hazard(df, book).metrics.first().chem_heavy_metals == 1.0


def test_detection_gap(spark):
    lanes = spark.createDataFrame(
        [("h", 1, 2, 60.0, 100.0), ("h", 1, 3, 40.0, 100.0), ("h", 9, 2, 5.0, 5.0)],
        "commodity_hs string, destination_m49 int, origin_m49 int, bilateral_import_kg double, total_imports_kg double",
    )
    notifications = spark.createDataFrame(
        [("h", 3, [1]), ("h", 3, [1]), ("h", 2, [1, 7]), ("h", 2, [1])],
        "commodity_hs string, origin_m49 int, affected array<int>",
    )
    got = {(r.destination_m49, r.origin_m49): r.dgi for r in hazard.detection_gap(lanes, notifications).collect()}
    assert got[(1, 2)] == pytest.approx(0.1)
    assert got[(1, 3)] == pytest.approx(-0.1)
    assert got[(9, 2)] is None


def test_trade_pairs(spark, book):
    df = raw(
        spark,
        {"origin": "France", "for_followUp": "Spain, Atlantis,France"},
        {"origin": "France", "for_followUp": "Spain", "hs_code": "030731.0"},
        {"origin": None, "for_followUp": "Spain"},
    )
    pairs = alerts.extract_trade_pairs(df, book)
    assert {(r.to_country, r.to_code) for r in pairs.collect()} == {("Spain", 724), ("Atlantis", None), ("France", 251)}
    codes = alerts.pair_hs_codes(pairs).collect()
    assert [(r.from_code, r.to_code, r.hs_codes, r.hs_code_count) for r in codes] == [(251, 724, ["110220", "30731"], 2)]
    assert alerts.pair_hs_codes(pairs, exclude_self=False).count() == 2
    assert alerts.unique_country_pairs(pairs).count() == 2
    assert {r.country for r in alerts.unique_followups(df, book).collect()} == {"Spain", "France"}


def test_followup_notifications(spark, book):
    df = raw(
        spark,
        {"origin": "France", "for_followUp": "Spain,Atlantis,Spain"},
        {"origin": "France", "for_followUp": None},
        {"origin": "Atlantis", "for_followUp": "Spain"},
    ).withColumn("period", F.lit(202501))
    got = alerts.build_notifications_followup(df, book).collect()
    assert [(r.row_id, r.affected, r.hazard_type) for r in got] == [(0, [724, 724], "chem_other")]


def test_alerts_without_reference_stay_apart(spark, book):
    common = {"reference": None, "origin": "France", "classification": "alert", "risk_decision": "serious"}
    df = raw(
        spark,
        {**common, "hs_code": "110220", "notifying_country": "Spain"},
        {**common, "hs_code": "100630", "notifying_country": "Italy"},
    )
    got = alerts.build_notifications(alerts.extract_corridors(df, book)).orderBy("commodity_hs").collect()
    assert [r.commodity_hs for r in got] == ["100630", "110220"]


def test_events_are_paired_from_written_notifications(spark, book):
    df = raw(
        spark,
        {"origin": "UK,France,United Kingdom,UK", "notifying_country": "Spain", "distribution": "France,Atlantis,spain"},
        {"origin": "United Kingdom", "for_attention": "Spain", "commodities": "later"},
        {"origin": "Spain", "notifying_country": "Spain", "reference": "self", "hazards": "none"},
        {"origin": "Spain,France", "notifying_country": "Spain", "reference": "some", "hazards": "{x}"},
    )
    run = runs.run_hazard(df, book)
    order = ["row_id", "pos"]
    shown = ["row_id", "origin_country", "destination_country", "destination_roles"]
    got = [tuple(r) for r in run.events.orderBy(order).select(shown).collect()]
    both = ["distribution", "notifier"]
    assert got == [
        (0, "UK", "Spain", both), (0, "UK", "France", ["distribution"]), (0, "France", "Spain", both),
        (0, "United Kingdom", "Spain", both), (0, "United Kingdom", "France", ["distribution"]),
        (0, "UK", "Spain", both), (0, "UK", "France", ["distribution"]),
        (1, "United Kingdom", "Spain", ["attention"]), (3, "France", "Spain", ["notifier"]),
    ]
    assert got == [tuple(r) for r in alerts.extract_corridors(df, book).orderBy(order).select(shown).collect()]
    parsed = alerts.parse_notifications(df, book)
    texts = sorted(map(tuple, alerts.hazard_category_map(alerts.eventful(parsed)).collect()))
    assert texts == [("R0", ""), ("R1", ""), ("some", "x")]
    assert texts == sorted(map(tuple, alerts.hazard_category_map(run.events).collect()))


def test_corridor_names_are_summed_in_hash_tables(spark, book):
    df = raw(
        spark,
        {"row_id": 7, "origin": "United Kingdom", "notifying_country": "Spain", "commodities": "later"},
        {"row_id": 3, "origin": "UK,United Kingdom,UK", "notifying_country": "Spain", "commodities": "flour"},
        {"row_id": None, "origin": "Italy", "notifying_country": "spain", "commodities": "unnumbered"},
        {"row_id": -9, "origin": "italy", "notifying_country": "Spain", "commodities": "negative"},
    )
    base = alerts.corridor_base(alerts.extract_corridors(df, book))
    got = {r.origin_m49: r for r in base.collect()}
    assert (got[826].commodity_name, got[826].origin_country, got[826].event_count, got[826].role_notifier) == ("flour", "UK", 4, 4)
    assert (got[380].commodity_name, got[380].destination_country, got[380].event_count) == ("unnumbered", "spain", 2)
    plan = base._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"HashAggregate\(keys=\[[^]]*commodity_name[^]]*\], functions=\[partial_min", plan)


def test_notifications_are_grouped_without_their_events(spark, book):
    df = raw(
        spark,
        {"reference": "A", "row_id": 5, "origin": "UK,France,United Kingdom", "notifying_country": "France", "distribution": "Yemen,Austria",
         "hazards": "{metals},{mycotoxins}", "classification": "Border Rejection"},
        {"reference": "A", "row_id": 2, "origin": "France", "notifying_country": "France", "hazards": "{metals}"},
        {"reference": "A", "row_id": 9, "origin": "Spain,France", "notifying_country": "Spain", "for_attention": "World,Ghana", "hs_code": "100630"},
        {"reference": "B", "origin": "France", "notifying_country": "Spain", "hs_code": None},
        {"reference": None, "origin": "France", "notifying_country": "Spain", "hazards": "{mycotoxins},{mycotoxins},{metals}"},
        {"reference": None, "origin": "France", "notifying_country": "Italy", "row_id": None},
    )
    parsed = alerts.parse_notifications(df, book)
    groups = alerts.notifications_with_credit(parsed, book)
    paired = alerts.build_notifications(alerts.events_of(parsed))
    found = lambda rows: sorted((str(tuple(r)) for r in rows.select(paired.columns).collect()))
    assert found(alerts.usable(groups)) == found(paired)
    assert groups.count() == paired.count() + 1
    places = {(r.reference, r.origin_m49): tuple(r.first) for r in groups.where("reference <> ''").collect()}
    assert places == {("A", 826): (5, 0), ("A", 251): (5, 4), ("A", 724): (9, 1), ("B", 251): (3, 0)}
    plan = groups._jdf.queryExecution().optimizedPlan().toString()
    assert "posexplode(origins" in plan and "explode(destinations" not in plan
    # what a reference lists first counts for all its origins; blank ones have a single type
    credited = hazard.with_listed_credit(groups).where("affected[0] <> 380")
    got = {(r.reference, r.origin_m49): (r.chem_heavy_metals, r.chem_mycotoxins, r.chem_other) for r in credited.collect()}
    assert got == {
        ("A", 826): (0.5, 0.5, 0.0), ("A", 251): (0.5, 0.5, 0.0), ("A", 724): (0.5, 0.5, 0.0), ("B", 251): (0.0, 0.0, 1.0),
        ("", 251): (1.0, 0.0, 0.0),
    }


def test_rows_of_files_reach_the_corridors(spark, book):
    rows = raw(
        spark,
        {"origin": "UK", "notifying_country": "Spain", "commodities": "later"},
        {"origin": "United Kingdom", "notifying_country": "Spain", "commodities": "flour"},
    )
    place = F.struct(F.lit("a.csv").alias("file"), F.lit(0).alias("block"), (-F.col("row_id")).alias("row"))
    row = runs.run_hazard(rows.withColumn("row_id", place), book).metrics.first()
    assert (row.commodity_name, row.origin_country, row.event_count, row.notification_count) == ("flour", "United Kingdom", 2, 2)
