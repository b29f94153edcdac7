"""Exposure network, composite score and exploration on small tables."""

import pytest
from pyspark.sql import functions as F

from tradelanes.operators import explore, network, scoring
from tradelanes.operators.scoring import ScoringConfig
from tradelanes.plans import runs
from tradelanes.sources import sinks

EDGES = "origin_m49 int, destination_m49 int, commodity_hs string, bilateral_import_kg double, his double, bdi double"


def test_origin_risk_propagation(spark):
    corridors = spark.createDataFrame([(250, 56, "1001", 1000.0, 0.5, 0.7), (250, 276, "1001", 2000.0, 0.3, 0.1)], EDGES)
    edges = network.exposure_edges(corridors)
    pcc = spark.createDataFrame([(56, "1001", 10.0), (276, "1001", 5.0)], "country_m49 int, commodity_hs string, pcc double")
    assert network.origin_risk_propagation(edges, pcc).first().orps == pytest.approx(3.65)
    assert network.origin_risk_propagation(edges).first().orps == pytest.approx(0.38)
    half = pcc.where("country_m49 = 56")
    assert network.origin_risk_propagation(edges, half).first().orps == pytest.approx(3.5)


def test_attention_exposure(spark):
    corridors = spark.createDataFrame([(250, 56, "1001", 1000.0, 0.4, 0.5), (276, 56, "1006", 500.0, 0.2, 0.3)], EDGES)
    crs = spark.createDataFrame([(56, "1001", 0.8), (56, "1006", 0.6)], "country_m49 int, commodity_hs string, crs double")
    assert network.attention_exposure(network.exposure_edges(corridors), crs).first().acep == pytest.approx(0.196)


def test_edges_fall_back_to_severity(spark):
    df = spark.createDataFrame(
        [(1, 2, "h", None, None, None, 3.0), (1, 3, "h", 5.0, 0.5, 0.0, 3.0)], EDGES + ", severity_total double"
    )
    got = {r.destination_m49: (r.trade_weight, r.hazard_weight, r.dep_weight) for r in network.exposure_edges(df).collect()}
    assert got == {2: (0.0, 0.0, 3.0), 3: (5.0, 0.5, 0.0)}
    assert [r.trade_weight for r in runs.run_network(df).collect()] == [0.0, 0.0]


def test_network_summary(spark):
    df = spark.createDataFrame([(250, 56, "a"), (250, 276, "b")], "origin_m49 int, destination_m49 int, commodity_hs string")
    row = network.network_summary(df).first()
    assert (row.node_count, row.edge_count, row.density) == (3, 2, pytest.approx(2 / 9))
    nothing = network.network_summary(df.where("false")).first()
    assert (nothing.node_count, nothing.edge_count, nothing.density) == (0, 0, 0.0)


def test_links(spark):
    df = spark.createDataFrame([(1, 2, 0.4), (1, 2, 0.2), (3, 2, 0.1)], "origin_m49 int, destination_m49 int, his double")
    links = network.merge_links(df)
    got = {r.origin_m49: (r.corridor_count, r.rel_his) for r in links.collect()}
    assert got == {1: (2, pytest.approx(1.5)), 3: (1, pytest.approx(0.25))}
    assert network.edge_floor(links, 25).count() == 2
    assert network.edge_floor(links, 26).count() == 1
    assert network.edge_floor(links, 0).count() == 2


# ----------------------------------------------------------------------- scoring

SCORED = "commodity_hs string, destination_m49 int, origin_m49 int, sci double, his double, crs double"


@pytest.fixture
def corridors(spark):
    return spark.createDataFrame(
        [("h", 1, 2, 0.2, 1.0, 0.5), ("h", 1, 3, 0.8, 0.0, 1.0), ("h", 1, 4, None, 2.0, 0.1), ("h", 1, 5, 0.5, 3.0, None)], SCORED
    )


def by_origin(df, *columns):
    return {r.origin_m49: tuple(r[c] for c in columns) for r in df.collect()}


def test_missing_inputs_give_no_score(corridors):
    got = by_origin(scoring.score(corridors), "cvs", "cvs_missing_inputs", "cvs_hazard_only")
    assert got[4] == (None, ["sci_norm"], pytest.approx(2 / 3))
    assert got[5] == (None, ["crs_norm"], 1.0)
    assert got[2][1] == [] and got[3][0] == pytest.approx(0.25)  # 1 * 1 * (1 + 0) / 4
    ranked = [r.origin_m49 for r in scoring.rank_scored(scoring.score(corridors)).collect()]
    assert ranked == [3, 2, 4, 5]


def test_hazard_alone_scores_nothing(corridors):
    got = by_origin(scoring.score(corridors.drop("sci", "crs")), "cvs", "cvs_missing_inputs")
    assert list(got.values()) == [(None, ["sci_norm", "crs_norm"])] * 4


@pytest.mark.parametrize("composition", scoring.COMPOSITIONS)
@pytest.mark.parametrize("normalisation", scoring.NORMALISATIONS)
def test_every_method_stays_in_range(corridors, composition, normalisation):
    config = ScoringConfig(normalisation=normalisation, composition=composition)
    rows = scoring.score(corridors, config).where("cvs IS NOT NULL").collect()
    assert len(rows) == 2
    assert all(0 <= r.cvs <= 1 for r in rows)
    if composition == "geometric_mean":
        assert all(r.cvs == 0 for r in rows)  # two of its five inputs are always 0


@pytest.mark.parametrize(
    "settings", [{"alpha": 0.001}, {"alpha": 1.0}, {"w_price": -1.0}, {"normalisation": "x"}, {"composition": "x"}]
)
def test_config_is_checked(settings):
    with pytest.raises(ValueError):
        ScoringConfig(**settings)


# ------------------------------------------------------------------- exploration

METRICS = (
    "commodity_hs string, destination_m49 int, origin_m49 int, destination_country string, origin_country string, "
    "his double, hdi double, notification_count int, severity_total double, destination_roles array<string>, "
    "is_active_destination boolean, cvs double, commodity_name string"
)


@pytest.fixture
def metrics(spark):
    return spark.createDataFrame(
        [
            ("1001", 56, 251, "Belgium", "France", 0.9, 0.5, 4, 2.0, ["followUp", "notifier"], True, 0.4, "wheat, hard"),
            ("1001", 276, 792, "Germany", "Turkey", 0.5, 0.1, 2, 1.0, ["attention"], False, None, 'a "b"'),
            ("0307", 56, 156, "Belgium", "China", 0.1, None, 1, 3.0, ["distribution"], True, 0.0, None),
        ],
        METRICS,
    )


@pytest.mark.parametrize(
    "conditions, origins",
    [
        ({}, [251, 792, 156]),
        ({"commodity": "1001"}, [251, 792]),
        ({"origin": 0, "destination": 0, "commodity": ""}, [251, 792, 156]),
        ({"destination": 56}, [251, 156]),
        ({"min_his": 0.5}, [251, 792]),
        ({"min_hdi": 0.2}, [251]),
        ({"min_cvs": 0.0}, [251, 156]),
        ({"has_cvs": False}, [792]),
        ({"active_only": True}, [251, 156]),
        ({"role": "notifier"}, [251]),
        ({"min_notification_count": 2}, [251, 792]),
        ({"origin_eu": True}, [251]),
        ({"origin_eu": False, "dest_eu": True}, [792, 156]),
        ({"limit": 1}, [251]),
    ],
)
def test_filters(metrics, book, conditions, origins):
    assert [r.origin_m49 for r in explore.filter_corridors(metrics, book, **conditions).collect()] == origins


def test_limits_are_checked(metrics, book):
    with pytest.raises(ValueError):
        explore.filter_corridors(metrics, book, limit=0)
    with pytest.raises(ValueError):
        explore.top_corridors(metrics, 0)


def test_presets(metrics, book):
    got = {r.preset: r.corridors for r in explore.corridor_presets(metrics, book).collect()}
    assert got == {"high_hazard": 2, "active_destination": 2, "notifier": 1, "eu_to_eu": 1, "non_eu_to_eu": 2}


def test_top_and_unknown_metric(metrics):
    assert [r.origin_m49 for r in explore.top_corridors(metrics, 2, "severity_total").collect()] == [156, 251]
    assert [r.origin_m49 for r in explore.top_corridors(metrics, 2, "colour").collect()] == [251, 792]
    assert [r.origin_m49 for r in explore.top_corridors(metrics, 3, "cvs").collect()] == [251, 156, 792]


def test_pages_put_missing_last(metrics):
    for descending, order in ((True, [251, 156, 792]), (False, [156, 251, 792])):
        page = explore.sort_page(metrics, "cvs", ["origin_m49"], descending=descending)
        assert [r.origin_m49 for r in page.collect()] == order
    assert explore.sort_page(metrics, "his", ["origin_m49"], page=1, size=2).count() == 1


def test_search(metrics):
    assert explore.text_search(metrics, ["origin_country", "commodity_name"], "WHEAT").count() == 1
    assert explore.text_search(metrics, ["origin_country"], "  ").count() == 3


def test_dashboard(metrics):
    row = explore.dashboard_kpis(metrics).first()
    assert (row.cvs_available, row.flagged, row.max_score) == (True, 1, 0.4)
    row = explore.dashboard_kpis(metrics.drop("cvs")).first()
    assert (row.cvs_available, row.flagged, row.max_score) == (False, 2, 0.9)
    stats = explore.corridor_view_stats(metrics).first()
    assert (stats.corridors, stats.sum_alerts, stats.with_cvs) == (3, 7, 2)
    assert (stats.top_destination, stats.top_origin, stats.top_commodity) == ("Belgium", "China", "1001")


def test_countries(spark, book):
    rows = explore.list_countries(book.frame(spark), eu_only=True).collect()
    assert len(rows) == 27
    assert [r.name for r in rows if r.m49 == 203] == ["Czech Republic"]
    names = {r.m49: r.name for r in explore.list_countries(book.frame(spark)).collect()}
    assert 0 not in names and names[842] == "USA"  # first by name


def test_export(spark, metrics, tmp_path):
    path = sinks.export_corridors(metrics, str(tmp_path / "out"))
    lines = spark.read.text(path).collect()
    text = "\n".join(r.value for r in lines)
    assert text.count(",".join(sinks.EXPORT_COLUMNS)) >= 1
    assert '"wheat, hard"' in text and '"a ""b"""' in text and "followUp;notifier" in text
    assert any(r.value.endswith(",1.0,,attention") for r in lines)


def test_follow_up_views(corridors):
    scored = scoring.score(corridors)
    assert by_origin(runs.cvs_band(scored), "cvs_band")[3] == ("moderate",)
    assert runs.alert_corridors(scored, 0.2).count() == 1
    assert [r.priority for r in runs.inspection_priority(scored, 2).orderBy("priority").collect()] == [1, 2]
    flags = scored.withColumns({"trade_surge": F.lit(True), "price_drop": F.col("origin_m49") == 2, "rising_alerts": F.lit(True)})
    assert by_origin(runs.convergent_signal(flags), "convergent")[2] == (True,)


@pytest.mark.parametrize("code", ["090421", "90421"])
def test_codes_with_a_leading_zero_meet(spark, code):
    corridors = spark.createDataFrame(
        [("90421", 1, 2, 0.5, "A"), ("90421", 1, 3, 0.7, "B"), ("190421", 1, 2, 0.9, "A"), ("0904", 1, 2, 0.1, "A")],
        "commodity_hs string, destination_m49 int, origin_m49 int, his double, origin_country string",
    )
    names = spark.createDataFrame([("090421", ["chilli", "paprika"]), ("190421", ["flakes"])], "hs_code string, names array<string>")
    rows = explore.commodity_corridors(corridors, names, code).collect()
    assert [(r.hs_code, r.commodity_hs, r.origin_m49, r.names) for r in rows] == [
        ("090421", "90421", 3, ["chilli", "paprika"]), ("090421", "90421", 2, ["chilli", "paprika"]),
    ]
    cells = {(r.origin_country, r.chapter): r.max_his for r in explore.hazard_heatmap(corridors).collect()}
    assert cells == {("A", "09"): 0.5, ("B", "09"): 0.7, ("A", "19"): 0.9}


def test_summary_of_names_takes_the_first_three(spark):
    rows = [(k, f"name {k}", "090421") for k in range(5)] + [(9, "b", "1001"), (8, "a", "1001"), (1, None, "1001"), (2, "x", None)]
    df = spark.createDataFrame(rows, "pos long, commodity string, hs_code string").repartition(4)
    got = [tuple(r) for r in explore.hs_code_summary(df).collect()]
    assert got == [("090421", 5, "name 0, name 1, name 2..."), ("1001", 2, "a, b")]


@pytest.mark.parametrize("descending", [True, False])
def test_pages_far_down_are_those_of_one_sort(spark, monkeypatch, descending):
    rows = [(i, [None, 1.0, float(i % 7), i / 3][i % 4]) for i in range(2_000)]
    df = spark.createDataFrame(rows, "k long, v double").repartition(6)
    known = sorted((r for r in rows if r[1] is not None), key=lambda r: (-r[1] if descending else r[1], r[0]))
    want = [r[0] for r in known + sorted(r for r in rows if r[1] is None)]
    monkeypatch.setattr(explore, "_SHALLOW", 50)
    for page, size in ((0, 25), (1, 25), (2, 25), (30, 33), (3, 500), (199, 10), (200, 10), (9, 1)):
        got = [r.k for r in explore.sort_page(df, "v", ["k"], descending, page, size).collect()]
        assert got == want[page * size : (page + 1) * size], (page, size)


def test_a_deep_page_needs_no_sort_in_one_task(spark):
    df = spark.range(0, 300_000, numPartitions=8).selectExpr("id AS k", "CAST(id % 3 AS DOUBLE) AS v")
    page = explore.sort_page(df, "v", ["k"], page=9_999)
    # 249,975 rows before it: all with 2 and 1, and 49,975 of those with 0
    assert [r.k for r in page.collect()] == [3 * i for i in range(49_975, 50_000)]
    # what is left in the plan reads the rows of one page
    assert "Exchange SinglePartition" not in page._jdf.queryExecution().toString()
