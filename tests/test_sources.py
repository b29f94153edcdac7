"""Readers, writers, resuming and quality checks."""

import pytest
from pyspark.sql import functions as F

from tradelanes import schemas
from tradelanes.operators import quality, reports
from tradelanes.sources import resume, scans, sinks

HEAD = ",".join(schemas.TRADE_COLUMNS)
ROW = '2022,620,Portugal,56,Belgium,110220,"Cereal flour; of maize, corn",X,Export,6658.243,3359.0,3359.0,kg'


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "a.csv").write_text(f"{HEAD}\n{ROW}\n{ROW}\n")
    (tmp_path / "b.csv").write_text(
        f"source_from_country,{HEAD}\nPortugal,{ROW}\nPortugal,{ROW.replace('3359.0,3359.0', ',')}\n"
    )
    (tmp_path / "empty.csv").write_text("")
    (tmp_path / "headonly.csv").write_text(HEAD + "\n")
    (tmp_path / "merged.csv").write_text(f"{HEAD}\n{ROW.replace('2022', '1999')}\n")
    (tmp_path / "notes.txt").write_text("not trade")
    return str(tmp_path)


def test_merge_aligns_by_name(spark, folder):
    merged = scans.merge_trade_files(spark, folder, skip="merged.csv")
    rows = merged.collect()
    assert len(rows) == 3  # one from a, two from b
    assert {r.cmdDesc for r in rows} == {"Cereal flour; of maize, corn"}
    assert sorted((r.source_from_country or "", r.netWgt or 0) for r in rows) == [("", 3359.0), ("Portugal", 0), ("Portugal", 3359.0)]
    assert {r.period for r in rows} == {2022}
    assert scans.merge_trade_files(spark, folder, skip="merged.csv", drop_duplicates=False).count() == 4


def test_nothing_to_merge_raises(spark, tmp_path):
    (tmp_path / "empty.csv").write_text("")
    with pytest.raises(FileNotFoundError):
        scans.merge_trade_files(spark, str(tmp_path))


def test_file_list(spark, folder):
    names = [r.file_name for r in scans.list_input_files(spark, folder).collect()]
    assert names == ["a.csv", "b.csv", "headonly.csv", "merged.csv"]


def test_report_of_files(spark, folder):
    (open(f"{folder}/bare.csv", "w")).write("2022,620,Portugal\n2022,621,Spain\n")
    (open(f"{folder}/late.csv", "w")).write("# from reporterCode and cmdCode\n" + ROW + "\n")
    (open(f"{folder}/twice.csv", "w")).write(f"{HEAD}\n{ROW}\ncmdCode,reporterCode\n")
    got = {r.file_name: (r.status, r.header) for r in scans.trade_file_report(spark, folder, skip="merged.csv").collect()}
    assert {name: status for name, (status, _) in got.items()} == {
        "a.csv": "merged", "b.csv": "merged", "headonly.csv": "merged", "twice.csv": "merged", "merged.csv": "left out",
        "bare.csv": "no header", "late.csv": "no header",
    }
    assert got["twice.csv"][1] == HEAD


def test_missing_path_raises(spark, tmp_path):
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        scans.scan_trade(spark, str(tmp_path / "nowhere"))


def test_missing_column_raises(spark, tmp_path):
    spark.range(1).write.parquet(str(tmp_path / "t"))
    with pytest.raises(ValueError, match="primaryValue"):
        scans.scan_trade(spark, str(tmp_path / "t"), "parquet")


def test_bad_numbers_become_null(spark, tmp_path):
    (tmp_path / "t.csv").write_text(f"{HEAD}\n{ROW.replace('6658.243', 'n/a').replace('2022', '2022.0')}\n")
    row = scans.scan_trade_coerced(spark, str(tmp_path)).first()
    assert (row.primaryValue, row.netWgt, row.period, row.cmdCode) == (None, 3359.0, 2022, "110220")


def test_empty_inputs_have_columns(spark):
    assert scans.scan_production(spark).columns == schemas.PRODUCTION.fieldNames()
    assert scans.scan_food_balance(spark).count() == 0


def test_json_payload(spark, tmp_path):
    (tmp_path / "p.json").write_text('{"data":[{"period":2022,"netWgt":1.5},{"period":2023}]}\n{"data":[]}\n{"count":0}\n')
    rows = scans.json_payload_to_rows(spark, str(tmp_path)).collect()
    assert [(r.period, r.netWgt) for r in rows] == [(2022, 1.5), (2023, None)]


def test_commodity_codes_keep_six_digits(spark, tmp_path):
    (tmp_path / "c.csv").write_text("commodity,hs_code_comtrade,faostat_cpc\nMussels,030731,1\nAjwain,90999,2\nAir,,\n")
    assert [r.hs_code for r in scans.scan_commodities(spark, str(tmp_path)).orderBy("pos").collect()] == ["030731", "090999", None]
    short = scans.scan_commodities(spark, str(tmp_path), six_digits=False)
    assert [r.hs_code for r in short.orderBy("pos").collect()] == ["30731", "90999", None]


def test_project_keeps_existing_columns(spark):
    df = spark.createDataFrame([(1, "x", 2.0)], "netWgt int, extra string, period double")
    assert scans.project_trade_columns(df).columns == ["period", "netWgt"]


def test_write_tables_skips_empty(spark, tmp_path):
    none = spark.range(2).where("id < 0")
    tables = {"a": spark.range(2), "b": spark.range(0), "c": none.groupBy("id").count(), "d": spark.range(2).where("false")}
    written = sinks.write_tables(tables, str(tmp_path), "report_")
    assert written == ["a"]
    assert spark.read.parquet(str(tmp_path / "report_a")).count() == 2


def test_resume(spark, tmp_path):
    pairs = spark.createDataFrame([(1, 2, "A", "B"), (1, 3, "A", "C"), (4, 5, "D", "E")], "from_code int, to_code int, from_country string, to_country string")
    progress = spark.createDataFrame([], schemas.PROGRESS)
    trade = spark.createDataFrame([(1, 2, 9.0), (1, 2, 8.0), (1, 3, 7.0)], "reporterCode int, partnerCode int, netWgt double")
    first = resume.pending_pairs(pairs, progress)
    assert first.count() == 3
    path = resume.append_progress(resume.record_progress(first, trade.where("partnerCode = 2")), str(tmp_path / "p"))
    progress = spark.read.parquet(path)
    assert {(r.from_code, r.to_code) for r in resume.pending_pairs(pairs, progress).collect()} == {(1, 3), (4, 5)}
    resume.append_progress(resume.record_progress(resume.pending_pairs(pairs, progress), trade), path)
    spark.catalog.refreshByPath(path)
    status = resume.checkpoint_status(pairs, spark.read.parquet(path)).first()
    assert tuple(status) == (3, 2, 2, 3)
    tagged = resume.tag_source_pair(trade, pairs).select("source_to_country").distinct().collect()
    assert {r[0] for r in tagged} == {"B", "C"}


TRADE = schemas.TRADE


def trade(spark, *rows):
    base = dict(period=2022, reporterCode=1, reporterDesc="A", partnerCode=2, partnerDesc="B", cmdCode="1001", cmdDesc="wheat",
                flowCode="X", flowDesc="Export", primaryValue=1.0, netWgt=1.0, qty=None, qtyUnitAbbr=None)
    return spark.createDataFrame([tuple({**base, **r}[c] for c in TRADE.fieldNames()) for r in rows], TRADE)


def test_validation(spark):
    df = trade(spark, {}, {}, {"primaryValue": -1.0}, {"primaryValue": 0.0, "partnerDesc": None}, {"netWgt": None, "period": 2023})
    got = {r["check"]: (r.passed, r.detail) for r in quality.validate_trade(df).collect()}
    assert len(got) == 16
    assert got["total_rows"] == (True, "5")
    assert got["periods"] == (True, "2022, 2023")
    assert got["export_only"] == (True, "Export")
    assert got["null_netWgt"] == (False, "1") and got["null_partnerDesc"] == (False, "1") and got["null_cmdDesc"] == (True, "0")
    assert got["negative_primaryValue"] == (False, "1") and got["zero_primaryValue"] == (True, "1")
    assert got["max_subtransactions_per_group"] == (True, "3")
    assert got["mean_subtransactions_per_group"] == (True, "2.0")
    with pytest.raises(ValueError):
        quality.validate_trade(df.drop("netWgt"))


def test_describe(spark):
    df = trade(spark, *[{"primaryValue": float(v), "netWgt": None} for v in (1, 2, 3, 4)])
    got = {r["column"]: r for r in quality.describe_trade(df).collect()}
    row = got["primaryValue"]
    assert (row["count"], row["mean"], row["q25"], row["q50"], row["q75"], row["total"]) == (4, 2.5, 1.75, 2.5, 3.25, 10.0)
    assert row["std"] == pytest.approx(1.2909944487)
    empty = got["netWgt"]
    assert (empty["count"], empty["null_count"], empty["mean"], empty["q50"], empty["total"]) == (0, 4, None, None, 0.0)


def test_report_edge_cases(spark):
    one_year = trade(spark, {"primaryValue": 5.0})
    assert reports.yoy_by_route(one_year).count() == 0
    assert reports.hhi_year_shift(one_year).count() == 0
    assert reports.unit_value_slope(one_year).count() == 0
    zero = trade(spark, {"primaryValue": 0.0}, {"reporterDesc": "C", "primaryValue": 3.0})
    assert [r.reporterDesc for r in reports.market_concentration(zero).collect()] == ["C"]
    two = trade(spark, {"primaryValue": 0.0}, {"primaryValue": 4.0, "period": 2023}, {"partnerDesc": "D", "period": 2023})
    got = {r.route: r for r in reports.yoy_by_route(two).collect()}
    assert got["A → B"].yoy_pct is None and got["A → B"].abs_change_usd == 4.0
    assert got["A → D"].value_prev is None and got["A → D"].abs_change_usd is None


def test_small_commodities_fold_into_other(spark):
    df = trade(spark, {"primaryValue": 97.0}, {"cmdDesc": "rye", "primaryValue": 1.5}, {"cmdDesc": "oat", "primaryValue": 1.5})
    got = {r.label: r.value_usd for r in reports.route_commodity_other(df).collect()}
    assert got == {"wheat": 97.0, "Other": 3.0}
    folded = {r.label: r.value_usd for r in reports.reporter_commodity_other(df, commodities=1).collect()}
    assert folded == got


def test_matrix_looks_columns_up(spark):
    df = trade(spark, {"primaryValue": 2.0}, {"partnerDesc": "D", "reporterDesc": "C"})
    got = {r.reporterDesc: r.asDict() for r in reports.reporter_partner_matrix(df).collect()}
    assert got == {"A": {"reporterDesc": "A", "B": 2.0, "D": 0.0}, "C": {"reporterDesc": "C", "B": 0.0, "D": 1.0}}


def test_matrix_drops_nothing(spark):
    df = trade(spark, {"primaryValue": 2.0}, {"partnerDesc": "D", "primaryValue": 4.0}, {"partnerDesc": "D", "reporterDesc": "C"})
    long = reports.reporter_partner_values(df).agg(F.sum("value_usd")).first()[0]
    wide = reports.reporter_partner_matrix(df, ["B"], "other").collect()
    assert {r.reporterDesc: (r.B, r.other) for r in wide} == {"A": (2.0, 4.0), "C": (0.0, 1.0)}
    assert sum(r.B + r.other for r in wide) == long
    with pytest.raises(Exception, match="partnerDesc without a column of its own: D"):
        reports.reporter_partner_matrix(df, ["B"]).collect()
    assert reports.reporter_partner_matrix(df, ["B", "D", "E"]).agg(F.sum("B"), F.sum("D"), F.sum("E")).first() == (2.0, 5.0, 0.0)
    with pytest.raises(ValueError, match="is a column already"):
        reports.reporter_partner_matrix(df, ["B", "other"], "other")
    shares = reports.market_share_matrix(df, ["A"], "other").first()
    assert (shares.A, shares.other) == pytest.approx((6e-6, 1e-6))
    with pytest.raises(Exception, match="period without a column of its own: 2022"):
        reports.unit_value_matrix(df, [2021]).collect()
    missing = df.groupBy().agg(F.lit("r").alias("r"), F.lit(None).cast("string").alias("c"), F.lit(1.0).alias("v"))
    assert reports.matrix(missing, "r", "c", "v", ["B"], "other").first().other == 1.0


def test_csv_keeps_texts_as_they_are(spark, tmp_path):
    rows = [(" leading", "trailing "), ("\ttab", 'a "quoted", text'), ("two\nlines", "plain")]
    path = sinks.write_csv(spark.createDataFrame(rows, "a string, b string"), str(tmp_path / "t"))
    found = spark.read.option("header", True).option("escape", '"').option("multiLine", True).csv(path)
    assert sorted(map(tuple, found.collect())) == sorted(rows)


def test_report_has_sixteen_tables(spark, tmp_path):
    df = trade(spark, {}, {"period": 2023})
    tables = reports.report_tables(df)
    assert len(tables) == 16
    assert sorted(sinks.write_tables(tables, str(tmp_path))) == sorted(tables)


def _file(folder, name, text):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text(text)


def test_columns_are_found_by_name(spark, tmp_path):
    _file(
        tmp_path / "t", "a.csv",
        '"reporterCode",period,reporterDesc,partnerCode,partnerDesc,cmdCode,cmdDesc,flowCode,flowDesc,netWgt,primaryValue\n'
        "251,2022,France,724,Spain,090421,Peppers,M,Import,10,99.5\n",
    )
    row = scans.scan_trade(spark, str(tmp_path / "t")).first()
    assert (row.period, row.reporterCode, row.netWgt, row.primaryValue, row.cmdCode) == (2022, 251, 10.0, 99.5, "090421")


def test_a_missing_column_raises(spark, tmp_path):
    _file(tmp_path / "t", "a.csv", "period,reporterCode\n2022,251\n")
    with pytest.raises(ValueError, match="primaryValue"):
        scans.scan_trade(spark, str(tmp_path / "t"))


def test_rows_follow_file_names_and_keep_line_breaks(spark, tmp_path):
    head = "reference,date,origin,hs_code,classification,risk_decision,commodities\n"
    rows = "".join(f"B{i},2024-01-01,France,110220,alert,serious,maize\n" for i in range(500))
    _file(tmp_path / "n", "part-0.csv", head + 'A,2024-01-01,France,110220,alert,serious,"squid\nfrozen"\n')
    _file(tmp_path / "n", "part-1.csv", head + rows)
    got = scans.scan_notifications(spark, str(tmp_path / "n")).orderBy("row_id").select("reference", "commodities").collect()
    assert [r.reference for r in got] == ["A"] + [f"B{i}" for i in range(500)]
    assert got[0].commodities == "squid\nfrozen"


def test_merge_reads_names_with_blanks_and_quoted_headers(spark, tmp_path):
    _file(tmp_path / "m", "trade France + Spain.csv", '"period","reporterCode","cmdCode"\n2022,251,090421\n')
    _file(tmp_path / "m", "b.csv", "cmdCode,reporterCode,period,extra\n090421,724,2023,x\n")
    got = scans.merge_trade_files(spark, str(tmp_path / "m")).orderBy("period").collect()
    assert [(r.period, r.reporterCode, r.cmdCode, r.extra) for r in got] == [(2022, 251, "090421", None), (2023, 724, "090421", "x")]


def test_indented_payload(spark, tmp_path):
    _file(tmp_path / "j", "a.json", '{\n  "data": [\n    {"period": 2022},\n    {"period": 2023}\n  ]\n}\n')
    assert scans.json_payload_to_rows(spark, str(tmp_path / "j"), whole=True).count() == 2
    with pytest.raises(Exception, match="(?i)malformed"):
        scans.json_payload_to_rows(spark, str(tmp_path / "j")).collect()


def test_packed_files_are_listed_and_merged(spark, tmp_path):
    folder = str(tmp_path / "packed")
    rows = spark.read.schema(schemas.TRADE).csv(spark.sparkContext.parallelize([ROW, ROW.replace("2022", "2023")]))
    sinks.write_csv(rows.coalesce(1), folder, compression="gzip")
    sinks.write_csv(rows.coalesce(1), folder, mode="append", compression="gzip")
    names = [r.file_name for r in scans.list_input_files(spark, folder).collect()]
    assert len(names) == 2 and all(name.endswith(".csv.gz") for name in names)
    assert sorted(map(tuple, scans.merge_trade_files(spark, folder).collect())) == sorted(map(tuple, rows.collect()))


def test_payload_is_read_from_packed_files(spark, tmp_path):
    folder = str(tmp_path / "payload")
    rows = spark.read.schema(schemas.TRADE).csv(spark.sparkContext.parallelize([ROW]))
    document = F.array(F.struct(*rows.columns)).alias("data")
    sinks.write_json(rows.select(document), folder, compression="gzip")
    assert {p.suffix for p in (tmp_path / "payload").glob("part-*")} == {".gz"}
    assert scans.json_payload_to_rows(spark, folder).collect() == rows.collect()
