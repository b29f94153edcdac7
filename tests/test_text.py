"""Parsing rules."""

import re

import pytest
from pyspark.sql import functions as F

from tradelanes.functions import periods, text


def apply(spark, build, *given):
    fields = ", ".join(f"a{i} string" for i in range(len(given)))
    df = spark.createDataFrame([tuple(given)], fields)
    return df.select(build(*[F.col(f"a{i}") for i in range(len(given))]).alias("x")).first()["x"]


@pytest.mark.parametrize(
    "given, expected",
    [("110220.0", "110220"), ("030731", "30731"), ("", ""), (None, ""), (" ex 12 ", "ex 12"), ("7", "7"), ("1e3", "1000")],
)
def test_normalise_hs(spark, given, expected):
    assert apply(spark, text.normalise_hs, given) == expected


@pytest.mark.parametrize("given, expected", [("30731", "030731"), ("030731", "030731"), ("110220", "110220"), ("307", "0307")])
def test_six_digit_hs(spark, given, expected):
    assert apply(spark, text.six_digit_hs, given) == expected


@pytest.mark.parametrize(
    "given, expected",
    [
        ("France,Ireland, Netherlands ", ["France", "Ireland", "Netherlands"]),
        (" ,, ", []),
        ("nan", []),
        ("", []),
        (None, []),
        ("NATION_0,NATION_10", ["NATION_0", "NATION_10"]),
    ],
)
def test_split_country_list(spark, given, expected):
    assert apply(spark, text.split_country_list, given) == expected


@pytest.mark.parametrize(
    "given, expected",
    [
        ("Aflatoxin B1 - {mycotoxins},Salmonella - {pathogenic micro-organisms}", "mycotoxins,pathogenic micro-organisms"),
        ("x - { mycotoxins },{mycotoxins}", "mycotoxins,mycotoxins"),
        ("  something else ", "something else"),
        ("", ""),
        (None, ""),
    ],
)
def test_extract_hazard_categories(spark, given, expected):
    assert apply(spark, text.extract_hazard_categories, given) == expected


@pytest.mark.parametrize(
    "given, expected",
    [
        (" Alert Notification ", "AlertNotification"),
        ("border rejection notification", "BorderRejection"),
        ("information for follow-up", "InfoFollowUp"),
        ("", "InfoAttention"),
        (None, "InfoAttention"),
        ("news", "InfoAttention"),
    ],
)
def test_parse_classification(spark, given, expected):
    assert apply(spark, text.parse_classification, given) == expected


@pytest.mark.parametrize(
    "given, expected",
    [("Serious", "Serious"), ("undecided", "PotentialRisk"), (None, "PotentialRisk"), ("not serious", "NotSerious"), ("?", "PotentialRisk")],
)
def test_parse_risk_decision(spark, given, expected):
    assert apply(spark, text.parse_risk_decision, given) == expected


@pytest.mark.parametrize(
    "given, expected",
    [
        ("mycotoxins", "chem_mycotoxins"),
        ("Heavy Metals", "chem_heavy_metals"),
        ("GMO / Novel food", "regulatory"),
        ("unauthorised novel food extract", "regulatory"),
        ("non-pathogenic micro-organisms (other)", "biological"),
        ("residues of veterinary medicinal products", "chem_other"),
        ("something else", "chem_other"),
        ("", "chem_other"),
        (None, "chem_other"),
    ],
)
def test_parse_hazard_type(spark, given, expected):
    assert apply(spark, text.parse_hazard_type, given) == expected


def test_parse_hazard_types_keeps_duplicates(spark):
    assert apply(spark, text.parse_hazard_types, "mycotoxins,, mycotoxins,metals") == [
        "chem_mycotoxins",
        "chem_mycotoxins",
        "chem_heavy_metals",
    ]
    assert apply(spark, text.parse_hazard_types, "") == []
    assert apply(spark, text.parse_hazard_types, None) == []


@pytest.mark.parametrize(
    "dates, expected",
    [
        (("2025-03-14",), 202503),
        ((None, "2024-12-31 10:00:00"), 202412),
        (("", "2024-01-01"), 202401),
        ((None, None), 0),
        (("20250314",), 202503),
        (("202511",), 202511),
        (("soon",), 0),
    ],
)
def test_to_period(spark, dates, expected):
    assert apply(spark, periods.to_period_yyyymm, *dates) == expected


@pytest.mark.parametrize(
    "current, earlier, months",
    [(202612, 202612, 0), (202601, 202512, 1), (202612, 202512, 12), (202612, 202412, 24), (202501, 202512, 0), (202612, 0, 65535)],
)
def test_months_between(spark, current, earlier, months):
    df = spark.createDataFrame([(current, earlier)], "a int, b int")
    got = df.select(periods.months_between_yyyymm(F.col("a"), F.col("b")).alias("m")).first()["m"]
    assert got == months


@pytest.mark.parametrize(
    "name, code",
    [
        ("France", 251),
        (" germany ", 276),
        ("Türkiye", 792),
        ("Viet Nam", 704),
        ("Niger", 562),
        ("Nigeria", 566),
        ("Republic of Nigeria", 562),  # the entry listed first wins a partial match
        ("Czech", 203),
        ("Atlantis", None),
        ("", None),
        (None, None),
    ],
)
def test_country_codes(spark, book, name, code):
    assert apply(spark, book.code_of, name) == code


def test_country_names_and_union(spark, book):
    df = spark.createDataFrame([(203,), (842,), (826,), (999,)], "m int")
    got = [tuple(r) for r in df.select(book.name_of(F.col("m")), book.is_eu(F.col("m"))).collect()]
    assert got == [("Czech Republic", True), ("United States", False), ("United Kingdom", False), (None, False)]
    assert len(book.eu_codes) == 27
    assert book.entries[0][0] == "World"


def test_labels(spark):
    assert apply(spark, lambda c: text.short_label(c, 10), "abcdefghijk") == "abcdefg..."
    assert apply(spark, lambda c: text.short_label(c, 11), "abcdefghijk") == "abcdefghijk"
    assert apply(spark, lambda c: text.truncate(c, 3), "abcd") == "abc..."
    assert apply(spark, lambda c: text.truncate(c, 3), None) == ""
    assert apply(spark, text.route_label, "A", None) == "A → nan"


@pytest.mark.parametrize(
    "date, expected",
    [
        ("15-03-2024 10:11:12", 202403), ("15/03/2024", 202403), ("Mar 15, 2024", 202403), ("15 March 2024", 202403),
        ("03/04/2024", 202403), ("2024/3/15", 202403), ("2024-03-15T10:00:00", 202403), ("soon, maybe", 0),
        ("15 Mar 2024 10:00 AM", 202403), ("03/15/2024 2:30 PM", 202403), ("03/15/2024, 2:30:05 p.m.", 202403),
        ("Fri, 15 Mar 2024", 202403), ("Friday 15 March 2024 23:10", 202403), ("15-Mar-24", 202403), ("15.03.24", 202403),
        ("3/4/24", 202403), ("March 2024", 202403), ("Mar 2024", 202403), ("03/2024", 202403), ("March 15 2024", 202403),
        ("31/12/1999 23:59", 199912), ("15 Mar 2024 25:00", 0), ("Frigg, 15 Mar 2024", 0), ("March", 0), ("45366", 45366),
    ],
)
def test_period_of_other_layouts(spark, date, expected):
    assert apply(spark, periods.to_period_yyyymm, date) == expected


@pytest.mark.parametrize(
    "dates, unread",
    [
        (("2024-03-15", None), False), ((None, "March 2024"), False), ((None, None), False), ((" ", ""), False),
        (("soon", None), True), (("soon", "2024-03-15"), True), (("45366", None), True), (("45312", None), True), (("202403", None), False),
    ],
)
def test_dates_that_were_given_but_not_read(spark, dates, unread):
    assert apply(spark, lambda *d: periods.is_unread(periods.to_period_yyyymm(*d), *d), *dates) == unread


@pytest.mark.parametrize(
    "build",
    [text.parse_hazard_type, text.parse_classification, text.parse_risk_decision, periods.to_period_yyyymm],
)
def test_a_text_is_cleaned_once(spark, build):
    given = spark.createDataFrame([(" Alert ",)], "a string")
    plan = given.select(build(F.concat("a", F.lit("!"))).alias("x"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("concat(") <= 2


def test_lists_tokens_and_dates_read_the_same_compiled_and_by_lambda(spark):
    texts = [
        "a, b", " a ,b", "a,  b", "a,b ,", ",, a", " , ", "", "nan", None, "a,b,c,d", "a,b,c,d, e,f", "a b,c", "a\t, b",
        "x {a}", "{ a },{b }", "{a{ b }", "{ } {c}", "{}", "{ ", "{a , b}, { c }", "heavy metals, Metals,mystery,gmo ,allergens,labelling x",
    ]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    rows = df.select(
        "t",
        text.split_country_list(F.col("t")).alias("names"),
        text.each(text.split_tokens(F.col("t")), F.upper).alias("upper"),
        text.extract_hazard_categories(F.col("t")).alias("categories"),
    ).collect()
    for row in rows:
        parts = [p.strip(" ") for p in (row.t or "").split(",")]
        parts = [p for p in parts if p]
        assert row["names"] == ([] if row.t == "nan" else parts)
        assert row.upper == [p.upper() for p in parts]
        found = [p.strip(" ") for p in re.findall(r"\{([^}]+)\}", (row.t or "").strip(" "))]
        assert row.categories == (",".join(found) if found else (row.t or "").strip(" "))
    dates = {"2024-03-15": 202403, " 2024-12-01 ": 202412, "2024-02-30": 0, "2024-13-01": 0, "2024-03-15 10:00": 202403, "15.03.2024": 202403}
    read = spark.createDataFrame([(d,) for d in dates], "d string").select("d", periods.to_period_yyyymm(F.col("d")).alias("p"))
    assert {r.d: r.p for r in read.collect()} == dates
    # short lists are written out beside the lambda
    plan = df.select(text.each(F.split("t", ","), F.upper))._jdf.queryExecution().optimizedPlan().toString()
    assert "slice(array(" in plan
