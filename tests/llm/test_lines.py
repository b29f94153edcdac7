"""Lines shared by many documents, against a plain count."""

import re
from collections import Counter, defaultdict

import pytest

pytest.importorskip("tradelanes.llm")

from tests.llm.conftest import MESSY  # noqa: E402
from tradelanes.llm.line_dedup import drop_shared_lines  # noqa: E402


def key(line):
    return re.sub("[A-Z]", lambda m: m[0].lower(), line.strip(" \t\n\x0b\x0c\r"))


def brute(rows, chars=20, documents=3):
    holders = defaultdict(set)
    for i, text in rows:
        for line in (text or "").split("\n"):
            if len(key(line)) >= chars:
                holders[key(line)].add(i)
    out = Counter()
    for i, text in rows:
        lines = (text or "").split("\n")
        kept = []
        for line in lines:
            found = holders.get(key(line), set())
            if len(found) < documents or i == max((x for x in found if x is not None), default=None):
                kept.append(line)
        out[(i, len(lines), len(lines) - len(kept), "\n".join(kept))] += 1
    return out


def got(df):
    return Counter((r["doc_id"], r["n_lines"], r["n_dropped"], r["kept_text"]) for r in df.collect())


LICENSE = "Permission is granted to anyone to use this"
ROWS = [
    (1, f"first\n{LICENSE}\nlast"),
    (2, f"  {LICENSE.upper()}\t\r\n\n\nx\n{LICENSE}"),
    (3, LICENSE),
    (3, LICENSE),
    (3, f"other text, same number\n{LICENSE}"),
    (4, "Twenty characters ab\nnineteen characters\n\n"),
    (5, "twenty characters AB\nnineteen characters"),
    (6, " twenty characters ab \nnineteen characters"),
    (7, "\x85Twenty characters ab\n twenty characters ab"),
    (8, "ÉTWENTY characters éß\U0001f642 x\n" * 3),
    (9, "Étwenty characters éß\U0001f642 x\nétwenty characters éß\U0001f642 x"),
    (10, "ÉTwenty characters éß\U0001f642 x"),
    (None, f"{LICENSE}\nonly without a number, once"),
    (None, "only without a number, once"),
    (None, None),
    (11, ""),
    (12, "\n" * 50_000),
    (13, "\n".join(f"a line of its own, number {i}" for i in range(20_000)) + f"\n{LICENSE}"),
    (14, None),
]


def test_shared_lines_against_a_plain_count(spark, messy, documents):
    made = spark.createDataFrame(ROWS, "doc_id long, text string").repartition(5)
    assert got(drop_shared_lines(made)) == brute(ROWS)
    assert got(drop_shared_lines(messy)) == brute([r[:2] for r in MESSY])
    rows = [tuple(r) for r in documents.select("doc_id", "text").collect()]
    assert got(drop_shared_lines(documents)) == brute(rows)
    assert any(n for _, _, n, _ in brute(rows))


def test_only_missing_identifiers_are_one_document(spark):
    rows = [(None, LICENSE)] * 4
    assert got(drop_shared_lines(spark.createDataFrame(rows, "doc_id long, text string"))) == brute(rows) == {(None, 1, 0, LICENSE): 4}


def test_other_names_and_thresholds(spark):
    rows = [(f"d{i}", f"same line\nown {i}") for i in range(2)]
    df = drop_shared_lines(spark.createDataFrame(rows, "name string, body string"), "name", "body", 5, 2)
    assert got(df) == {("d0", 2, 1, "own 0"): 1, ("d1", 2, 0, "same line\nown 1"): 1}


def test_a_line_that_every_document_holds(spark):
    df = spark.range(0, 20_000, numPartitions=8).selectExpr("id AS doc_id", f"concat('{LICENSE}\n', id % 10) AS text")
    out = drop_shared_lines(df)
    assert out.groupBy("n_dropped").count().orderBy("n_dropped").collect() == [(0, 1), (1, 19_999)]
    assert out.where("n_dropped = 0").first()["doc_id"] == 19_999


def test_empty(empty):
    assert drop_shared_lines(empty).collect() == []
