"""Registered queries against their SQL."""

import os

import duckdb
import pytest

pytest.importorskip("tradelanes.llm")

from tests.llm.conftest import SMALL  # noqa: E402
from tradelanes.llm.registry import QUERIES, SQL  # noqa: E402


def as_rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(r[i] for i in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for file in os.listdir(SMALL):
        con.execute(f"CREATE VIEW {file.split('.')[0]} AS SELECT * FROM '{SMALL}/{file}'")
    found = con.execute(SQL[name])
    want = as_rows([d[0] for d in found.description], found.fetchall())
    df = QUERIES[name](spark, SMALL)
    assert as_rows(df.columns, df.collect()) == want


def test_one_query_for_each_operator():
    assert sorted(int(name.split("_")[0][2:]) for name in QUERIES) == list(range(1, 14))
