"""Every registered query against its SQL check, and what its plan may hold."""

import math
import os
import re

import duckdb
import pytest

from catalog import REGISTRY, oracle_text
from catalog.base import tidy
from tradelanes.session import materialise
from conftest import TABLES

TABLE_NAMES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events"]


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for name in TABLE_NAMES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{os.path.join(TABLES, name)}.parquet'")
    return connection


def plain(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return "null"
    return repr(value + 0.0) if isinstance(value, float) else str(value)


@pytest.mark.parametrize("key", list(REGISTRY))
def test_query_matches_sql(shared, duck, key):
    entry = REGISTRY[key]
    df = tidy(entry.build(shared))
    assert {c for c, kind in df.dtypes if kind == "double"} == set(entry.doubles) or entry.sql is None
    columns = sorted(df.columns)
    rows = sorted(tuple(plain(r[c]) for c in columns) for r in df.collect())
    assert rows
    if entry.sql is None:
        return
    result = duck.execute(oracle_text(entry))
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    order = [names.index(c) for c in columns]
    expected = sorted(tuple(plain(r[i]) for i in order) for r in result.fetchall())
    assert rows == expected


def plan_of(df) -> str:
    return df._jdf.queryExecution().toString()


LAZY = [
    "extract_corridors",
    "hazard_summary",
    "corridor_dependency",
    "mirror_discrepancy",
    "volume_anomaly",
    "market_concentration",
    "exports_by_route_year",
    "validate_trade",
    "run_hazard",
    "corridor_enrich",
    "run_scoring",
    "exposure_profile",
]


@pytest.mark.parametrize("key", LAZY)
def test_plan_stays_in_the_engine(shared, key):
    plan = plan_of(REGISTRY[key].build(shared))
    for forbidden in ("CartesianProduct", "BroadcastNestedLoopJoin", "PythonUDF", "ArrowEvalPython", "MapInPandas"):
        assert forbidden not in plan


def test_scan_is_pruned_and_filtered(shared):
    plan = shared.raw._jdf.queryExecution().executedPlan().toString()
    scans = [line for line in plan.splitlines() if "FileScan" in line and "l_returnflag" in line]
    assert scans and all("l_extendedprice" not in s and "l_tax" not in s for s in scans)
    assert any(re.search(r"PushedFilters: .*EqualTo\(l_returnflag,R\)", s) for s in scans)


def test_events_need_no_shuffle(spark, book):
    from test_alerts import raw

    from tradelanes.operators import alerts

    df = raw(spark, {"origin": "France", "notifying_country": "Spain"})
    plan = alerts.extract_corridors(df, book)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan


def test_cube_takes_one_shuffle(shared):
    from tradelanes.operators import flows

    trade = materialise(shared.trade)
    plan = flows.trade_cube(trade)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_ranking_limits_before_it_shuffles(shared):
    from tradelanes.operators import explore

    metrics = shared.hazard.metrics
    plan = explore.exposure_profile(metrics)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan
