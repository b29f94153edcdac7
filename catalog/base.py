"""The registry: each entry is a DataFrame query and, where SQL can say it, the same in SQL."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from catalog.prelude import PRELUDE
from tradelanes.plans.shared_tables import SharedTables


@dataclass(frozen=True)
class Entry:
    build: Callable[[SharedTables], DataFrame]
    sql: str | None
    doubles: tuple[str, ...]


REGISTRY: dict[str, Entry] = {}


def query(key: str, sql: str | None = None, doubles: str = ""):
    """Register a query. ``doubles`` names the double columns of its result."""

    def register(build: Callable[[SharedTables], DataFrame]):
        if key in REGISTRY:
            raise ValueError(f"registered twice: {key}")
        REGISTRY[key] = Entry(build, sql, tuple(doubles.split()))
        return build

    return register


def digits(name: str) -> int:
    """Decimals compared. Sums of cents are exact at 2; millions of them at 8."""
    if "musd" in name:
        return 8
    return 2 if name == "total" or ("usd" in name and "per_kg" not in name) else 6


def _rounded(name: str) -> Column:
    value, places = F.col(f"`{name}`"), digits(name)
    if places != 6:
        return F.round(value, places)
    # the nudge puts exact halves on the same side in every engine
    return F.when(F.abs(value) < 5e-7, F.lit(0.0)).otherwise(F.round(value + 1e-9, 6))


def tidy(df: DataFrame) -> DataFrame:
    """Doubles rounded and arrays joined, so that results compare by value."""
    columns = []
    for field in df.schema.fields:
        value = F.col(f"`{field.name}`")
        if isinstance(field.dataType, T.DoubleType):
            value = _rounded(field.name)
        elif isinstance(field.dataType, T.ArrayType):
            value = F.array_join(value.cast("array<string>"), ";")
        columns.append(value.alias(field.name))
    return df.select(columns)


def _tidy_sql(sql: str, doubles: tuple[str, ...]) -> str:
    if not doubles:
        return sql
    parts = []
    for name in doubles:
        places = digits(name)
        text = f'round("{name}", {places})'
        if places == 6:
            text = f'CASE WHEN abs("{name}") < 5e-7 THEN 0.0::DOUBLE ELSE round("{name}" + 1e-9, 6) END'
        parts.append(f'{text} AS "{name}"')
    return f"SELECT * REPLACE ({', '.join(parts)}) FROM ({sql}) AS result"


def with_prelude(sql: str) -> str:
    """Put the common table expressions a statement uses in front of it."""
    needed: list[str] = []

    def visit(text: str) -> None:
        for word in dict.fromkeys(re.findall(r"(?:FROM|JOIN)\s+([a-z_0-9]+)", text)):
            if word in PRELUDE and word not in needed:
                visit(PRELUDE[word])
                needed.append(word)

    visit(sql)
    if not needed:
        return sql
    ctes = ",\n".join(f"{name} AS (\n{PRELUDE[name].strip()}\n)" for name in needed)
    return f"WITH {ctes}\n{sql}"


def significant(sql: str) -> str:
    """``stable(x)`` of the checks written out: twelve significant digits of ``x``."""
    while found := re.search(r"\bstable\(", sql):
        depth, end = 1, found.end()
        while depth:
            depth += {"(": 1, ")": -1}.get(sql[end], 0)
            end += 1
        x = sql[found.end() : end - 1]
        places = f"11 - CAST(floor(log10(nullif(abs({x}), 0))) AS INTEGER)"
        sql = f"{sql[: found.start()]}coalesce(round(CAST({x} AS DOUBLE), {places}), {x}){sql[end:]}"
    return sql


def oracle_text(entry: Entry) -> str:
    return significant(with_prelude(_tidy_sql(entry.sql.strip(), entry.doubles)))


def runner(entry: Entry) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, folder: str) -> DataFrame:
        return tidy(entry.build(SharedTables(spark, folder)))

    return run
