"""Data-quality checks and descriptive statistics of a trade table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tradelanes import schemas
from tradelanes.functions.guards import ratio
from tradelanes.operators.ranking import narrowed_quantiles

NULL_CHECKED = ["primaryValue", "netWgt", "reporterDesc", "partnerDesc", "cmdDesc"]


def validate_trade(trade: DataFrame) -> DataFrame:
    """Sixteen checks as ``(check, passed, detail)`` rows.

    The trade rows are read once and reduced to one row per route, commodity,
    period and flow. Every count, distinct count and density comes from that.
    """
    missing = schemas.missing_columns(trade, schemas.TRADE_REQUIRED)
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    keys = ["reporterDesc", "partnerDesc", "cmdCode", "cmdDesc", "period", "flowDesc"]
    cells = trade.groupBy(keys).agg(
        F.count("*").alias("rows"),
        F.count_if(F.col("primaryValue").isNull()).alias("null_primaryValue"),
        F.count_if(F.col("netWgt").isNull()).alias("null_netWgt"),
        F.count_if(F.col("primaryValue") < 0).alias("negative"),
        F.count_if(F.col("primaryValue") == 0).alias("zero"),
    )
    group_key = ["reporterDesc", "partnerDesc", "cmdCode", "period"]
    group = Window.partitionBy(group_key)
    whole_key = F.lit(True)
    for name in group_key:
        whole_key = whole_key & F.col(name).isNotNull()
    cells = cells.withColumns(
        {
            "group_rows": F.when(whole_key, F.sum("rows").over(group)),
            "leads": whole_key & (F.row_number().over(group.orderBy("cmdDesc", "flowDesc")) == 1),
        }
    )

    def rows_where(condition: Column) -> Column:
        return F.coalesce(F.sum(F.when(condition, F.col("rows"))), F.lit(0))

    def added(name: str) -> Column:
        return F.coalesce(F.sum(name), F.lit(0))

    facts = cells.agg(
        added("rows").alias("total_rows"),
        F.sort_array(F.collect_set("period")).alias("periods"),
        F.sort_array(F.collect_set("flowDesc")).alias("flows"),
        added("null_primaryValue").alias("null_primaryValue"),
        added("null_netWgt").alias("null_netWgt"),
        rows_where(F.col("reporterDesc").isNull()).alias("null_reporterDesc"),
        rows_where(F.col("partnerDesc").isNull()).alias("null_partnerDesc"),
        rows_where(F.col("cmdDesc").isNull()).alias("null_cmdDesc"),
        added("negative").alias("negative"),
        added("zero").alias("zero"),
        F.count_distinct("reporterDesc").alias("reporters"),
        F.count_distinct("partnerDesc").alias("partners"),
        F.count_distinct("cmdDesc").alias("commodities"),
        F.max("group_rows").alias("max_rows"),
        F.avg(F.when(F.col("leads"), F.col("group_rows"))).alias("mean_rows"),
    )

    def check(name: str, passed: Column, detail: Column) -> Column:
        return F.struct(
            F.lit(name).alias("check"), passed.alias("passed"), detail.cast("string").alias("detail")
        )

    def none_of(name: str, column: str) -> Column:
        return check(name, F.col(column) == 0, F.col(column))

    def told(name: str, column: Column) -> Column:
        return check(name, F.lit(True), column)

    only_exports = (F.size("flows") == 1) & (F.get("flows", 0) == "Export")
    checks = [
        check("expected_columns_present", F.lit(True), F.lit("all present")),
        told("total_rows", F.col("total_rows")),
        told("periods", F.array_join(F.col("periods").cast("array<string>"), ", ")),
        check("export_only", only_exports, F.array_join("flows", ", ")),
        *[none_of(f"null_{c}", f"null_{c}") for c in NULL_CHECKED],
        none_of("negative_primaryValue", "negative"),
        told("zero_primaryValue", F.col("zero")),
        told("unique_reporters", F.col("reporters")),
        told("unique_partners", F.col("partners")),
        told("unique_commodities", F.col("commodities")),
        told("max_subtransactions_per_group", F.col("max_rows")),
        told("mean_subtransactions_per_group", F.format_string("%.1f", "mean_rows")),
    ]
    return facts.select(F.inline(F.array(*checks)))


def describe_trade(trade: DataFrame) -> DataFrame:
    """Count, mean, deviation, extremes, exact quartiles, total and NULLs of value and weight.

    One aggregation gives all but the quartiles, and the first bounds of
    these; they are narrowed down by two more, see
    :func:`ranking.narrowed_quantiles`. No column is sorted or shuffled.
    """
    columns = ["primaryValue", "netWgt"]
    facts = [
        F.struct(
            F.lit(c).alias("column"),
            F.count(c).alias("count"),
            F.min(c).alias("min"),
            F.max(c).alias("max"),
            F.coalesce(F.sum(c), F.lit(0.0)).alias("total"),
            F.count_if(F.col(c).isNull()).alias("null_count"),
            F.stddev_samp(c).alias("std"),
            ratio(F.sum(c), F.count(c)).alias("mean"),
        ).alias(c)
        for c in columns
    ]
    quartiles, row = narrowed_quantiles(trade, columns, [0.25, 0.5, 0.75], tuple(facts))
    rows = [(*row[c], *quartiles[c]) for c in columns]
    layout = "column string, count long, min double, max double, total double, null_count long, std double, mean double"
    return trade.sparkSession.createDataFrame(rows, f"{layout}, q25 double, q50 double, q75 double")
