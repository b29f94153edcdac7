"""Ranks, normalisation and quantiles that never sort a whole table in one task.

A rank over a whole table needs one order for all rows. It is built in three
parts: cut points from approximate quantiles split the values into slots, rows
are numbered inside their slot, and the running row count of the slots before
is added. The cut points decide only how even the slots are, never a rank.
A value frequent enough to be a cut point gets a slot of its own, which is
spread further by the tie-break, so a value shared by a third of all rows does
not end up in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from tradelanes.functions.guards import stable

#: Upper bound on the cut points, so the literal in the plan and the offset
#: table stay small whatever the size of the input.
MAX_CUTS = 256
#: Parts a single-value slot is spread over.
TIE_PARTS = 64


def tie_break(keys: list[str]) -> Column:
    """A fixed order among equal values, evenly spread whatever the keys are."""
    return F.md5(F.concat_ws("|", *[F.col(k).cast("string") for k in keys]))


def _cut_count(df: DataFrame) -> int:
    parallel = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(2, min(MAX_CUTS, parallel))


def cut_points(df: DataFrame, columns: list[str]) -> dict[str, list[float]]:
    """Distinct approximate quantiles per column, all from one aggregate row."""
    count = _cut_count(df)
    shares = [i / count for i in range(1, count)]
    row = df.agg(
        *[F.percentile_approx(stable(F.col(c)), shares, count * 20).alias(c) for c in columns]
    ).first()
    return {c: sorted(set(row[c] or [])) for c in columns}


def _slot(value: Column, cuts: list[float]) -> tuple[Column, Column]:
    """Slot number, rising with the value, and whether the slot holds one value only."""
    points = F.array(*[F.lit(float(c)) for c in cuts]).cast("array<double>")
    below = F.size(F.filter(points, lambda point: point < value))
    single = F.array_contains(points, value)
    return below * 2 + single.cast("int"), single


def ordinal_rank(
    df: DataFrame, value: str, keys: list[str], out: str, cuts: list[float] | None = None
) -> DataFrame:
    """Add the ascending 0-based rank of ``value`` as ``out`` and the ranked rows as ``out_n``.

    Equal values get distinct ranks. NULL values are not ranked. ``df`` is read
    more than once; pass a stored or materialised frame.
    """
    if cuts is None:
        cuts = cut_points(df, [value])[value]
    measure = stable(F.col(value))
    slot, single = _slot(measure, cuts)
    tie = tie_break(keys)
    part = F.conv(F.substring(tie, 1, 4), 16, 10).cast("int") % TIE_PARTS
    ordered_part = F.floor(F.conv(F.substring(tie, 1, 4), 16, 10).cast("int") * TIE_PARTS / 65536)
    slotted = df.withColumns(
        {
            "_value": measure,
            "_tie": tie,
            "_slot": F.when(measure.isNull(), -1).otherwise(slot),
            "_part": F.when(measure.isNull(), part)
            .when(single, ordered_part.cast("int"))
            .otherwise(0),
        }
    )
    sizes = slotted.where("_slot >= 0").groupBy("_slot", "_part").agg(F.count("*").alias("_size"))
    # at most (2 * MAX_CUTS + 1) * TIE_PARTS rows
    order = Window.orderBy("_slot", "_part")
    before = F.sum("_size").over(order.rowsBetween(Window.unboundedPreceding, -1))
    offsets = sizes.select(
        "_slot",
        "_part",
        F.coalesce(before, F.lit(0)).alias("_before"),
        F.sum("_size").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("_all"),
    )
    inside = Window.partitionBy("_slot", "_part").orderBy("_value", "_tie")
    numbered = slotted.withColumn("_row", F.row_number().over(inside) - 1)
    ranked = numbered.join(F.broadcast(offsets), ["_slot", "_part"], "left")
    return ranked.withColumn(out, F.col("_before") + F.col("_row")).withColumn(
        f"{out}_n", F.col("_all")
    ).drop("_value", "_tie", "_slot", "_part", "_row", "_before", "_all")


def normalise_percentile_rank(
    df: DataFrame, value: str, keys: list[str], out: str, cuts: list[float] | None = None
) -> DataFrame:
    """Ordinal rank over the valid count less one; a single valid row gets 1.0."""
    ranked = ordinal_rank(df, value, keys, "_rank", cuts)
    share = F.when(F.col("_rank_n") > 1, F.col("_rank") / (F.col("_rank_n") - 1))
    single = F.when(F.col("_rank_n") == 1, F.lit(1.0))
    return ranked.withColumn(out, F.coalesce(share, single)).drop("_rank", "_rank_n")


def normalise_log_percentile(
    df: DataFrame, value: str, keys: list[str], out: str, cuts: list[float] | None = None
) -> DataFrame:
    """Percentile rank of ``ln(1 + x)``; ``cuts``, if given, are those of the logarithm."""
    logged = df.withColumn("_log", F.log1p(F.col(value)))
    return normalise_percentile_rank(logged, "_log", keys, out, cuts).drop("_log")


def normalise_min_max(df: DataFrame, value: str, out: str) -> DataFrame:
    """Scale to [0, 1] by the smallest and largest value; all equal gives 0.5."""
    low = df.agg(F.min(value)).scalar()
    high = df.agg(F.max(value)).scalar()
    x = F.col(value)
    scaled = F.when(high == low, F.lit(0.5)).otherwise(F.try_divide(x - low, high - low))
    return df.withColumn(out, F.when(x.isNotNull(), scaled))


def exact_quantiles(counts: DataFrame, value: str, probs: list[float]) -> DataFrame:
    """Linearly interpolated quantiles from a ``(value, count)`` table, as one row ``q0, q1, ...``.

    Works on distinct values with their counts, so repeats cost nothing, and
    numbers the values slot by slot. ``counts`` must be stored or materialised.
    """
    cuts = cut_points(counts, [value])[value]
    points = F.array(*[F.lit(float(c)) for c in cuts]).cast("array<double>")
    slot = F.size(F.filter(points, lambda point: point < stable(F.col(value))))
    slotted = counts.where(F.col(value).isNotNull()).withColumn("_slot", slot)
    sizes = slotted.groupBy("_slot").agg(F.sum("count").alias("_size"))
    order = Window.orderBy("_slot")  # at most MAX_CUTS + 1 rows
    offsets = sizes.select(
        "_slot",
        F.coalesce(
            F.sum("_size").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
        ).alias("_before"),
        F.sum("_size").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("_all"),
    )
    inside = Window.partitionBy("_slot").orderBy(value)
    placed = (
        slotted.withColumn("_end", F.sum("count").over(inside))
        .join(F.broadcast(offsets), "_slot")
        .withColumn("_end", F.col("_end") + F.col("_before"))
        .withColumn("_start", F.col("_end") - F.col("count"))
    )
    picks = []
    for i, prob in enumerate(probs):
        position = F.lit(prob) * (F.col("_all") - 1)
        for tag, index in (("lo", F.floor(position)), ("hi", F.ceil(position))):
            here = (F.col("_start") <= index) & (index < F.col("_end"))
            picks.append(F.max(F.when(here, F.col(value))).alias(f"_{tag}{i}"))
    row = placed.agg(F.max("_all").alias("_all"), *picks)
    results = []
    for i, prob in enumerate(probs):
        position = F.lit(prob) * (F.col("_all") - 1)
        weight = position - F.floor(position)
        low, high = F.col(f"_lo{i}"), F.col(f"_hi{i}")
        results.append((low + (high - low) * weight).alias(f"q{i}"))
    return row.select(*results)


#: Relative error of the approximate quantiles that narrow a range, and the rows in a range that are few enough to be ordered.
_ERROR = 10_000
_FEW = 10_000


def narrowed_quantiles(
    df: DataFrame, columns: list[str], probs: list[float], facts: tuple[Column, ...] = ()
) -> tuple[dict[str, list[float | None]], Row]:
    """Linearly interpolated quantiles of some columns, exact, without moving the columns; and ``facts`` of one row.

    A quantile lies between two neighbouring ranks. Each is kept in a range of
    values that surely holds both ranks: approximate quantiles give the range,
    and a count of the rows below it and in it proves it. Ranges are narrowed
    until few rows are left, or frequent values alone; only the distinct
    values in them are then counted and put in order. Every step is one
    aggregation of all ranges together, and a step leaves at most a few ten
    thousandths of the rows, so there are two or three of them at any size.
    ``facts`` are further aggregates, which the first step takes along.
    Missing values are left out; a column without values gives None.
    """
    ends = (("n", F.count), ("lo", F.min), ("hi", F.max))
    shares = [min(max(p + side * 3 / _ERROR, 0.0), 1.0) for p in probs for side in (-1, 1)]
    first = df.agg(
        *[f(c).alias(f"_{tag}_{c}") for c in columns for tag, f in ends],
        *[F.percentile_approx(c, shares, _ERROR).alias(f"_cuts_{c}") for c in columns],
        *facts,
    ).first()
    ranges, wide, tried = [], [], []
    for c in columns:
        n, lo, hi, cuts = (first[f"_{tag}_{c}"] for tag in ("n", "lo", "hi", "cuts"))
        for i, p in enumerate(probs):
            place = p * (n - 1)
            r = {
                "column": c, "place": place, "low": int(place), "high": min(int(place) + 1, max(n - 1, 0)),
                "lo": lo, "hi": hi, "below": 0, "inside": n,
            }
            ranges.append(r)
            if n > _FEW and lo < hi:
                wide.append(r)
                tried.append(r | {"lo": cuts[2 * i], "hi": cuts[2 * i + 1]})

    def within(r: dict) -> Column:
        return F.col(r["column"]).between(F.lit(r["lo"]), F.lit(r["hi"]))

    while wide:
        counts = df.agg(*[
            count.alias(f"{tag}{i}")
            for i, r in enumerate(tried)
            for tag, count in (("below", F.count_if(F.col(r["column"]) < F.lit(r["lo"]))), ("inside", F.count_if(within(r))))
        ]).first()
        further = []
        for i, (r, new) in enumerate(zip(wide, tried, strict=True)):
            below, inside = counts[f"below{i}"], counts[f"inside{i}"]
            if below <= r["low"] and r["high"] < below + inside and inside < r["inside"]:
                r.update(lo=new["lo"], hi=new["hi"], below=below, inside=inside)
                if inside > _FEW and r["lo"] < r["hi"]:
                    further.append(r)
        wide = further
        if wide:
            cuts = df.agg(*[
                F.percentile_approx(
                    F.when(within(r), F.col(r["column"])),
                    [
                        max((r["low"] - r["below"]) / r["inside"] - 2 / _ERROR, 0.0),
                        min((r["high"] - r["below"] + 1) / r["inside"] + 2 / _ERROR, 1.0),
                    ],
                    _ERROR,
                )
                for r in wide
            ]).first()
            tried = [r | {"lo": cut[0], "hi": cut[1]} for r, cut in zip(wide, cuts, strict=True)]

    known = [(i, r) for i, r in enumerate(ranges) if r["inside"]]
    if not known:
        return {c: [None] * len(probs) for c in columns}, first
    held = F.array(*[
        F.when(within(r), F.struct(F.lit(i).alias("range"), F.lit(r["below"]).cast("long").alias("below"), F.col(r["column"]).alias("value")))
        for i, r in known
    ])
    values = df.select(F.inline(F.array_compact(held))).groupBy("range", "below", "value").agg(F.count("*").alias("rows"))
    order = Window.partitionBy("range").orderBy("value")
    placed = values.withColumn("end", F.col("below") + F.sum("rows").over(order)).withColumn("begin", F.col("end") - F.col("rows"))
    ranks = F.create_map(*[x for i, r in known for x in (F.lit(i), F.array(F.lit(r["low"]).cast("long"), F.lit(r["high"]).cast("long")))])
    hit = F.exists(ranks[F.col("range")], lambda k: (F.col("begin") <= k) & (k < F.col("end")))
    rows = placed.where(hit).select("range", "value", "begin", "end").collect()  # two a range at most
    out: dict[str, list[float | None]] = {c: [] for c in columns}
    for i, r in enumerate(ranges):
        found = {}
        for row in rows:
            if row["range"] == i:
                found |= {k: row["value"] for k in (r["low"], r["high"]) if row["begin"] <= k < row["end"]}
        if not found:
            out[r["column"]].append(None)
            continue
        low, high = found[r["low"]], found[r["high"]]
        out[r["column"]].append(low + (high - low) * (r["place"] - r["low"]))
    return out, first
