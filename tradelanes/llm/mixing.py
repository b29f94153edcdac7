"""A mix of sources by weight: a low-discrepancy order of slots, filled with blocks of equal length."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from tradelanes.llm.common import SPACE, whole_text
from tradelanes.session import materialise

#: Points of the sequence are fractions of 2 to this power.
_BITS = 48
_CELL_BITS = 12
_CHUNK_BITS = 16
#: A source may give each of its words so many times.
REPEATS = 3


def _size() -> Column:
    """Words of the text: of its parts between runs of white space, those that aren't empty."""
    text = F.trim(F.regexp_replace(whole_text(), SPACE, " "))
    return F.when(F.length(text) == 0, 0).otherwise(F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit(""))) + 1).cast("long")


def sized(docs: DataFrame) -> DataFrame:
    """Rows of equal identifier, source and size, with their number."""
    return (
        docs.select("doc_id", "source", _size().alias("size"))
        .withColumn("_shuffle", F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")))
        .groupBy("source", "_shuffle", "doc_id", "size")
        .agg(F.count(F.lit(1)).alias("_rows"))
    )


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (5, 2, 1)) -> DataFrame:
    """Size and target of every source.

    Sources in code point order, the missing one last, take the weights in
    turn. The targets share the total size by weight, none above ``REPEATS``
    times its source's size; what a full source leaves is shared by weight
    among the others. Sorted by the level at which each source is full, the
    full ones come first, so the final level is that of the first source
    which isn't full once all before it are.
    """
    listed = F.array(*[F.lit(w).cast("long") for w in weights])
    by_name = Window.orderBy(F.asc_nulls_last("source"))
    totals = sizes.groupBy("source").agg(F.sum(F.col("size") * F.col("_rows")).alias("source_size"))
    numbered = totals.withColumn(
        "weight", F.element_at(listed, (F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1).cast("int"))
    )
    full_at = F.col("source_size") * REPEATS / F.col("weight")
    order = Window.orderBy("_full_at", F.asc_nulls_last("source"))
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    level = (F.col("_total") - F.col("_full_before")) / (F.col("_weights") - F.col("_weight_before"))
    shares = (
        numbered.withColumn("_full_at", full_at)
        .withColumn("_total", F.sum("source_size").over(everything))
        .withColumn("_weights", F.sum("weight").over(everything))
        .withColumn("_full_before", F.coalesce(F.sum(F.col("source_size") * REPEATS).over(before), F.lit(0)))
        .withColumn("_weight_before", F.coalesce(F.sum("weight").over(before), F.lit(0)))
        .withColumn("_place", F.row_number().over(order))
        .withColumn("_open", F.when(level <= F.col("_full_at"), F.struct("_place", level.alias("level"))))
        .withColumn("_final", F.min("_open").over(everything)["level"])
    )
    return shares.select(
        "source",
        "source_size",
        F.least((F.col("source_size") * REPEATS).cast("double"), F.col("_final") * F.col("weight")).alias("target"),
    ).withColumn("goal", F.floor(F.col("target") + 0.5).cast("long"))


def _point(i: Column) -> Column:
    """The van der Corput point of ``i``: its binary digits mirrored, as a whole number below 2**48."""
    return F.conv(F.reverse(F.lpad(F.bin(i), _BITS, "0")), 2, 10).cast("long")


def slot_schedule(targets: DataFrame, block: int) -> DataFrame:
    """``position``, ``source`` and ``slot`` (0, 1, ... within the source) of every block of the mix.

    Point after point of the sequence falls into one source's part of the
    cumulative goals; its rank among the source's points is the slot. As
    points spread evenly, every stretch of the schedule is close to the
    targets. Points beyond a source's last block are passed over; blocks that
    the sequence doesn't reach close the schedule.
    """
    slots = targets.where("goal > 0").withColumn("slots", F.ceil(F.col("goal") / block).cast("long"))
    order = Window.orderBy(F.asc_nulls_last("source")).rowsBetween(Window.unboundedPreceding, 0)
    whole = F.lit(float(1 << _BITS))
    bounds = (
        slots.withColumn("_to", F.sum("slots").over(order))
        .withColumn("_all", F.sum("slots").over(Window.partitionBy()))
        .withColumn("_hi", F.floor(F.col("_to") / F.col("_all") * whole).cast("long"))
        .withColumn("_lo", F.floor((F.col("_to") - F.col("slots")) / F.col("_all") * whole).cast("long"))
        .where("_hi > _lo")
    )
    bounds = materialise(bounds.select("source", "slots", "_all", "_lo", "_hi"))
    count = bounds.agg(F.max("_all")).first()[0] or 0
    shift = _BITS - _CELL_BITS
    cells = bounds.withColumn(
        "_cell", F.explode(F.sequence(F.shiftright("_lo", shift), F.shiftright(F.col("_hi") - 1, shift)))
    )
    points = targets.sparkSession.range(count).select(F.col("id").alias("_i"), _point(F.col("id")).alias("_u"))
    hits = (
        points.withColumn("_cell", F.shiftright("_u", shift))
        .join(cells, "_cell")
        .where("_u >= _lo AND _u < _hi")
        .select("_i", F.shiftright("_i", _CHUNK_BITS).alias("_chunk"), "source", "slots")
    )
    counts = hits.groupBy("source", "_chunk").agg(F.count(F.lit(1)).alias("_hits"))
    earlier = Window.partitionBy("source").orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(
        F.col("source").alias("_source"), F.col("_chunk").alias("_part"), F.coalesce(F.sum("_hits").over(earlier), F.lit(0)).alias("_start")
    )
    in_chunk = Window.partitionBy("source", "_chunk").orderBy("_i")
    ranked = (
        hits.withColumn("_rank", F.row_number().over(in_chunk) - 1)
        .join(starts, F.col("source").eqNullSafe(F.col("_source")) & (F.col("_chunk") == F.col("_part")))
        .select(F.col("_i").alias("position"), "source", (F.col("_start") + F.col("_rank")).alias("slot"), "slots")
        .where("slot < slots")
        .drop("slots")
    )
    reached = counts.groupBy("source").agg(F.sum("_hits").alias("_hits")).select(F.col("source").alias("_source"), "_hits")
    rest = (
        bounds.select("source", "slots", "_all")
        .unionByName(  # a source too small for any point
            slots.select("source", "slots", F.lit(count).cast("long").alias("_all"))
        )
        .groupBy("source")
        .agg(F.max("slots").alias("slots"), F.max("_all").alias("_all"))
        .join(reached, F.col("source").eqNullSafe(F.col("_source")), "left")
        .withColumn("_hits", F.coalesce("_hits", F.lit(0)))
        .where("_hits < slots")
        .withColumn("slot", F.explode(F.sequence(F.col("_hits"), F.col("slots") - 1)))
        .select((F.col("_all") + F.col("slot")).alias("position"), "source", "slot")
    )
    return ranked.unionByName(rest)


def mix_pieces(docs: DataFrame, block: int = 512, weights: tuple[int, ...] = (5, 2, 1)) -> DataFrame:
    """The mix, piece by piece: which words of which document every slot takes.

    The documents of a source, shuffled by the digest of their identifiers,
    form one line of words, repeated ``REPEATS`` times. The line is cut into
    blocks of ``block`` words; slot ``k`` of the source takes block ``k`` and
    the last slot stops at the goal. A row per document and block it lies in;
    one row without position where the mix takes nothing of a document.
    """
    sizes = materialise(sized(docs))
    targets = materialise(source_targets(sizes, weights))
    bucketed = sizes.withColumn("_bucket", F.substring("_shuffle", 1, 4))
    length = F.col("size") * F.col("_rows")
    by_bucket = bucketed.groupBy("source", "_bucket").agg(F.sum(length).alias("_words"))
    earlier = Window.partitionBy("source").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = by_bucket.select(
        F.col("source").alias("_s"), F.col("_bucket").alias("_b"), F.coalesce(F.sum("_words").over(earlier), F.lit(0)).alias("_base")
    )
    before = (
        Window.partitionBy("source", "_bucket")
        .orderBy("_shuffle", "doc_id", "size")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    placed = (
        bucketed.withColumn("_inner", F.coalesce(F.sum(length).over(before), F.lit(0)))
        .join(offsets, F.col("source").eqNullSafe(F.col("_s")) & (F.col("_bucket") == F.col("_b")))
        .withColumn("_first", F.col("_base") + F.col("_inner"))
    )
    goals = targets.withColumnRenamed("source", "_g")
    lines = placed.join(goals, F.col("source").eqNullSafe(F.col("_g"))).select(
        "doc_id", "source", "size", "source_size", "target", "goal", "_rows", "_first"
    )
    copies = (
        lines.withColumn("_many", F.when(F.col("size") > 0, F.lit(1)).otherwise(F.col("_rows")).cast("long"))
        .withColumn("_copy", F.explode(F.sequence(F.lit(0).cast("long"), F.when(F.col("size") > 0, F.col("_rows") - 1).otherwise(0).cast("long"))))
        .withColumn("_first", F.col("_first") + F.col("_copy") * F.col("size"))
        .drop("_copy", "_rows")
    )
    passes = F.filter(
        F.transform(
            F.sequence(F.lit(0), F.lit(REPEATS - 1)),
            lambda e: F.struct(
                (F.col("_first") + e * F.col("source_size")).alias("a"),
                F.least(F.col("_first") + e * F.col("source_size") + F.col("size"), F.col("goal")).alias("b"),
            ),
        ),
        lambda p: p["a"] < p["b"],
    )
    pieces = (
        copies.withColumn("_pass", F.explode_outer(passes))
        .withColumn("slot", F.explode_outer(F.when(F.col("_pass").isNotNull(), F.sequence(F.floor(F.col("_pass.a") / block), F.floor((F.col("_pass.b") - 1) / block)))))
        .withColumn("_words", F.least(F.col("_pass.b"), (F.col("slot") + 1) * block) - F.greatest(F.col("_pass.a"), F.col("slot") * block))
    )
    schedule = slot_schedule(targets, block).select(
        F.col("source").alias("_s"), F.col("slot").alias("_k"), "position"
    )
    return pieces.join(schedule, F.col("source").eqNullSafe(F.col("_s")) & (F.col("slot") == F.col("_k")), "left").select(
        "position", "source", "slot", "doc_id", "size", "source_size", "target", F.col("_first").alias("first_word"),
        F.when(F.col("position").isNotNull(), F.col("_words")).otherwise(0).alias("words"), "_many",
    )


def mix(docs: DataFrame, block: int = 512, weights: tuple[int, ...] = (5, 2, 1)) -> DataFrame:
    """One row per row of ``docs``: the words the mix takes of it, repeats counted.

    Defined cases: a missing text has size 0 and nothing is taken of it; a
    missing source is a source of its own, the last; a missing identifier
    shuffles as an empty one; an empty table gives no rows. Repeated rows are
    neighbours in the line of their source. Other columns aren't read.
    """
    taken = mix_pieces(docs, block, weights).groupBy(
        "doc_id", "source", "size", "source_size", "target", "first_word", "_many"
    ).agg(F.sum("words").alias("taken"))
    return taken.withColumn("_row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_many")))).select(
        "doc_id", "size", "source_size", "target", "taken", "source"
    )


def mixed_documents(docs: DataFrame, block: int = 512, weights: tuple[int, ...] = (5, 2, 1)) -> DataFrame:
    """``docs`` as the mix has them: each row as often as the mix takes its words, rounded; all columns stay.

    A row of which less than half is taken goes. Texts without words cost the
    mix nothing and stay once.
    """
    names = docs.columns
    taken = (
        mix(docs, block, weights)
        .groupBy("doc_id", "source", "size")
        .agg((F.sum("taken") / F.count(F.lit(1))).alias("_taken"))
        .select(
            F.col("doc_id").alias("_id"),
            F.col("source").alias("_from"),
            F.col("size").alias("_of"),
            F.when(F.col("size") > 0, F.floor(F.col("_taken") / F.col("size") + 0.5)).otherwise(1).cast("int").alias("_times"),
        )
        .where("_times > 0")
    )
    rows = docs.select(F.struct(*[F.col(f"`{name}`") for name in names]).alias("_row"), _size().alias("_size"))
    return (
        rows.join(
            taken,
            F.col("_row.doc_id").eqNullSafe(F.col("_id"))
            & F.col("_row.source").eqNullSafe(F.col("_from"))
            & (F.col("_size") == F.col("_of")),
        )
        .withColumn("_time", F.explode(F.sequence(F.lit(1), F.col("_times"))))
        .select("_row.*")
    )
