"""Exact duplicates by a tree of merged digest runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tradelanes.llm.common import SPACE, whole_text
from tradelanes.session import materialise

_KEYS = ("text_sha256", "_size", "_check")
#: Rows a run has on average, the runs that one merge takes, as bits, and the copies of a row made in one go.
RUN_ROWS = 1_000_000
FAN_IN_BITS = 4
_COPIES = 1000


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id`` and what texts are compared by: digest, length and a second hash of the normalised text."""
    text = F.regexp_replace(whole_text(text_col), SPACE, " ")
    return docs.select(F.col(id_col).alias("doc_id"), text.alias("_text")).select(
        "doc_id",
        F.sha2(F.col("_text").cast("binary"), 256).alias("text_sha256"),
        F.octet_length("_text").alias("_size"),
        F.xxhash64("_text").alias("_check"),
    )


def merged_runs(members: DataFrame, run_rows: int = RUN_ROWS, fan_in_bits: int = FAN_IN_BITS) -> DataFrame:
    """One row per distinct text: the smallest identifier and the number of rows.

    There are ``2 ** (rounds * fan_in_bits)`` partitions, as many as the rows
    need, and each holds one run: its rows sorted by digest, each digest once.
    Rows are dealt to them by identifier and text, so copies of one text start
    out everywhere. In each round, the partitions whose numbers differ in
    ``fan_in_bits`` bits only exchange runs: a digest goes to the one that has
    the digest's own bits there. Each merges what it gets into one sorted run,
    keeping the smallest identifier and adding up the counts. After the last
    round a digest is in one partition only. It receives, however often a text
    occurs, a row of it from each partner. A digest counts as the same only
    together with the text's length and a second, unrelated hash, which are
    compared in every merge.

    Identifiers that are missing come after all others.
    """
    rounds = 1
    count = members.count()
    while run_rows << (rounds * fan_in_bits) < count:
        rounds += 1
    runs = 1 << (rounds * fan_in_bits)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id"))
    own = F.pmod(F.xxhash64("doc_id", *_KEYS), F.lit(runs)).cast("int")
    level = _merged(members.withColumn("_run", own), runs, first, F.sum("_rows"))
    home = F.pmod(F.col("_check"), F.lit(runs)).cast("int")
    for step in range(rounds):
        bits = ((1 << fan_in_bits) - 1) << (step * fan_in_bits)
        partner = F.col("_run").bitwiseAND(runs - 1 - bits).bitwiseOR(home.bitwiseAND(bits))
        level = _merged(level.withColumn("_run", partner), runs, F.min("_first"), F.sum("group_size"))
    return level.select(*_KEYS, F.col("_first.doc_id").alias("keep_id"), "group_size")


def _merged(rows: DataFrame, runs: int, first: Column, count: Column) -> DataFrame:
    """Rows sent to the partition that ``_run`` names, sorted there and merged in that order."""
    return (
        rows.repartitionById(runs, "_run")
        .sortWithinPartitions("_run", *_KEYS)
        .groupBy("_run", *_KEYS)
        .agg(first.alias("_first"), count.alias("group_size"))
    )


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: which document of its group of equal texts stays.

    Texts are equal when they are identical after every run of white space is
    one blank. Defined cases: a missing text is empty; all empty texts are one
    group. Identifiers that are missing come last, so such a row stays only in
    a group without any identifier. Of rows repeating both text and identifier
    exactly one stays. An empty table gives an empty result. Other columns,
    whatever their names, are neither read nor returned.
    """
    members = materialise(
        digests(docs, id_col, text_col).groupBy("doc_id", *_KEYS).agg(F.count(F.lit(1)).alias("_rows"))
    )
    groups = materialise(merged_runs(members))
    stays = F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("_copy") == 1)
    result = ("doc_id", "keep_id", "group_size", stays.alias("kept"), "text_sha256")
    placed = members.join(groups, list(_KEYS))
    few = placed.withColumn("_copy", F.explode(_numbers(F.lit(1), F.least("_rows", F.lit(_COPIES)))))
    # further copies are dealt in blocks, so no task makes all of them
    many = (
        placed.where(F.col("_rows") > _COPIES)
        .withColumn("_from", F.explode(_numbers(F.lit(_COPIES + 1), F.col("_rows"), _COPIES)))
        .repartition("text_sha256", "doc_id", "_from")
        .withColumn("_copy", F.explode(_numbers(F.col("_from"), F.least(F.col("_from") + (_COPIES - 1), F.col("_rows")))))
    )
    return few.select(*result).unionByName(many.select(*result))


def _numbers(low: Column, high: Column, step: int = 1) -> Column:
    return F.sequence(low.cast("long"), high.cast("long"), F.lit(step).cast("long"))


def keep_first(docs: DataFrame) -> DataFrame:
    """``docs`` without the rows whose text an earlier row has; all columns and their order stay.

    Rows are matched by digest and identifier. Where rows repeat both, the one
    that is smallest by all its columns stays; those that have no order, as
    maps, are compared by their JSON.
    """
    names = docs.columns
    digest = F.struct(
        F.sha2(F.regexp_replace(whole_text(), SPACE, " ").cast("binary"), 256).alias("text_sha256"),
        F.octet_length(F.regexp_replace(whole_text(), SPACE, " ")).alias("_size"),
    )
    marked = docs.select(F.struct(*[F.col(f"`{name}`") for name in names]).alias("_row"), digest.alias("_digest"))
    winners = (
        exact_members(docs)
        .select(
            F.struct("text_sha256", "_size").alias("_digest"),
            F.col("keep_id").alias("_keep"),
            F.col("_rows").alias("_same"),
        )
    )
    stay = marked.join(
        winners, (marked["_digest"] == winners["_digest"]) & marked["_row.doc_id"].eqNullSafe(winners["_keep"])
    ).select("_row", marked["_digest"], "_same")
    once = stay.where("_same = 1").select("_row")
    order = F.struct(
        *[
            (F.to_json(F.struct(value)) if "map<" in f.dataType.simpleString() else value).alias(f"c{i}")
            for i, f in enumerate(docs.schema.fields)
            for value in [F.col("_row").getField(f.name)]
        ]
    )
    again = stay.where("_same > 1").groupBy("_digest").agg(F.min_by("_row", order).alias("_row")).select("_row")
    return once.unionByName(again).select("_row.*")


def exact_members(docs: DataFrame) -> DataFrame:
    """The members that stay: keys, identifier, and how many rows repeat both."""
    members = materialise(digests(docs).groupBy("doc_id", *_KEYS).agg(F.count(F.lit(1)).alias("_rows")))
    groups = merged_runs(members)
    return members.join(groups, list(_KEYS)).where(F.col("doc_id").eqNullSafe(F.col("keep_id")))
