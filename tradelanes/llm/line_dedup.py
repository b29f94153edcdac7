"""Lines that many documents share: counted by hash, dropped everywhere but in one document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tradelanes.llm.common import whole_text
from tradelanes.session import materialise

#: A key is looked at from this many code points on, and dropped when so many documents hold it.
LEAST_CHARS = 20
LEAST_DOCUMENTS = 3

_BLANKS = "\x20\x09\x0a\x0b\x0c\x0d"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def line_key(line: Column) -> Column:
    """The line without white space at its ends, A-Z made small; lines of ASCII alone go the faster way."""
    bare = F.btrim(line, F.lit(_BLANKS))
    return F.when(F.octet_length(bare) == F.char_length(bare), F.lower(bare)).otherwise(F.translate(bare, _UPPER, _LOWER))


def _digest(text: Column) -> Column:
    """The first 16 bytes of the text's SHA-256."""
    return F.unhex(F.substring(F.sha2(text.cast("binary"), 256), 1, 32))


def _lines(docs: DataFrame, least_chars: int) -> DataFrame:
    """Each distinct long key of each row, and the places of its lines in the row."""
    lines = docs.select("_id", "_text_hash", F.posexplode(F.split("_text", "\n")).alias("_pos", "_line")).select(
        "_id", "_text_hash", "_pos", line_key(F.col("_line")).alias("_key")
    )
    return lines.where(F.char_length("_key") >= least_chars).select("_id", "_text_hash", "_pos", _digest(F.col("_key")).alias("_hash"))


def shared_keys(lines: DataFrame, least_documents: int) -> DataFrame:
    """Hashes of keys that enough documents hold, with the largest identifier among these.

    A document counts once for a key however often it holds it. Both sums are
    partial before they are shuffled, so a key that every document holds
    reaches its task as one row from each task before.
    """
    once = lines.select("_hash", "_id").distinct()
    return (
        once.groupBy("_hash")
        .agg(F.count(F.lit(1)).alias("_documents"), F.max("_id").alias("_keeper"))
        .where(F.col("_documents") >= least_documents)
        .drop("_documents")
    )


def drop_shared_lines(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    least_chars: int = LEAST_CHARS,
    least_documents: int = LEAST_DOCUMENTS,
) -> DataFrame:
    """Every row's text without the lines that enough documents share: ``doc_id``, ``n_lines``, ``n_dropped``, ``kept_text``.

    Texts are split at line feeds. A line's key is the line without white
    space at its ends, A-Z made small; keys of at least ``least_chars`` code
    points found in at least ``least_documents`` documents lose all their
    lines, except those of the document with the largest identifier. What is
    left is joined by line feeds in its old order.

    The shared keys are written as a table, so that their size is known when
    the lines look them up, and a key that very many lines have can be dealt
    over several tasks of that join.

    Keys are compared by 16 bytes of their SHA-256. Only hashes and places of
    lines are shuffled and counted; texts move once, to meet the places that
    they lose. A row is found again by its identifier and text.

    Defined cases: a missing or empty text is one empty line, which is shorter
    than any key that counts. A text that loses all its lines is empty. Rows
    with equal identifiers are one document: a key counts once for all of
    them, and if theirs is the largest identifier they all keep it. So are
    rows without identifier, whose identifier is smaller than all others. Rows
    that repeat identifier and text stay as often as they were. An empty table
    gives an empty result. Other columns, whatever their names, are neither
    read nor returned.
    """
    rows = docs.select(F.col(id_col).alias("_id"), whole_text(text_col).alias("_text")).withColumn(
        "_text_hash", _digest(F.col("_text"))
    )
    lines = _lines(rows, least_chars)
    lost = (
        lines.join(materialise(shared_keys(lines, least_documents)), "_hash")
        .where(~F.col("_id").eqNullSafe(F.col("_keeper")))
        .groupBy(F.col("_id").alias("_lost_id"), F.col("_text_hash").alias("_lost_hash"))
        .agg(F.collect_set("_pos").alias("_lost"))
    )
    found = rows.join(lost, (rows["_text_hash"] == lost["_lost_hash"]) & rows["_id"].eqNullSafe(lost["_lost_id"]), "left")
    split = found.select(
        F.col("_id").alias("doc_id"), F.split("_text", "\n").alias("_all"), F.coalesce("_lost", F.array().cast("array<int>")).alias("_lost")
    )
    places = F.array_except(F.sequence(F.lit(0), F.size("_all") - 1), F.col("_lost"))
    return split.select(
        "doc_id",
        F.size("_all").cast("long").alias("n_lines"),
        F.size("_lost").cast("long").alias("n_dropped"),
        F.array_join(F.transform(places, lambda i: F.get(F.col("_all"), i)), "\n").alias("kept_text"),
    )
