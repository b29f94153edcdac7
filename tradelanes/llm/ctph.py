"""Context-triggered piecewise hashes: signatures of chunks whose borders the text itself sets."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tradelanes.llm.common import arrow, hashes_between, running_hash, whole_text
from tradelanes.session import materialise

#: Bytes the rolling hash sees, the smallest block, the chunks a signature aims at and those it has at most.
WINDOW = 7
LEAST_BLOCK = 3
CHUNKS = 64
MOST_CHUNKS = 256
_LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"


def rolling(data: np.ndarray) -> np.ndarray:
    """A hash of the last ``WINDOW`` bytes at every byte."""
    out = np.zeros(len(data), dtype=np.uint32)
    wide = data.astype(np.uint32)
    with np.errstate(over="ignore"):
        for back in range(min(WINDOW, len(data))):
            part = wide[: len(wide) - back] + np.uint32(1)
            out[back:] += part * np.uint32(pow(0x01000193, back + 1, 1 << 32))
        out ^= out >> np.uint32(15)
        out *= np.uint32(0x2C1B3C6D)
        out ^= out >> np.uint32(12)
    return out


def _ends(roll: np.ndarray, block: int) -> np.ndarray:
    """Where chunks end: after bytes whose rolling hash is full modulo the block size. Twice the size keeps a part of them."""
    if block >= 1 << 32:
        return np.zeros(0, np.int64)
    return np.flatnonzero(roll % np.uint32(block) == block - 1) + 1


def _chunks(ends: np.ndarray, size: int) -> int:
    """The chunks that these ends cut, what follows the last end included."""
    return len(ends) + (not len(ends) or ends[-1] != size)


def _signature(ends: np.ndarray, running: np.ndarray) -> tuple[int, ...]:
    """One symbol of 12 bits for each chunk; the last of ``MOST_CHUNKS`` takes all that is left."""
    ends = np.append(ends[: MOST_CHUNKS - 1], len(running) - 1)
    ends = ends[: len(ends) - (len(ends) > 1 and ends[-1] == ends[-2])]
    starts = np.concatenate([[0], ends[:-1]])
    return tuple((hashes_between(running, starts, ends) >> np.uint64(52)).tolist())


def signatures(text: bytes) -> tuple[int, tuple[int, ...], tuple[int, ...]]:
    """Block size and the signatures at it and at twice its size.

    The block size is the smallest ``LEAST_BLOCK * 2**k`` that would give
    ``CHUNKS`` chunks or fewer on average, halved while the text turns out to
    have fewer than half of them, doubled while it has more than
    ``MOST_CHUNKS`` and at least ``CHUNKS / 2`` stay. A text that repeats
    itself may have very many chunks at one size and hardly any at the next;
    there the last chunk of a signature takes the rest of the text. So a
    signature has ``MOST_CHUNKS`` symbols at most and sees every byte.
    """
    data = np.frombuffer(text, dtype=np.uint8)
    size = len(data)
    if not size:
        return LEAST_BLOCK, (), ()
    block = LEAST_BLOCK
    while block * CHUNKS < size:
        block *= 2
    roll, running = rolling(data), running_hash(data)
    first, second = _ends(roll, block), _ends(roll, block * 2)
    while block > LEAST_BLOCK and _chunks(first, size) < CHUNKS // 2:
        block, second = block // 2, first
        first = _ends(roll, block)
    while _chunks(first, size) > MOST_CHUNKS and _chunks(second, size) >= CHUNKS // 2:
        block, first = block * 2, second
        second = _ends(roll, block * 2)
    return block, _signature(first, running), _signature(second, running)


def written(parts: tuple[int, tuple[int, ...], tuple[int, ...]]) -> str:
    """A fingerprint as text: ``block:signature:signature``, two letters for a chunk."""
    block, *both = parts
    return ":".join([str(block), *("".join(_LETTERS[x >> 6] + _LETTERS[x & 63] for x in s) for s in both)])


def common_length(a: tuple[int, ...], b: tuple[int, ...]) -> int:
    """Length of the longest common subsequence, a row of it as the bits of one number."""
    if not a or not b:
        return 0
    where: dict[int, int] = {}
    for i, x in enumerate(a):
        where[x] = where.get(x, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for x in b:
        hit = row & where.get(x, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


def likeness(a: tuple, b: tuple) -> float:
    """1 less the edit distance (insertions and deletions) over the lengths, at the best block size both have; else 0."""
    if a == b:
        return 1.0
    one = {a[0]: a[1], 2 * a[0]: a[2]}
    two = {b[0]: b[1], 2 * b[0]: b[2]}
    best = 0.0
    for block in one.keys() & two.keys():
        x, y = one[block], two[block]
        if x and y:
            best = max(best, 2 * common_length(x, y) / (len(x) + len(y)))
    return best


def edited(text: str, following: str) -> str:
    """``text`` with its last third replaced by as much of the beginning of ``following``, or all of it."""
    third = len(text) // 3
    return text[: len(text) - third] + following[:third]


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in the order of a bucket, each followed by its next; the last of a bucket is a copy of the next bucket's first."""
    names = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    held = None
    for batch in batches:
        out = {part.split()[0]: [] for part in names.split(",")}
        for bucket, doc_id, text, copy in zip(*(batch.column(c).to_pylist() for c in ("_bucket", "doc_id", "_text", "_copy")), strict=True):
            parts = signatures(text.encode())
            if held is not None and held[0] == bucket:
                _, own_id, own_text, own, own_copy = held
                if not own_copy:
                    changed = edited(own_text, text)
                    raw = changed.encode()
                    changed_parts = signatures(raw)
                    row = (own_id, len(own_text), hashlib.sha256(raw).hexdigest(), written(own), written(changed_parts), likeness(own, changed_parts), likeness(own, parts))
                    for column, value in zip(out.values(), row, strict=True):
                        column.append(value)
            held = (bucket, doc_id, text, parts, copy)
        yield arrow(names, out)


def piecewise_fingerprints(docs: DataFrame) -> DataFrame:
    """``fingerprint`` of every row's text, as an appended column."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = [written(signatures((t or "").encode())) for t in batch.column("text").to_pylist()]
            yield batch.append_column("fingerprint", pa.array(prints, type=pa.string()))

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return docs.mapInArrow(add, f"{fields}, fingerprint string")


def compare_with_edits(docs: DataFrame, rows_per_bucket: int = 4000, most_buckets: int = 4096) -> DataFrame:
    """Fingerprints of every text and of its edited form, which ends like the next document begins.

    The next document is the one with the next smaller identifier, after the
    last the first. Buckets are ranges of identifiers. Each also gets a copy
    of the following bucket's first row, so every pair of neighbours meets in
    one task and each text moves once. Texts stream through in order; a task
    holds two of them.

    Defined cases: a missing text is empty; an empty text has fingerprint
    ``3::`` and equals only other empty ones; a single document is its own
    next. Missing identifiers come last; rows that repeat an identifier follow
    each other in the order of their texts. An empty table gives no rows.
    Other columns aren't read.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("_text"))
    ids = materialise(docs.select(F.col("doc_id").cast("long").alias("doc_id")))
    count = ids.count()
    buckets = min(max(1, count // rows_per_bucket), most_buckets)  # rows stream, so a bucket may be of any size
    share = [k / buckets for k in range(1, buckets)]
    cuts = sorted(set(ids.agg(F.percentile_approx("doc_id", share, 100_000)).first()[0] or [])) if share else []
    # a bucket holds the identifiers below one cut and from the next on, the largest in bucket 0
    bounds = F.array(*[F.lit(c) for c in cuts]) if cuts else F.array().cast("array<bigint>")
    bucket = F.size(F.filter(bounds, lambda c: c > F.coalesce("doc_id", F.lit(-(1 << 63)))))
    heads = {
        r["_bucket"]: r["_head"]
        for r in ids.select("doc_id", bucket.alias("_bucket")).groupBy("_bucket").agg(F.max("doc_id").alias("_head")).collect()
    }
    order = sorted(heads)
    # the first row of each bucket, found by its identifier, also goes to the end of the bucket before
    placed = rows.withColumn("_bucket", bucket)
    known = [heads[b] for b in order if heads[b] is not None]
    first = F.col("doc_id").isin(known) if known else F.lit(False)
    if None in heads.values():  # a bucket of rows without identifier
        first = first | (F.col("doc_id").isNull() & (F.col("_bucket") == max(order)))
    before = F.create_map(*[F.lit(x) for i, b in enumerate(order) for x in (b, order[i - 1])]) if order else F.lit(None)
    firsts = (
        placed.where(F.coalesce(first, F.lit(False)))
        .select((before[F.col("_bucket")] if order else F.lit(0)).cast("int").alias("_to"), "doc_id", "_text")
        .groupBy("_to", "doc_id")
        .agg(F.min("_text").alias("_text"))
    )
    both = placed.select("_bucket", "doc_id", "_text", F.lit(False).alias("_copy")).unionByName(
        firsts.select(F.col("_to").alias("_bucket"), "doc_id", "_text", F.lit(True).alias("_copy"))
    )
    return (
        both.repartition(max(1, len(order)), "_bucket")
        .sortWithinPartitions("_bucket", "_copy", F.desc_nulls_last("doc_id"), "_text")
        .mapInArrow(
            _compare,
            "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string,"
            " near_edited double, near_next double",
        )
    )
