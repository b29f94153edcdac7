"""SimHash near-duplicates: fingerprints joined with themselves along a binary trie."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tradelanes.llm.common import arrow, portions, utf8, whole_text
from tradelanes.llm.components import components
from tradelanes.session import materialise

#: Fingerprints link at so many differing bits; one of ``BUDGET + 1`` blocks is then equal.
BUDGET = 3
_BLOCK_BITS = 64 // (BUDGET + 1)
#: Groups of equal blocks beyond this size are split along the next bits of the trie.
GROUP_ROWS = 20_000
_MOST_SPLIT_BITS = 16
#: Node pairs that one step of the traversal holds.
_FRONTIER = 1 << 19
_SEED = 42


def shingle_hashes(text: bytes, size: int = 3) -> list[int]:
    """XXH64 of every run of ``size`` words, repeats included; fewer words form one run, none gives nothing."""
    words = text.lower().split()
    if not words:
        return []
    joined = b" ".join(words)
    if len(words) <= size:
        return [xxhash.xxh64_intdigest(joined, _SEED)]
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = [0, *ends[: len(words) - size].tolist()]
    digest = xxhash.xxh64_intdigest
    return [digest(joined[s : e - 1], _SEED) for s, e in zip(starts, ends[size - 1 :].tolist(), strict=True)]


def fingerprint(hashes: np.ndarray) -> int:
    """The bits that more than half of the hashes have."""
    out, step = np.zeros(64, dtype=np.int64), 1 << 16
    for start in range(0, len(hashes), step):
        part = hashes[start : start + step]
        bits = np.unpackbits(part.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        out += bits.sum(axis=0, dtype=np.int64)
    return int(sum(1 << i for i in np.flatnonzero(2 * out > len(hashes)).tolist()))


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprint_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Appends ``_fp`` to batches that have the text in ``_text``; the text itself goes."""
    for batch in portions(batches, "_text"):
        data, offsets = utf8(batch.column("_text"))
        raw = data.tobytes()
        prints = [
            _signed(fingerprint(np.array(shingle_hashes(raw[s:e]), dtype=np.uint64)))
            for s, e in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)
        ]
        kept = [name for name in batch.schema.names if name != "_text"]
        yield pa.RecordBatch.from_arrays(
            [*(batch.column(name) for name in kept), pa.array(prints, type=pa.int64())], names=[*kept, "_fp"]
        )


def with_fingerprints(docs: DataFrame) -> DataFrame:
    """``doc_id`` and ``_fp`` of every row."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", whole_text().alias("_text")).mapInArrow(
        fingerprint_batches, f"doc_id {kind}, _fp bigint"
    )


def _popcount(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x)


def trie_pairs(v: np.ndarray, depth: np.ndarray, a_lo, a_hi, b_lo, b_hi, budget: int = BUDGET):
    """Pairs of positions in ``v`` whose values differ in ``budget`` bits or fewer.

    ``v`` is sorted, so a trie node is a range of it. The traversal holds
    pairs of nodes of equal depth; a step goes one bit down on both sides,
    counts the branches that differ, and drops pairs over the budget. A pair
    of single values is settled at once. ``depth`` and the ranges say where it
    begins; a pair of a node with itself yields each pair of values once.
    """
    found = []
    zero = np.zeros(len(a_lo), dtype=np.int64)
    stack = [(a_lo, a_hi, b_lo, b_hi, depth.astype(np.int64), zero)]
    while stack:
        al, ah, bl, bh, d, diff = stack.pop()
        if len(al) > _FRONTIER:
            half = len(al) // 2
            stack.append(tuple(x[:half] for x in (al, ah, bl, bh, d, diff)))
            stack.append(tuple(x[half:] for x in (al, ah, bl, bh, d, diff)))
            continue
        same = (al == bl) & (ah == bh)
        single = (ah - al == 1) & (bh - bl == 1)
        done = single & ~same
        if done.any():
            x, y = al[done], bl[done]
            ok = _popcount(v[x] ^ v[y]) <= budget
            found.append(np.stack([x[ok], y[ok]]))
        go = ~single
        if not go.any():
            continue
        al, ah, bl, bh, d, diff, same = (x[go] for x in (al, ah, bl, bh, d, diff, same))
        shift = (63 - d).astype(np.uint64)
        one = np.uint64(1)
        am = np.clip(np.searchsorted(v, ((v[al] >> shift) | one) << shift), al, ah)
        bm = np.clip(np.searchsorted(v, ((v[bl] >> shift) | one) << shift), bl, bh)
        d = d + 1
        steps = [(al, am, bl, bm, 0, None), (am, ah, bm, bh, 0, None), (al, am, bm, bh, 1, None), (am, ah, bl, bm, 1, ~same)]
        parts = []
        for p, q, r, s, add, only in steps:
            keep = (q > p) & (s > r) & (diff + add <= budget)
            if only is not None:
                keep &= only
            parts.append((p[keep], q[keep], r[keep], s[keep], d[keep], diff[keep] + add))
        merged = tuple(np.concatenate(x) for x in zip(*parts, strict=True))
        if len(merged[0]):
            stack.append(merged)
    return np.concatenate(found, axis=1) if found else np.zeros((2, 0), dtype=np.int64)


def spanning(n: int, pairs: np.ndarray) -> np.ndarray:
    """For the components of ``n`` positions: each position's smallest reachable one."""
    label = np.arange(n)
    a, b = pairs
    while len(a):
        low = np.minimum(label[a], label[b])
        np.minimum.at(label, label[a], low)
        np.minimum.at(label, label[b], low)
        while True:  # follow the labels to their ends
            up = label[label]
            if np.array_equal(up, label):
                break
            label = up
        open_ = label[a] != label[b]
        a, b = a[open_], b[open_]
    return label


def _rotate(v: np.ndarray, by: int) -> np.ndarray:
    if by == 0:
        return v
    return (v << np.uint64(by)) | (v >> np.uint64(64 - by))


def _group_edges(block: int, left: np.ndarray, right: np.ndarray | None) -> np.ndarray:
    """Edges of one group: within ``left``, or between the two sides. One edge per linked value but the first of each component."""
    turn = _BLOCK_BITS * block
    if right is None:
        v = np.unique(_rotate(left, turn))
        ranges = [np.array([x]) for x in (0, len(v), 0, len(v))]
        pairs = trie_pairs(v, np.array([_BLOCK_BITS]), *ranges)
    else:
        x, y = np.unique(_rotate(left, turn)), np.unique(_rotate(right, turn))
        v = np.unique(np.concatenate([x, y]))
        # both sides are whole subtrees below different nodes: the first bit in which they differ parts them
        cut = int(np.searchsorted(v, max(x[0], y[0])))
        ranges = [np.array([k]) for k in (0, cut, cut, len(v))]
        pairs = trie_pairs(v, np.array([_BLOCK_BITS]), *ranges)
    label = spanning(len(v), pairs)
    linked = np.flatnonzero(label != np.arange(len(v)))
    back = (64 - turn) % 64
    return np.stack([_rotate(v[linked], back), _rotate(v[label[linked]], back)])


def _many_groups(block: int, values: np.ndarray) -> np.ndarray:
    """Edges of all groups of one block at once: their nodes enter the traversal together."""
    turn = _BLOCK_BITS * block
    v = np.unique(_rotate(values, turn))
    heads = np.flatnonzero(np.diff(v >> np.uint64(64 - _BLOCK_BITS), prepend=np.uint64(1 << 63)))
    tails = np.append(heads[1:], len(v))
    many = tails - heads > 1
    heads, tails = heads[many], tails[many]
    pairs = trie_pairs(v, np.full(len(heads), _BLOCK_BITS), heads, tails, heads, tails)
    label = spanning(len(v), pairs)
    linked = np.flatnonzero(label != np.arange(len(v)))
    back = (64 - turn) % 64
    return np.stack([_rotate(v[linked], back), _rotate(v[label[linked]], back)])


def link_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges from rows sorted by (``block``, ``group``, ``p``, ``q``).

    Rows of whole groups go through the traversal together. A group that was
    split comes as node pairs (``p``, ``q``): the values of one node, or of
    both with ``side`` telling them apart.
    """
    held: list[pa.RecordBatch] = []
    rows = 0

    def cut(last: bool) -> Iterator[pa.RecordBatch]:
        nonlocal held, rows
        if not rows:
            return
        got = pa.Table.from_batches(held).combine_chunks()
        keys = [got.column(c).to_numpy() for c in ("block", "group", "p", "q")]
        change = np.flatnonzero(np.any([np.diff(k) != 0 for k in keys], axis=0)) + 1
        end = got.num_rows if last else (int(change[-1]) if len(change) else 0)
        if end == 0:
            return
        block, _, p, q = (k[:end] for k in keys)
        value = got.column("_fp").to_numpy()[:end].view(np.uint64)
        side = got.column("side").to_numpy()[:end]
        found = [_many_groups(int(k), value[(p < 0) & (block == k)]) for k in np.unique(block[p < 0])]
        starts = np.concatenate([[0], change[change < end]]).astype(np.int64)
        for s, e in zip(starts.tolist(), [*starts[1:].tolist(), end], strict=True):
            if p[s] < 0:
                continue
            part, of = value[s:e], side[s:e]
            if p[s] == q[s]:
                found.append(_group_edges(int(block[s]), part, None))
            elif (of == 0).any() and (of == 1).any():
                found.append(_group_edges(int(block[s]), part[of == 0], part[of == 1]))
        held = [got.slice(end).to_batches()[0]] if end < got.num_rows else []
        rows = got.num_rows - end
        if found:
            a, b = np.concatenate(found, axis=1)
            yield arrow("a long, b long", {"a": a.view(np.int64), "b": b.view(np.int64)})

    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            rows += batch.num_rows
            if rows >= 200_000:
                yield from cut(False)
    yield from cut(True)


def near_links(prints: DataFrame) -> DataFrame:
    """Edges that join all fingerprints (``_fp``, distinct) within ``BUDGET`` bits of each other.

    Of four blocks of bits two linked fingerprints share one at least. So each
    fingerprint goes to four groups, by block and its value; the traversal
    starts at the trie node that the group is, with that block's bits first.
    Groups over ``GROUP_ROWS`` are split along their next bits into nodes, and
    only pairs of nodes within the budget meet.
    """
    blocks = [
        F.struct(
            F.lit(k).alias("block"),
            F.shiftrightunsigned(F.shiftleft("_fp", _BLOCK_BITS * k), 64 - _BLOCK_BITS).cast("int").alias("group"),
            (F.shiftleft("_fp", _BLOCK_BITS * k).bitwiseOR(F.shiftrightunsigned("_fp", 64 - _BLOCK_BITS * k)) if k else F.col("_fp")).alias("_turned"),
        )
        for k in range(BUDGET + 1)
    ]
    cells = prints.select("_fp", F.inline(F.array(*blocks)))
    sizes = cells.groupBy("block", "group").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > GROUP_ROWS)
    cells = cells.join(sizes, ["block", "group"], "left")
    small = cells.where("_n IS NULL").select(
        "block", "group", F.lit(-1).alias("p"), F.lit(-1).alias("q"), F.lit(0).alias("side"), "_fp"
    )
    bits = F.least(F.ceil(F.log2(F.col("_n") / GROUP_ROWS)) + 2, F.lit(_MOST_SPLIT_BITS)).cast("int")
    node = F.expr(f"cast(shiftrightunsigned(shiftleft(_turned, {_BLOCK_BITS}), 64 - _bits) AS int)")
    masks = sorted(
        [0]
        + [1 << i for i in range(_MOST_SPLIT_BITS)]
        + [1 << i | 1 << j for i in range(_MOST_SPLIT_BITS) for j in range(i)]
        + [1 << i | 1 << j | 1 << k for i in range(_MOST_SPLIT_BITS) for j in range(i) for k in range(j)]
    )
    partner = F.filter(F.array(*[F.lit(m) for m in masks]), lambda m: m < F.expr("shiftleft(1, _bits)"))
    split = (
        cells.where("_n IS NOT NULL")
        .withColumn("_bits", bits)
        .withColumn("_node", node)
        .withColumn("_mask", F.explode(partner))
        .withColumn("_other", F.col("_node").bitwiseXOR(F.col("_mask")))
        .select(
            "block", "group", F.least("_node", "_other").alias("p"), F.greatest("_node", "_other").alias("q"),
            (F.col("_node") > F.col("_other")).cast("int").alias("side"), "_fp",
        )
    )
    return (
        small.unionByName(split)
        .repartition("block", "group", "p", "q")
        .sortWithinPartitions("block", "group", "p", "q")
        .mapInArrow(link_batches, "a long, b long")
    )


def near_groups(prints: DataFrame) -> DataFrame:
    """``_fp``, ``_label``, ``component_id`` for every distinct fingerprint of ``doc_id``, ``_fp``.

    ``_label`` is the component's smallest fingerprint. Unlike its smallest
    identifier, which may be missing or repeated, no other component has it.
    """
    nodes = materialise(prints.groupBy("_fp").agg(F.min("doc_id").alias("_first")))
    labels = components(near_links(nodes.select("_fp")))
    joined = nodes.join(labels, nodes["_fp"] == labels["node"], "left").select(
        "_fp", "_first", F.coalesce("label", "_fp").alias("_label")
    )
    joined = materialise(joined)
    least = joined.groupBy("_label").agg(F.min("_first").alias("component_id"))
    return joined.join(least, "_label").select("_fp", "_label", "component_id")


def simhash_groups(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: fingerprint and the smallest identifier it reaches over links.

    Defined cases: a missing text is empty; a text without words has
    fingerprint zero and links like any other; repeated rows come back as
    often as they are given; missing identifiers are passed over when the
    smallest is sought, and a component without any has none. An empty table
    gives no rows. Other columns aren't read.
    """
    prints = materialise(with_fingerprints(docs))
    groups = near_groups(prints)
    return prints.join(groups, "_fp").select(
        "doc_id", F.lower(F.lpad(F.hex("_fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def keep_one(docs: DataFrame) -> DataFrame:
    """``docs`` with one row for each component, that with the smallest identifier; all columns stay.

    Rows that tie on it are told apart by fingerprint, then by all their columns.
    Components are told apart by their smallest fingerprint, so each keeps a
    row even where identifiers are missing or repeated.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    fields = ", ".join(f"`{f.name}`: {f.dataType.simpleString()}" for f in docs.schema.fields)
    marked = materialise(
        docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), whole_text().alias("_text"))
        .mapInArrow(fingerprint_batches, f"_row struct<{fields}>, _fp bigint")
    )
    prints = marked.select(F.col("_row.doc_id").cast(kind).alias("doc_id"), "_fp")
    groups = near_groups(prints)
    winners = (
        prints.groupBy("doc_id", "_fp").agg(F.count(F.lit(1)).alias("_same"))
        .join(groups, "_fp")
        .where(F.col("doc_id").eqNullSafe(F.col("component_id")))
    )
    # one fingerprint for each component, even where rows repeat an identifier
    winners = materialise(winners.withColumn("_pick", F.struct("_fp", "_same")).groupBy("_label", "doc_id").agg(F.min("_pick").alias("_pick")))
    winners = winners.select(F.col("doc_id").alias("_id"), F.col("_pick._fp").alias("_win"), F.col("_pick._same").alias("_same"))
    stay = marked.join(
        winners, (F.col("_fp") == F.col("_win")) & F.col("_row.doc_id").eqNullSafe(F.col("_id"))
    )
    once = stay.where("_same = 1").select("_row")
    again = stay.where("_same > 1").groupBy("_win", "_id").agg(F.min("_row").alias("_row")).select("_row")
    return once.unionByName(again).select("_row.*")
