"""Spelling variants: words one insertion, deletion or replacement apart, found in a trie of letter counts.

A word's vector has its length and how often each group of letters occurs in
it. One edit adds one letter, takes one, or does both; so the vectors of near
words differ by a surplus of one at most and a deficit of one at most. The
trie has a level for each number of the vector. A search goes down pairs of
nodes and drops a pair that spends more than its budget; words that meet at
the leaves are compared letter by letter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tradelanes.llm.common import whole_text
from tradelanes.session import materialise

LEAST_CHARS = 7
LEAST_COUNT = 2
#: One occurrence in so many loses a letter before it is counted.
EVERY = 31
#: A form is this many times as frequent as its variant.
RATIO = 10
#: Letters by group, from the top of the trie down; all others are the last group.
GROUPS = ["e", "a", "i", "n", "o", "r", "t", "s", "l", "u", "h", "d", "c", "m", "g", "w", "b", "p", "f", "v", "k", "y", "jq", "xz"]
LEVELS = len(GROUPS) + 2
#: Words below one node of the trie that a task may hold, besides their visitors; depths at which the trie is cut for that.
NODE_WORDS = 10_000
DEPTHS = (2, 3, 4, 5, 6, 8, 11, 15, 20, LEVELS)
#: Pairs of nodes, or of words, searched together.
_FRONTIER = 1 << 17


def runs(text: Column, least: int = LEAST_CHARS) -> Column:
    """Maximal runs of letters with at least ``least`` of them, A-Z made small."""
    found = F.regexp_extract_all(text, F.lit(f"[A-Za-z\\u00C0-\\u00FF]{{{least},}}"), F.lit(0))
    return F.transform(found, lambda x: F.translate(x, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))


def words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``word`` and ``n`` for the words of at least seven code points that occur at least twice.

    Where 31 divides the CRC-32 ``h`` of ``identifier:run``, the run loses its
    code point ``h % length``. That never makes a short run longer, so short
    runs are left out from the start. A missing identifier is written as
    nothing.
    """
    found = docs.select(
        F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("_id"), F.explode(runs(whole_text(text_col))).alias("_run")
    ).withColumn("_h", F.crc32(F.concat("_id", F.lit(":"), "_run").cast("binary")))
    at = (F.col("_h") % F.char_length("_run")).cast("int")
    cut = F.concat(F.substring(F.col("_run"), F.lit(1), at), F.substring(F.col("_run"), at + 2, F.char_length("_run")))
    word = F.when(F.col("_h") % EVERY == 0, cut).otherwise(F.col("_run"))
    counts = found.select(word.alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return counts.where((F.char_length("word") >= LEAST_CHARS) & (F.col("n") >= LEAST_COUNT))


_GROUP_OF = np.full(256, LEVELS - 1, dtype=np.int64)
for _k, _letters in enumerate(GROUPS):
    for _letter in _letters:
        _GROUP_OF[ord(_letter)] = _k + 1


def vectors(spelled: list[str]) -> np.ndarray:
    """Each word's length and group counts; every letter is a code point below 256."""
    lengths = np.array([len(w) for w in spelled], dtype=np.int64)
    letters = np.frombuffer("".join(spelled).encode("latin-1"), dtype=np.uint8)
    out = np.zeros((len(spelled), LEVELS), dtype=np.int32)
    np.add.at(out, (np.repeat(np.arange(len(spelled)), lengths), _GROUP_OF[letters]), 1)
    out[:, 0] = lengths
    return out


def _pack(rows: np.ndarray) -> list[bytes]:
    wide = np.ascontiguousarray(rows.astype(">u4"))
    step = wide.shape[1] * 4
    raw = wide.tobytes()
    return [raw[i : i + step] for i in range(0, len(raw), step)]


def _nodes(depth: int):
    """Rows with the node ``depth`` levels down that a word lies below."""

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                v = vectors(batch.column("word").to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns, pa.array(_pack(v[:, :depth]), type=pa.binary())], names=[*batch.schema.names, "_node"]
                )

    return place


def _visits(depth: int):
    """Each word at its own node, and at those where a near word may lie.

    Of two near words the shorter visits the longer one's node; of words of
    one length the one with the smaller node visits the other's.
    """

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in (batch.slice(i, 4096) for i in range(0, batch.num_rows, 4096)):
                v = vectors(piece.column("word").to_pylist())[:, :depth]
                targets, who, home = [v], [np.arange(len(v))], [np.ones(len(v), dtype=bool)]
                levels = range(1, depth)
                for length, up, down in [(1, None, None), *((1, i, None) for i in levels), *((0, i, j) for i in [None, *levels] for j in [None, *levels] if i != j)]:
                    # from a smaller node to a larger one: the first level that differs rises
                    if length == 0 and (up is None or down is not None and down < up):
                        continue
                    moved = v.copy()
                    moved[:, 0] += length
                    if up is not None:
                        moved[:, up] += 1
                    if down is not None:
                        moved[:, down] -= 1
                        rows = np.flatnonzero(v[:, down] > 0)
                    else:
                        rows = np.arange(len(v))
                    targets.append(moved[rows])
                    who.append(rows)
                    home.append(np.zeros(len(rows), dtype=bool))
                who = np.concatenate(who)
                yield pa.RecordBatch.from_arrays(
                    [
                        piece.column("word").take(pa.array(who)),
                        piece.column("n").take(pa.array(who)),
                        pa.array(_pack(np.concatenate(targets)), type=pa.binary()),
                        pa.array(np.concatenate(home)),
                    ],
                    names=["word", "n", "_node", "_home"],
                )

    return visit


def trie_pairs(a: np.ndarray, b: np.ndarray, ranges, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows of ``a`` and ``b`` whose vectors differ by one more and one less at most, a block at a time.

    ``ranges`` has the pairs of nodes to begin with: begins and ends in ``a``,
    then in ``b``. Both are sorted below a node, so a node is a range of rows. A step goes one level down
    on both sides and pairs children whose numbers differ by one or not at
    all, as far as the surplus and the deficit of the pair allow; the budget
    is spent once. With ``same`` the two are one table, and each pair of rows
    is found once. The first level is the length and takes no budget.
    """
    some = (ranges[1] > ranges[0]) & (ranges[3] > ranges[2])
    zero = np.zeros(int(some.sum()), dtype=np.int64)
    stack = [(0, *(x[some] for x in ranges), zero, zero)]
    while stack:
        level, al, ah, bl, bh, more, less = stack.pop()
        if not len(al):
            continue
        if len(al) > 1 and (ah - al + bh - bl).sum() > 4 * _FRONTIER:
            half = len(al) // 2
            stack.append((level, *(x[half:] for x in (al, ah, bl, bh, more, less))))
            stack.append((level, *(x[:half] for x in (al, ah, bl, bh, more, less))))
            continue
        if level == LEVELS:
            yield from _leaf_rows(al, ah, bl, bh, same)
            continue
        pa_, a_lo, a_hi = _children(a[:, level], al, ah)
        pb_, b_lo, b_hi = _children(b[:, level], bl, bh)
        value_a, value_b = a[a_lo, level].astype(np.int64), b[b_lo, level].astype(np.int64)
        # children of b by pair and number, to be met by those of a with the same number, one less and one more
        wide = int(max(value_a.max(), value_b.max())) + 3
        key_b = pb_ * wide + value_b
        parts = []
        for step in (-1, 0, 1):
            key = pa_ * wide + value_a + step
            where = np.searchsorted(key_b, key)
            hit = np.flatnonzero((where < len(key_b)) & (value_a + step >= 0))
            hit = hit[key_b[where[hit]] == key[hit]]
            at = where[hit]
            m, s = more[pa_[hit]], less[pa_[hit]]
            if level:
                m, s = m + (step > 0), s + (step < 0)
            keep = (m <= 1) & (s <= 1)
            if same:
                keep &= a_lo[hit] <= b_lo[at]
            hit, at = hit[keep], at[keep]
            parts.append((a_lo[hit], a_hi[hit], b_lo[at], b_hi[at], m[keep], s[keep]))
        merged = [np.concatenate(x) for x in zip(*parts, strict=True)]
        if len(merged[0]):
            stack.append((level + 1, *merged))


def _children(column: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For ranges of a sorted table: the runs of equal numbers in them, as range, begin and end."""
    sizes = hi - lo
    which = np.repeat(np.arange(len(lo)), sizes)
    rows = np.arange(len(which)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(lo, sizes)
    values = column[rows]
    first = np.flatnonzero(np.append(True, (which[1:] != which[:-1]) | (values[1:] != values[:-1])))
    begin = rows[first]
    return which[first], begin, begin + np.diff(np.append(first, len(rows)))


def _leaf_rows(al, ah, bl, bh, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs of rows of pairs of leaves, in blocks; with ``same`` the second row comes after the first."""
    for start in range(0, int((ah - al).max(initial=0))):
        x = al + start
        ok = x < ah
        x, lo, hi = x[ok], bl[ok], bh[ok]
        if same:
            lo = np.maximum(lo, x + 1)
        left = np.maximum(hi - lo, 0)
        ends = np.cumsum(left)
        begin = 0
        while begin < len(x):
            end = max(int(np.searchsorted(ends, (ends[begin - 1] if begin else 0) + _FRONTIER, side="right")), begin + 1)
            n = left[begin:end]
            rows = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo[begin:end], n)
            if len(rows):
                yield np.repeat(x[begin:end], n), rows
            begin = end


def one_edit(short: np.ndarray, long: np.ndarray, longer: bool) -> np.ndarray:
    """Whether rows of letters, padded with zeros, are exactly one edit apart; ``long`` has a letter more if ``longer``."""
    if not longer:
        return (short != long).sum(axis=1) == 1
    wide = short.shape[1]
    same = short == long
    ahead = np.cumprod(same, axis=1).sum(axis=1)  # letters alike from the start
    behind = np.zeros((len(short), wide), dtype=bool)
    behind[:, : wide - 1] = short[:, : wide - 1] == long[:, 1:]
    length = (short != 0).sum(axis=1)
    wrong = (~behind) & (np.arange(wide) < length[:, None]) & (np.arange(wide) >= ahead[:, None])
    return ~wrong.any(axis=1)


def _letters(spelled: list[str]) -> np.ndarray:
    lengths = np.array([len(w) for w in spelled], dtype=np.int64)
    out = np.zeros((len(spelled), int(lengths.max(initial=0)) + 1), dtype=np.uint8)
    letters = np.frombuffer("".join(spelled).encode("latin-1"), dtype=np.uint8)
    row = np.repeat(np.arange(len(spelled)), lengths)
    out[row, np.arange(len(letters)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = letters
    return out


def near_rows(spelled: list[str], node: np.ndarray, home: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of words at home in one node, and of these with the node's visitors, that are exactly one edit apart."""
    v, letters = vectors(spelled), _letters(spelled)
    order = np.lexsort((*v.T[::-1], node))
    inside, guests = order[home[order]], order[~home[order]]
    names = np.unique(node[inside])
    at_home = [np.searchsorted(node[inside], names, side=s) for s in ("left", "right")]
    on_visit = [np.searchsorted(node[guests], names, side=s) for s in ("left", "right")]
    found = [np.zeros((2, 0), dtype=np.int64)]
    for left, ranges, same in ((inside, [*at_home, *at_home], True), (guests, [*on_visit, *at_home], False)):
        for x, y in trie_pairs(v[left], v[inside], ranges, same):
            x, y = left[x], inside[y]
            swap = v[x, 0] > v[y, 0]
            x, y = np.where(swap, y, x), np.where(swap, x, y)
            for longer in (False, True):
                pick = v[y, 0] - v[x, 0] == int(longer)
                p, q = x[pick], y[pick]
                wide = int(v[q, 0].max(initial=0)) + 1
                ok = one_edit(letters[p, :wide], letters[q, :wide], longer)
                found.append(np.stack([p[ok], q[ok]]))
    p, q = np.concatenate(found, axis=1)
    return p, q


_NEAR = "word string, n long, n_near long, form_n long, form string"


def _settle(group: pd.DataFrame) -> pd.DataFrame:
    """For the words of some nodes and their visitors: how many near words each has here, and the most frequent of them."""
    node, home = pd.factorize(group["_node"])[0], group["_home"].to_numpy(dtype=bool)
    some = np.isin(node, node[home])  # nodes without words have visitors only
    group, node, home = group[some], node[some], home[some]
    spelled, n = group["word"].tolist(), group["n"].to_numpy()
    p, q = near_rows(spelled, node, home)
    if not len(p):
        return pd.DataFrame({"word": [], "n": [], "n_near": [], "form_n": [], "form": []}).astype(
            {"word": str, "n": int, "n_near": int, "form_n": int, "form": str}
        )
    word, other = np.concatenate([p, q]), np.concatenate([q, p])
    rank = np.empty(len(spelled), dtype=np.int64)  # by frequency, then spelling
    rank[sorted(range(len(spelled)), key=lambda i: (-n[i], spelled[i]))] = np.arange(len(spelled))
    order = np.lexsort((rank[other], word))
    word, other = word[order], other[order]
    # a word may be here several times, at home and on visits
    first = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
    who, best = word[first], other[first]
    return pd.DataFrame({
        "word": [spelled[i] for i in who], "n": n[who], "n_near": np.diff(np.append(first, len(word))),
        "form_n": n[best], "form": [spelled[i] for i in best],
    })


def _depth(counted: DataFrame, most: int) -> int:
    """Levels of the trie down to nodes of ``most`` words or fewer; all levels if even that isn't enough."""
    for depth in DEPTHS:
        sizes = counted.mapInArrow(_nodes(depth), "word string, n long, _node binary").groupBy("_node").count()
        if (sizes.agg(F.max("count")).first()[0] or 0) <= most:
            return depth
    return LEVELS


def near_words(counted: DataFrame, node_words: int = NODE_WORDS) -> DataFrame:
    """``word``, ``n``, ``n_near`` and its most frequent near word (``form_n``, ``form``) for words that have any.

    The trie is cut at the depth where no node has more than ``node_words``
    words. A node's words go to one task, together with those words of other
    nodes that the budget lets visit it; each pair meets in one node. Small
    nodes share a task.
    """
    depth = _depth(counted, node_words)
    shares = max(1, 2 * counted.count() // node_words)
    visits = counted.mapInArrow(_visits(depth), "word string, n long, _node binary, _home boolean")
    part = visits.groupBy(F.pmod(F.xxhash64("_node"), F.lit(shares)).alias("_share")).applyInPandas(_settle, _NEAR)
    best = F.min(F.struct((-F.col("form_n")).alias("m"), "form")).alias("_best")
    return part.groupBy("word", "n").agg(F.sum("n_near").alias("n_near"), best).select(
        "word", "n", "n_near", (-F.col("_best.m")).alias("form_n"), F.col("_best.form").alias("form")
    )


def roots(forms: DataFrame) -> DataFrame:
    """``word`` and ``root`` for words with a ``form``: where following forms ends.

    Each step is to a word ten times as frequent, so a chain is short; every
    round doubles the steps taken, until no word's goal has a form itself.
    """
    open_ = materialise(forms.select("word", F.col("form").alias("root")))
    while True:
        further = open_.toDF("root", "_next")
        moved = open_.join(further, "root", "left")
        if moved.where("_next IS NOT NULL").isEmpty():
            return open_
        open_ = materialise(moved.select("word", F.coalesce("_next", "root").alias("root")))


def spelling_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every word with the form it is a variant of: ``word``, ``form``, ``root``, ``n``, ``n_near``, ``form_n``.

    Words are runs of letters of at least seven code points with at least two
    occurrences, counted after one occurrence in 31 has lost a letter. Near
    words are exactly one edit apart. A word's form is the most frequent near
    word, of equally frequent ones the first in the order of code points, if it
    is ten times as frequent as the word; else it is null. The root is where
    forms lead.

    Defined cases: a missing or empty text has no words; a missing identifier
    counts as nothing before the colon; repeated rows count as often as they
    are there. Words without near words have ``n_near`` 0, no form, and
    themselves as root. An empty table gives an empty result. Other columns,
    whatever their names, are neither read nor returned.
    """
    counted = materialise(words(docs, id_col, text_col))
    near = materialise(near_words(counted))
    forms = near.where(F.col("form_n") >= RATIO * F.col("n"))
    told = roots(forms)
    return (
        counted.join(near.select("word", "n_near"), "word", "left")
        .join(forms.select("word", "form", "form_n"), "word", "left")
        .join(told, "word", "left")
        .select("word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), "form_n")
    )
