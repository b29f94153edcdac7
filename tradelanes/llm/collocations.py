"""Phrases whose words keep company: frequent phrases after Toivonen, scored by their weakest cut.

A sample proposes phrases and, with them, the negative border: phrases that
aren't proposed although their first and last words but one are. A pass over
the whole corpus counts both. Where a phrase of the border turns out frequent,
longer phrases around it have not been counted, so a further pass counts those,
until no pass finds another.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tradelanes.llm.common import arrow, lower_ascii, portions, span_hashes, utf8, whole_text
from tradelanes.session import materialise

#: Words of the longest phrase, occurrences that make a phrase frequent, phrases kept of each language.
LONGEST = 5
LEAST = 100
TOP = 2000
#: One stretch of text in so many is in the sample, of so many bytes; a phrase is proposed at this share of what its sample should have.
SAMPLED = 8
STRETCH = 512
LOWERED = 0.25
#: A filter of phrases has 32 bits for each, 2**27 bits (16 MB) at most. Where it is full it lets more be counted, never less.
FILTER_BITS = 27
#: Bytes of text taken at a time; a longer text is read in stretches of it.
_PORTION = 2 << 20
_COUNTED = "_h bigint, _count bigint"
_SPELLED = "lang string, words int, phrase string, f bigint"
_MIX = np.uint64(0x9E3779B97F4A7C15)
_LENGTH = np.uint64(7)
_WORD = re.compile(rb"[^ \t\n\x0b\x0c\r.,;:!?]+")
_NO_WORD = re.compile(rb"[ \t\n\x0b\x0c\r.,;:!?]")


def _spread(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, pa.Array, int]]:
    """Texts, their languages, and the bytes in which phrases may begin.

    A text longer than a portion is cut after a mark or blank. A stretch of it
    has as many words more as a phrase that begins in it may need.
    """
    for batch in portions(batches, "_text", _PORTION):
        texts, languages = batch.column("_text"), batch.column("_lang")
        data, _ = utf8(texts)
        if batch.num_rows > 1 or len(data) <= _PORTION:
            yield texts, languages, len(data)
            continue
        raw, start = data.tobytes(), 0
        while start < len(raw):
            cut = _NO_WORD.search(raw, start + _PORTION)
            own = end = cut.end() if cut else len(raw)
            for _ in range(LONGEST - 1):
                more = _WORD.search(raw, end)
                end = more.end() if more else end
            yield pa.array([raw[start:end]], type=pa.binary()), languages, own - start
            start = own


def drawn(texts: pa.Array, languages: pa.Array) -> tuple[pa.Array, pa.Array]:
    """One stretch of bytes in ``SAMPLED``, each a text of its own; words cut at its ends are no harm in a sample."""
    data, offsets = utf8(texts)
    seed = np.frombuffer(data[:STRETCH].tobytes() + len(data).to_bytes(8, "little"), dtype=np.uint8)
    pick = np.random.default_rng(seed).random(-(-len(data) // STRETCH)) < 1 / SAMPLED
    keep = np.repeat(pick, STRETCH)[: len(data)]
    edges = np.union1d(np.arange(0, len(data) + 1, STRETCH), offsets)
    starts = edges[:-1][keep[edges[:-1]]] if len(data) else np.zeros(0, np.int64)
    kept = np.zeros(len(data) + 1, dtype=np.int64)
    np.cumsum(keep, out=kept[1:])
    cuts = np.append(kept[starts], kept[-1])
    parts = pa.LargeBinaryArray.from_buffers(
        pa.large_binary(), len(starts), [None, pa.py_buffer(cuts), pa.py_buffer(np.ascontiguousarray(data[keep]))]
    )
    return parts, languages.take(pa.array(np.searchsorted(offsets, starts, side="right") - 1))


class Words:
    """The words of some texts in order: their bytes, language, text and piece."""

    def __init__(self, texts: pa.Array, languages: pa.Array, own: int | None = None):
        data, offsets = utf8(texts)
        self.data = data = lower_ascii(data)
        breaks = (data >= 10) & (data <= 13)
        for mark in b".,;:!?":
            breaks |= data == mark
        word = ~(breaks | (data == 32) | (data == 9))
        edge = np.zeros(len(data) + 1, dtype=bool)
        edge[offsets] = True
        apart = np.append(True, ~word)
        self.starts = np.flatnonzero(word & (apart[:-1] | edge[:-1]))
        apart = np.append(~word[1:], True) if len(word) else word
        self.ends = np.flatnonzero(word & (apart | edge[1:])) + 1
        self.own = self.starts < (len(data) if own is None else own)
        self.row = (np.searchsorted(offsets, self.starts, side="right") - 1).astype(np.int32)
        self.piece = np.cumsum(breaks, dtype=np.int32)[self.starts]
        coded = languages.dictionary_encode()
        self.languages = coded.dictionary.to_pylist()
        self.language = coded.indices.to_numpy(zero_copy_only=False).astype(np.int32)[self.row]
        self.spelled = span_hashes(data, self.starts, self.ends)

    def phrases(self) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """For each length: where a phrase of so many words begins, and its hash, whose last three bits are the length."""
        n = len(self.starts)
        seeds = np.array([xxhash.xxh64_intdigest(x.encode()) for x in self.languages], dtype=np.uint64)
        whole, h = np.ones(n, dtype=bool), _spread(self.spelled ^ seeds[self.language])
        yield 1, whole, (h & ~_LENGTH) | np.uint64(1)
        for length in range(2, LONGEST + 1):
            last = length - 1
            whole, a, b = np.zeros(n, dtype=bool), slice(0, max(n - last, 0)), slice(last, n)
            whole[a] = (self.row[a] == self.row[b]) & (self.piece[a] == self.piece[b])
            h = h.copy()
            h[a] = _spread(h[a] * _MIX + self.spelled[b])
            yield length, whole, (h & ~_LENGTH) | np.uint64(length)

    def texts(self, at: np.ndarray, length: int) -> pa.Array:
        """Phrases of ``length`` words, spelled with one blank between words."""
        first, end = self.starts[at], self.ends[at + length - 1]
        letters = sum(self.ends[at + k] - self.starts[at + k] for k in range(length))
        plain = end - first == letters + length - 1  # one blank or tab between words: a slice of the text
        size = np.where(plain, end - first, 0)
        offsets = np.append(0, np.cumsum(size))
        where = np.arange(offsets[-1]) - np.repeat(offsets[:-1], size) + np.repeat(first, size)
        data = self.data[where]
        data[data == 9] = 32
        sliced = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(at), [None, pa.py_buffer(offsets), pa.py_buffer(data)])
        if plain.all():
            return sliced.cast(pa.large_string())
        out = sliced.to_pylist()
        for i in np.flatnonzero(~plain).tolist():
            out[i] = b" ".join(self.data[self.starts[at[i] + k] : self.ends[at[i] + k]].tobytes() for k in range(length))
        return pa.array(out, type=pa.large_binary()).cast(pa.large_string())


def marked(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Which hashes a filter has."""
    slot = h >> np.uint64(64 - (len(bits).bit_length() + 5))
    return (bits[(slot >> np.uint64(6)).astype(np.int64)] >> (slot & np.uint64(63))) & np.uint64(1) != 0


def wanted(words: Words, filters: list[np.ndarray]) -> Iterator[np.ndarray]:
    """Hashes of the phrases to be counted in this pass, one array for each length.

    Without a filter all are. With one, every word is, and a phrase when the
    filter has both the phrase without its last word and that without its
    first. Further filters belong to further passes: what an earlier filter
    let through has been counted already.
    """
    had = before = None
    for length, whole, h in words.phrases():
        whole = whole & words.own
        if length > 1 and filters:
            whole &= had & np.append(had[1:], False)
        elif len(filters) > 1:
            whole[:] = False
        at = np.flatnonzero(whole)
        if length > 1:
            for bits in filters[:-1]:  # these see only what the last lets through
                at = at[~(marked(bits, before[at]) & marked(bits, before[at + 1]))]
        if filters and length < LONGEST:
            had, before = marked(filters[-1], h), h
        yield h[at]


def _counting(filters: list, sample: bool):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = [f.value for f in filters]
        for texts, languages, own in stretches(batches):
            words = Words(*drawn(texts, languages)) if sample else Words(texts, languages, own)
            for hashes in wanted(words, bits):
                if len(hashes):
                    hashes, sums = np.unique(hashes, return_counts=True)
                    yield arrow(_COUNTED.replace("bigint", "long"), {"_h": hashes.view(np.int64), "_count": sums})

    return count


def _spelling(bits):
    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = _SPELLED.replace("bigint", "long")
        for texts, languages, own in stretches(batches):
            words = Words(texts, languages, own)
            sums = np.bincount(words.language[words.own], minlength=len(words.languages))
            zeros = [0] * len(sums)
            yield arrow(schema, {"lang": words.languages, "words": zeros, "phrase": [""] * len(sums), "f": sums})
            for length, whole, h in words.phrases():
                at = np.flatnonzero(whole & words.own & marked(bits.value, h))
                if len(at):
                    _, first, sums = np.unique(h[at], return_index=True, return_counts=True)
                    at = at[first]
                    yield arrow(schema, {
                        "lang": pa.array(words.languages).take(pa.array(words.language[at])),
                        "words": np.full(len(at), length),
                        "phrase": words.texts(at, length),
                        "f": sums,
                    })

    return spell


def _filter(phrases: DataFrame):
    """A broadcast set of bits, one for the first bits of each phrase's hash."""
    size = min(FILTER_BITS, max(6, (32 * phrases.count()).bit_length()))
    slot = f"shiftrightunsigned(_h, {64 - size})"
    words = (
        phrases.select(F.expr(f"shiftright({slot}, 6) AS _place"), F.expr(f"shiftleft(1L, CAST({slot} & 63 AS INT)) AS _bit"))
        .groupBy("_place")
        .agg(F.bit_or("_bit").alias("_bits"))
        .toArrow()
    )
    bits = np.zeros(1 << (size - 6), dtype=np.uint64)
    bits[words.column("_place").to_numpy()] = words.column("_bits").to_numpy().view(np.uint64)
    return phrases.sparkSession.sparkContext.broadcast(bits)


def _pass(texts: DataFrame, filters: list, least: int, sample: bool = False) -> DataFrame:
    """Hashes of phrases with at least ``least`` occurrences among those this pass counts."""
    counted = texts.mapInArrow(_counting(filters, sample), _COUNTED).groupBy("_h").agg(F.sum("_count").alias("_count"))
    return materialise(counted.where(F.col("_count") >= least).select("_h"))


def frequent_phrases(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = LEAST) -> tuple[DataFrame, DataFrame]:
    """Every phrase of up to five words with at least ``least`` occurrences, and all words of each language.

    The first frame has ``lang``, ``words``, ``phrase`` and ``f``, the second
    ``lang`` and ``n``. Both are exact whatever the sample proposes: a phrase
    is counted as soon as the two phrases it has of one word less are known to
    be frequent, and passes go on until every frequent phrase has met that.
    Each further pass looks at phrases at least a word longer, so there are as
    many passes as a phrase has words at most.

    These passes shuffle a 64-bit hash and a sum for each phrase and task.
    Phrases whose hashes agree are counted together, so that none is missed;
    the last pass spells out what may be frequent and counts it by its words.
    The sets that tasks look hashes up in have a fixed size.
    """
    texts = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("_lang"), whole_text(text_col).alias("_text"))
    short = f"(_h & 7) < {LONGEST}"
    proposed = _pass(texts, [], max(int(least * LOWERED / SAMPLED), 2), sample=True).where(short)
    filters = [_filter(proposed)]
    found = _pass(texts, filters, least)
    while not found.where(short).join(proposed, "_h", "left_anti").isEmpty():
        proposed = found.where(short)
        filters.append(_filter(proposed))
        found = found.unionByName(_pass(texts, filters, least))
    spelled = texts.mapInArrow(_spelling(_filter(found)), _SPELLED).groupBy("lang", "words", "phrase").agg(F.sum("f").alias("f"))
    named = materialise(spelled.where((F.col("words") == 0) | (F.col("f") >= least)))
    return named.where("words > 0"), named.where("words = 0 AND f > 0").select("lang", F.col("f").alias("n"))


def scored_phrases(phrases: DataFrame, sizes: DataFrame) -> DataFrame:
    """Candidates with their weakest cut: ``lang``, ``phrase``, ``a``, ``l``, ``r``, ``n``, ``score``.

    A candidate that a longer one contains and that is no more frequent than
    it is left out. It is enough to look at candidates one word longer: of two
    phrases, one in the other and equally frequent, all between are so as well.
    """
    candidates = phrases.where("words >= 2").withColumnRenamed("f", "a")
    parts = F.split("phrase", " ")
    longer = candidates.where("words >= 3").select(
        "lang", F.col("a"), F.explode(F.array(F.slice(parts, F.lit(1), F.col("words") - 1), F.slice(parts, F.lit(2), F.col("words") - 1))).alias("_inner")
    )
    covered = longer.select("lang", F.array_join("_inner", " ").alias("phrase"), "a").distinct()
    cuts = (
        candidates.join(covered, ["lang", "phrase", "a"], "left_anti")
        .withColumn("_parts", parts)
        .withColumn("_k", F.explode(F.sequence(F.lit(1), F.col("words") - 1)))
        .select(
            "lang", "phrase", "a", "_k",
            F.array_join(F.slice("_parts", F.lit(1), F.col("_k")), " ").alias("_first"),
            F.array_join(F.slice("_parts", F.col("_k") + 1, F.col("words") - F.col("_k")), " ").alias("_rest"),
        )
    )
    known = phrases.select("lang", "phrase", "f")
    scored = (
        cuts.join(known.toDF("lang", "_first", "l"), ["lang", "_first"])
        .join(known.toDF("lang", "_rest", "r"), ["lang", "_rest"])
        .join(sizes, "lang")
        .withColumn(
            "score",
            F.expr(
                "(CAST(1000 * a AS DECIMAL(18, 0)) * CAST(n AS DECIMAL(18, 0))) div (CAST(l AS DECIMAL(18, 0)) * CAST(r AS DECIMAL(18, 0)))"
            ).cast("long"),
        )
    )
    return (
        scored.groupBy("lang", "phrase", "a", "n")
        .agg(F.min(F.struct("score", F.col("_k"), "l", "r")).alias("_cut"))
        .select("lang", "phrase", "a", F.col("_cut.l").alias("l"), F.col("_cut.r").alias("r"), "n", F.col("_cut.score").alias("score"))
    )


def top_phrases(scored: DataFrame, top: int = TOP) -> DataFrame:
    """The first ``top`` of each language by score, then frequency, then spelling, with their ``rank``.

    A language's candidates are thinned in 4096 shares, then in 64, before the
    last window sees them, so that no task sorts a whole language.
    """
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    share = scored.withColumn("_share", F.pmod(F.xxhash64("phrase"), F.lit(4096)))
    for shares in (4096, 64, 1):
        window = Window.partitionBy("lang", F.col("_share") % shares).orderBy(*order)
        share = share.withColumn("_rank", F.row_number().over(window)).where(F.col("_rank") <= top)
    return share.select("lang", F.col("_rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def collocations(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = LEAST, top: int = TOP) -> DataFrame:
    """The phrases of each language whose words keep company most: ``lang``, ``rank``, ``phrase``, ``a``, ``l``, ``r``, ``n``, ``score``.

    A-Z are made small, texts split at ``.,;:!?`` and line breaks into pieces,
    pieces at blanks and tabs into words. A phrase's score is that of its
    weakest cut in two, ``floor(1000 * a * n / (l * r))``.

    Defined cases: a missing text has no words; a missing language is ``und``.
    A language without words or without frequent phrases is not in the result.
    Identifiers aren't read; repeated rows are counted like any others. Ties are ordered by spelling, in
    the order of bytes. An empty table gives an empty result. Other columns,
    whatever their names, are neither read nor returned.
    """
    return top_phrases(scored_phrases(*frequent_phrases(docs, text_col, lang_col, least)), top)
