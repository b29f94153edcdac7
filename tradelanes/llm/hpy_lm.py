"""A hierarchical Pitman-Yor language model over word pairs, seated by Gibbs sampling."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
import xxhash
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tradelanes.llm.common import arrow, fold, lower_ascii, portions, span_hashes, utf8, whole_text, word_spans
from tradelanes.session import materialise, scratch_folder

FOLDS, HELD_OUT = 7, 2
#: Words whose counts and restaurants every task knows; those of other words are looked up part by part.
FREQUENT = 1 << 17
#: Rounds of Gibbs sampling that bring all parts up to date with each other, and seatings averaged at the end.
ROUNDS, SAMPLES, SWEEPS = 2, 3, 3
#: Tokens a part of the model should have, and text bytes packed at a time.
PART_TOKENS = 1_500_000
_PORTION = 4 << 20
_END = np.uint64(0x5851F42D4C957F2D)
_CHUNK = 1 << 16
CONCENTRATION = 1.0
#: Customers seated at a time, as a share of those that sit already; below 2 / _PACE one by one.
_PACE = 1 / 128
#: Customers of a cell up to which all numbers of tables are weighed against each other.
_WEIGHED = 32


def tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all tokens, an end after the words of each text, and the tokens before each text."""
    starts, ends, first = word_spans(data, offsets)
    hashes = span_hashes(lower_ascii(data), starts, ends)
    texts = np.arange(len(offsets) - 1)
    out = np.full(len(hashes) + len(texts), _END)
    place = np.arange(len(hashes)) + np.repeat(texts, np.diff(first))
    out[place] = hashes
    return out, first + np.arange(len(first))


@dataclass
class Known:
    """The frequent words and the totals: all that every task needs of the vocabulary."""

    words: np.ndarray  # sorted hashes
    counts: np.ndarray
    total: int
    distinct: int

    def find(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Place of each word among the frequent ones, and whether it is one."""
        if not len(self.words):
            return np.zeros(len(words), np.int64), np.zeros(len(words), bool)
        at = np.minimum(np.searchsorted(self.words, words), len(self.words) - 1)
        return at, self.words[at] == words

    def base(self, counts: np.ndarray) -> np.ndarray:
        """The smoothed log10 probability of words of these counts."""
        return np.log10((counts + 1) / (self.total + self.distinct + 1))

    def contexts(self, words: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Restaurant of the context of every token: of the word before, or of the beginning of a text.

        A frequent word's is its place, any other word's its hash.
        """
        at, known = self.find(words)
        own = np.where(known, at.astype(np.uint64), np.where(words > FREQUENT, words, ~words))
        out = np.empty(len(words), np.uint64)
        out[1:] = own[:-1]
        out[first[:-1]] = FREQUENT  # every text begins in one restaurant
        return out


def _pack(array: np.ndarray, width: int) -> bytes:
    planes = array.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width]
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(planes.T).tobytes())


def _unpack(data: bytes, width: int) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(width, -1)
    out = np.zeros((planes.shape[1], 8), np.uint8)
    out[:, :width] = planes.T
    return out.view("<u8").ravel()


def _pack_all(*columns: tuple[np.ndarray, int]) -> bytes:
    """Columns of numbers, each of so many low bytes, in one buffer."""
    sizes = np.array([len(values) for values, _ in columns], "<u8").tobytes()
    planes = [values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T for values, width in columns]
    return zstandard.ZstdCompressor(level=1).compress(b"".join([sizes, *(np.ascontiguousarray(p).tobytes() for p in planes)]))


def _unpack_all(data: bytes, *widths: int) -> list[np.ndarray]:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    sizes, at, out = raw[: 8 * len(widths)].view("<u8").tolist(), 8 * len(widths), []
    for many, width in zip(sizes, widths, strict=True):
        column = np.zeros((many, 8), np.uint8)
        column[:, :width] = raw[at : at + many * width].reshape(width, many).T
        out.append(column.view("<u8").ravel())
        at += many * width
    return out


def _numbered(contexts: np.ndarray, *others: np.ndarray) -> tuple[np.ndarray, ...]:
    """Contexts with the rare ones numbered after the others, ``others``, and the hashes of the rare ones in order."""
    rare = contexts > FREQUENT
    found, number = np.unique(contexts[rare], return_inverse=True)
    out = contexts.astype(np.int64)
    out[rare] = FREQUENT + 1 + number
    return out, *others, found


def _named(numbers: np.ndarray, found: np.ndarray) -> np.ndarray:
    """The contexts that ``_numbered`` has numbered."""
    out, rare = numbers.copy(), numbers > FREQUENT
    out[rare] = found[(numbers[rare] - np.uint64(FREQUENT + 1)).astype(np.int64)]
    return out


_PACKED = "part int, portion long, tokens binary, texts binary"
#: Bytes of: words, occurrences of each, contexts, row in the portion with the training flag in the lowest bit, and hashes of rare contexts.
_TOKENS = (8, 4, 4, 4, 8)
#: Bytes of: keys of a portion's texts, their tokens, frequent ones among them, and those's base score.
_TEXTS = (8, 5, 5, 8)


def _packed(batches: Iterator[pa.RecordBatch], known: Known, parts: int) -> Iterator[pa.RecordBatch]:
    """Tokens of the texts dealt to the parts of the model, packed by portions of texts.

    A frequent word goes to parts by itself and its context, so that it is
    spread over all; a rare one by itself, so that its part has all of it.
    Tokens carry their row in the portion only; the texts' keys, and all that
    is known of them already, travel once, with one of the parts. A portion's
    number holds its keys too, so that one made again with other rows cannot
    pass for the first.
    """
    for number, batch in enumerate(portions(batches, "_text", _PORTION)):
        data, offsets = utf8(batch.column("_text"))
        words, first = tokens(data, offsets)
        del data
        contexts = known.contexts(words, first)
        row = np.repeat(np.arange(batch.num_rows), np.diff(first))
        at, often = known.find(words)
        mixed = words + np.where(often, contexts * np.uint64(0x9E3779B97F4A7C15), np.uint64(0))
        part = ((mixed >> np.uint64(33)) % np.uint64(parts)).astype(np.int64)
        keys = batch.column("_key").to_numpy().view(np.uint64)
        task = TaskContext.get()
        place = np.array([task.partitionId() if task else 0, number], np.int64)
        portion = xxhash.xxh64_intdigest(place.tobytes() + keys.tobytes())
        base = np.bincount(row[often], weights=known.base(known.counts[at[often]]), minlength=batch.num_rows)
        texts = _pack_all(
            (keys, 8), (np.diff(first), 5), (np.bincount(row[often], minlength=batch.num_rows), 5), (base.view(np.uint64), 8)
        )
        marked = row * 2 + batch.column("_train").to_numpy(zero_copy_only=False)[row]
        order = np.lexsort((words, part))
        cuts = np.searchsorted(part[order], np.arange(parts + 1))
        out = {name.split()[0]: [] for name in _PACKED.split(", ")}
        for p in range(parts):
            home = portion % parts == p
            own = order[cuts[p] : cuts[p + 1]]
            if not len(own) and not home:
                continue
            w = words[own]
            heads = np.flatnonzero(np.diff(w, prepend=~w[:1]))
            out["part"].append(p)
            out["portion"].append(int(np.uint64(portion).view(np.int64)))
            out["tokens"].append(
                _pack_all(*zip((w[heads], np.diff(np.append(heads, len(w))), *_numbered(contexts[own], marked[own])), _TOKENS, strict=True))
            )
            out["texts"].append(texts if home else b"")
        yield arrow(_PACKED, out)


_CELLS = "part int, words binary, first binary, contexts binary, rare binary, counts binary, cell binary, rows binary, texts binary, homes binary"
#: Bytes of: portions, rows in use of each, those rows; and of portions at home here, their sizes, and their texts.
_USED, _HOMES = (8, 4, 4), (8, 4, *_TEXTS)


def _cells(frame: pd.DataFrame) -> pd.DataFrame:
    """A part of the model: its cells (word and context) with their training counts, and the tokens that fall in each."""
    words, contexts, rows, train, used, base = [], [], [], [], [], 0
    for data in frame["tokens"]:
        heads, runs, own, marked, found = _unpack_all(data, *_TOKENS)
        words.append(np.repeat(heads, runs.astype(np.int64)))
        contexts.append(_named(own, found))
        train.append((marked & np.uint64(1)).astype(bool))
        found, local = np.unique(marked >> np.uint64(1), return_inverse=True)
        rows.append((local + base).astype(np.int32))
        used.append(found.astype(np.uint32))
        base += len(found)
    portion = frame["portion"].to_numpy().view(np.uint64)
    home = np.flatnonzero(frame["texts"].str.len() > 0)
    columns = [_unpack_all(frame["texts"].iloc[k], *_TEXTS) for k in home]
    homes = [portion[home], np.array([len(c[0]) for c in columns], np.int64)]
    homes += [np.concatenate([np.zeros(0, np.uint64), *(c[k] for c in columns)]) for k in range(len(_TEXTS))]
    texts = _pack_all((portion, 8), (np.array([len(u) for u in used]), 4), (np.concatenate(used), 4))
    del used, columns
    words, contexts, rows, train = map(np.concatenate, (words, contexts, rows, train))
    order = np.lexsort((contexts, words))
    w, c, rows, train = words[order], contexts[order], rows[order], train[order]
    del words, contexts, order
    new_word = np.ones(len(w), bool)
    new_word[1:] = w[1:] != w[:-1]
    new = new_word.copy()
    new[1:] |= c[1:] != c[:-1]
    heads = np.flatnonzero(new)
    counts = np.add.reduceat(train, heads, dtype=np.int64) if len(heads) else np.zeros(0, np.int64)
    first = np.cumsum(new)[new_word] - 1
    numbers, rare = _numbered(c[heads])
    packed = {
        "part": [int(frame["part"].iloc[0])], "words": [_pack(w[new_word], 8)], "first": [_pack(first, 5)],
        "contexts": [_pack(numbers, 4)], "rare": [_pack(rare, 8)], "counts": [_pack(counts, 6)],
        "cell": [_pack(np.diff(np.append(heads, len(w))), 5)], "rows": [_pack(rows, 5)],
        "texts": [texts], "homes": [_pack_all(*zip(homes, _HOMES, strict=True))],
    }
    return pd.DataFrame(packed)


@dataclass
class State:
    """What all parts know of each other: tables and customers of the frequent contexts, tables of the frequent words."""

    tables: np.ndarray  # by frequent context
    customers: np.ndarray
    word_tables: np.ndarray  # by frequent word
    discount: float = 0.75
    top_discount: float = 0.75
    all_tables: int = 1  # customers of the parent restaurant
    distinct: int = 1
    seed: int = field(default=0)

    def parent(self, tables: np.ndarray) -> np.ndarray:
        """Probability of words in the restaurant that all contexts share, from their tables below.

        Its own parent gives each draw a word never seen, so a word has one
        table there.
        """
        return np.maximum(tables - self.top_discount, 1e-3) / (CONCENTRATION + self.all_tables)

    def unseen(self) -> float:
        """Probability of any word never seen, in the restaurant that all contexts share."""
        return (CONCENTRATION + self.top_discount * self.distinct) / (CONCENTRATION + self.all_tables)


def _drawn(n: int, pull: np.ndarray, discount: float, rng: np.random.Generator) -> np.ndarray:
    """Tables of cells of ``n`` customers each, drawn from the weights of all their seatings."""
    seatings = np.zeros(n + 1)  # weight of all seatings at k tables, without the new tables' own
    seatings[1] = 1.0
    k = np.arange(n + 1)
    for seated in range(1, n):
        grown = seatings * np.maximum(seated - discount * k, 0)
        grown[1:] += seatings[:-1]
        seatings = grown
    total = np.zeros(len(pull))
    weights = np.empty((n, len(pull)))
    power = np.ones(len(pull))
    for tables in range(1, n + 1):
        total += seatings[tables] * power
        weights[tables - 1] = total
        power *= np.minimum(pull, 1e9)
    return 1 + (weights[:-1] < rng.random(len(pull)) * total).sum(axis=0)


def _outlook(counts: np.ndarray, pull: np.ndarray, discount: float) -> np.ndarray:
    """For each cell the x in 0..1 with ``pull * x == counts * (1 - x) ** (1 - discount)``, by bisection.

    Tables of a cell are a Poisson number of sizes that follow Sibuya's law;
    at this x, sizes weighing x to their power add up to the cell's customers.
    """
    low, high = np.zeros(len(counts)), np.ones(len(counts))  # of 1 - x
    for _ in range(40):
        rest = (low + high) / 2
        more = counts * rest ** (1 - discount) > pull * (1 - rest)
        high, low = np.where(more, rest, high), np.where(more, low, rest)
    return 1 - high


def seat(counts: np.ndarray, pull: np.ndarray, discount: float, rng: np.random.Generator, sweeps: int) -> np.ndarray:
    """Tables of each cell with that many customers, where a new table weighs ``pull``.

    Gibbs sampling by blocks: given all other cells, a cell's whole seating is
    drawn anew. Its probability is the product of the weights with which
    customers sit down, a table's customers less the discount or the new
    table's, so a customer's choice depends on those that come after. For few
    customers these weights are added up. More of them
    are seated one after the other by weights that foresee the rest: a table
    opened after i of n customers counts ``(1 - x + x * i / n) ** discount``
    times its weight, which is right on average for all n and ``pull``. What is
    left between these and the true weights is made up for by Metropolis' rule
    over ``sweeps`` seatings. Of many customers a small share, ``_PACE``, sits
    down at a time.
    """
    tables = np.minimum(counts, 1).astype(np.int64)
    few = np.flatnonzero((counts > 1) & (counts <= _WEIGHED))
    few = few[np.argsort(counts[few], kind="stable")]
    for own in np.split(few, np.flatnonzero(np.diff(counts[few])) + 1):
        if len(own):
            tables[own] = _drawn(int(counts[own[0]]), pull[own], discount, rng)
    many = np.flatnonzero(counts > _WEIGHED)
    if not len(many):
        return tables
    many = many[np.argsort(-counts[many], kind="stable")]
    n_all, a_all = counts[many].astype(np.float64), pull[many]
    x_all = _outlook(n_all, a_all, discount)
    kept, kept_weight = None, None
    for _ in range(sweeps):
        t, weight = np.ones(len(many)), np.zeros(len(many))
        live, s = len(many), 1
        while live:
            n, a, x = n_all[:live], a_all[:live], x_all[:live]
            step = np.minimum(max(1, int(s * _PACE)), n - s)  # all cells have as many seated
            middle = s + (step - 1) / 2
            ahead = (1 - x * (1 - middle / n)) ** discount
            full = middle - discount * t[:live] + a * ahead
            chance = np.minimum(a * ahead / full, 1.0)
            if s * _PACE < 2:
                fresh = (rng.random(live) < chance).astype(np.float64)
            else:
                fresh = rng.binomial(step.astype(np.int64), chance).astype(np.float64)
            t[:live] += fresh
            weight[:live] += step * np.log(full) - fresh * np.log(ahead)
            s += max(1, int(s * _PACE))
            live = int(np.searchsorted(-n, -s, side="left"))  # the largest come first
        if kept is None:
            kept, kept_weight = t, weight
        else:
            take = np.log(rng.random(len(many)) + 1e-300) < weight - kept_weight
            kept, kept_weight = np.where(take, t, kept), np.where(take, weight, kept_weight)
    tables[many] = kept.astype(np.int64)
    return tables


class Part:
    """A part of the model, unpacked."""

    def __init__(self, row, known: Known, near: str | None = None, buckets: int = 1):
        self.number = int(row["part"])
        self.words = _unpack(row["words"], 8)
        self.first = _unpack(row["first"], 5).astype(np.int64)
        self.contexts = _unpack(row["contexts"], 4).astype(np.int64)
        self.rare = _unpack(row["rare"], 8)
        self.near = np.zeros((2, len(self.rare)), np.int64) if near is None else _read_near(near, self.number, self.rare, buckets)
        self.counts = _unpack(row["counts"], 6).astype(np.int64)
        self.word = np.repeat(np.arange(len(self.words)), np.diff(np.append(self.first, len(self.counts))))
        self.at, self.often = known.find(self.words)
        own = np.add.reduceat(self.counts, self.first)
        self.word_counts = np.where(self.often, known.counts[self.at] if len(known.counts) else 0, own)

    def word_tables(self, tables: np.ndarray, state: State | None) -> np.ndarray:
        """Tables of each word below: of rare ones they are all here, of frequent ones the state knows the sum."""
        own = np.add.reduceat(tables, self.first)
        return own if state is None else np.where(self.often, state.word_tables[self.at], own)

    def tables(self, state: State) -> np.ndarray:
        """Tables of each cell's context, over all parts."""
        return np.concatenate([state.tables, self.near[0]])[self.contexts]

    def customers(self, state: State) -> np.ndarray:
        """Customers of each cell's context, over all parts."""
        return np.concatenate([state.customers, self.near[1]])[self.contexts]

    def seated(self, state: State, draw: int) -> np.ndarray:
        """A seating: alternately the cells, and what their words' tables then give the parent."""
        rng = np.random.default_rng([state.seed, draw, self.number])
        tables = np.minimum(self.counts, 1)
        for _ in range(2):
            base = state.parent(self.word_tables(tables, state))[self.word]
            pull = base * (CONCENTRATION + state.discount * self.tables(state))
            tables = seat(self.counts, pull, state.discount, rng, SWEEPS)
        return tables


_SUMS = "kind int, chunk int, part int, sums binary"
#: Bytes of: hashes of rare contexts, their tables and their customers; the kind of row they travel in.
_NEAR, _RARE = (8, 6, 6), 4


def _chunks(kind: int, sums: np.ndarray) -> Iterator[tuple[int, int, bytes]]:
    for start in range(0, len(sums), _CHUNK):
        part = sums[start : start + _CHUNK]
        if part.any():
            yield kind, start // _CHUNK, part.astype("<i8").tobytes()


def _statistics(
    frame_rows: Iterator[dict], known: Known, state: State | None, near: str | None, buckets: int
) -> Iterator[pa.RecordBatch]:
    """Sums over a part: tables and customers by context, tables by frequent word, and how often small counts occur.

    Sums of rare contexts go to buckets of contexts, the others to all.
    """
    for row in frame_rows:
        part = Part(row, known, near, buckets)
        tables = np.minimum(part.counts, 1) if state is None else part.seated(state, 0)
        size = FREQUENT + 1 + len(part.rare)
        by_word = np.add.reduceat(tables, part.first)
        rare = by_word[~part.often & (part.word_counts > 0)]
        small = np.array([(part.counts == 1).sum(), (part.counts == 2).sum(), (rare == 1).sum(), (rare == 2).sum(), tables.sum()])
        sums = [np.bincount(part.contexts, weights=w, minlength=size).astype(np.int64) for w in (tables, part.counts)]
        out = [
            *_chunks(0, sums[0][: FREQUENT + 1]),
            *_chunks(1, sums[1][: FREQUENT + 1]),
            *_chunks(2, np.bincount(part.at[part.often], weights=by_word[part.often], minlength=max(len(known.words), 1))),
            *_chunks(3, small),
        ]
        for bucket, own in _by_bucket(part.rare, buckets):
            columns = (part.rare[own], *(x[FREQUENT + 1 :][own] for x in sums))
            out.append((_RARE, bucket, _pack_all(*zip(columns, _NEAR, strict=True))))
        columns = ([x[0] for x in out], [x[1] for x in out], [part.number] * len(out), [x[2] for x in out])
        yield arrow(_SUMS, dict(zip(("kind", "chunk", "part", "sums"), columns, strict=True)))


def _by_bucket(rare: np.ndarray, buckets: int) -> Iterator[tuple[int, np.ndarray]]:
    """Buckets of contexts, and the places in ``rare`` that each of them has, in order."""
    bucket = (rare % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    cuts = np.searchsorted(bucket[order], np.arange(buckets + 1))
    for k in range(buckets):
        if cuts[k + 1] > cuts[k]:
            yield k, order[cuts[k] : cuts[k + 1]]


def _added(frame: pd.DataFrame) -> pd.DataFrame:
    total = np.sum([np.frombuffer(x, "<i8") for x in frame["sums"]], axis=0)
    packed = {"kind": [int(frame["kind"].iloc[0])], "chunk": [int(frame["chunk"].iloc[0])], "part": [-1], "sums": [total.astype("<i8").tobytes()]}
    return pd.DataFrame(packed)


_BACK = "part int, chunk int, sums binary"


def _added_near(frame: pd.DataFrame) -> pd.DataFrame:
    """For a bucket of rare contexts and every part that has some of them, those's tables and customers over all parts."""
    columns = [_unpack_all(x, *_NEAR) for x in frame["sums"]]
    _, where = np.unique(np.concatenate([c[0] for c in columns]), return_inverse=True)
    tables, customers = (np.bincount(where, weights=np.concatenate([c[k] for c in columns])).astype(np.int64) for k in (1, 2))
    cuts = np.cumsum([0, *(len(c[0]) for c in columns)])
    own = [where[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
    back = [_pack_all((tables[w], 6), (customers[w], 6)) for w in own]
    return pd.DataFrame({"part": frame["part"].to_numpy(), "chunk": frame["chunk"].to_numpy(), "sums": back})


def _read_near(folder: str, part: int, rare: np.ndarray, buckets: int) -> np.ndarray:
    """Tables and customers over all parts of a part's rare contexts, from the files that ``_next_state`` has written."""
    out = np.zeros((2, len(rare)), np.int64)
    if not len(rare):
        return out
    store, root = fs.FileSystem.from_uri(folder)
    files = [f.path for f in store.get_file_info(fs.FileSelector(f"{root}/part={part}")) if f.path.endswith(".parquet")]
    got = pa.concat_tables([pq.ParquetFile(store.open_input_file(f)).read() for f in files])
    places, filled = dict(_by_bucket(rare, buckets)), 0
    for chunk, sums in zip(got.column("chunk").to_pylist(), got.column("sums").to_pylist(), strict=True):
        own = np.array(_unpack_all(sums, 6, 6)).astype(np.int64)
        out[:, places[chunk]] = own
        filled += own.shape[1]
    if filled != len(rare):
        raise RuntimeError(f"part {part} has {len(rare)} rare contexts and sums of {filled}")
    return out


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield {name: batch.column(name)[i].as_py() for name in batch.schema.names}


def _next_state(cells: DataFrame, known: Known, state: State | None, seed: int, near: str | None, buckets: int) -> tuple[State, str]:
    """What all parts know after a round, and the folder that has for each part the sums of its rare contexts."""
    spark = cells.sparkSession
    shared = spark.sparkContext.broadcast((vars(known), None if state is None else vars(state)))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, before = shared.value
        yield from _statistics(_rows(batches), Known(**own), None if before is None else State(**before), near, buckets)

    size = FREQUENT + 1
    arrays = {0: np.zeros(size, np.int64), 1: np.zeros(size, np.int64), 2: np.zeros(max(len(known.words), 1), np.int64), 3: np.zeros(5, np.int64)}
    columns = ["part", "words", "first", "contexts", "rare", "counts"]
    sums = materialise(cells.select(columns).mapInArrow(work, _SUMS))
    for r in sums.where(F.col("kind") != _RARE).groupBy("kind", "chunk").applyInPandas(_added, _SUMS).collect():  # bounded by FREQUENT
        part = np.frombuffer(r["sums"], "<i8")
        arrays[r["kind"]][r["chunk"] * _CHUNK : r["chunk"] * _CHUNK + len(part)] = part
    folder = scratch_folder(spark, "near")
    if "://" not in folder and not folder.startswith("file:"):
        folder = f"file://{folder}"
    back = sums.where(F.col("kind") == _RARE).groupBy("chunk").applyInPandas(_added_near, _BACK)
    back.repartition("part").write.partitionBy("part").parquet(folder)
    one, two, top_one, top_two, tables = arrays[3].tolist()
    after = State(
        arrays[0], arrays[1], arrays[2],
        discount=min(max(one / max(one + 2 * two, 1), 0.1), 0.95),
        top_discount=min(max(top_one / max(top_one + 2 * top_two, 1), 0.1), 0.95),
        all_tables=tables, distinct=known.distinct, seed=seed,
    )
    return after, folder


_PARTIAL = "bucket int, sums binary, homes binary"
_SCORES = "_key long, n_tokens long, n_known long, base_score double, score double"
#: Bytes of: portions, rows in use of each, those rows; their tokens, rare words known, base score of rare words, and score in units of ``_UNIT`` below zero.
_SUMMED = (*_USED, 5, 5, 8, 6)
_UNIT = 2.0**-20


def _dealt(columns: list[np.ndarray], buckets: int) -> dict[int, list[np.ndarray]]:
    """Portions, their numbers of rows and columns of their rows, dealt to the portions' buckets."""
    portion, many = columns[0], columns[1].astype(np.int64)
    bucket = (portion % np.uint64(buckets)).astype(np.int64)
    by_row = np.repeat(bucket, many)
    order, rows = np.argsort(bucket, kind="stable"), np.argsort(by_row, kind="stable")
    found = np.unique(bucket)
    cuts = [np.searchsorted(b[o], np.append(found, buckets)) for b, o in ((bucket, order), (by_row, rows))]
    return {
        int(k): [c[o[at[i] : at[i + 1]]] for c, o, at in zip(columns, (order, order) + (rows,) * (len(columns) - 2), cuts[:1] * 2 + cuts[1:] * (len(columns) - 2), strict=True)]
        for i, k in enumerate(found)
    }


def _scores(batches: Iterator[pa.RecordBatch], known: Known, state: State, buckets: int, near: str, near_buckets: int) -> Iterator[pa.RecordBatch]:
    """Sums over a part of the model for the texts it has tokens of, packed by buckets of portions."""
    for row in _rows(batches):
        part = Part(row, known, near, near_buckets)
        total = np.zeros(len(part.counts))
        customers = part.customers(state)
        for draw in range(SAMPLES if len(part.counts) else 0):
            tables = part.seated(state, 1 + draw)
            below = part.word_tables(tables, state)
            base = np.where(part.word_counts > 0, state.parent(below), state.unseen())[part.word]
            room = CONCENTRATION + state.discount * part.tables(state)
            total += (np.maximum(part.counts - state.discount * tables, 0) + room * base) / (CONCENTRATION + customers)
        log_p = np.log10(total / SAMPLES)
        rare = np.where(part.often, 0.0, known.base(part.word_counts))
        seen = (part.word_counts > 0) & ~part.often
        cell = np.repeat(np.arange(len(part.counts), dtype=np.int32), _unpack(row["cell"], 5).astype(np.int64))
        rows = _unpack(row["rows"], 5).astype(np.int32)
        texts = _unpack_all(row["texts"], *_USED)
        own = lambda value: np.bincount(rows, weights=value[cell], minlength=len(texts[2]))  # noqa: B023, E731
        columns = [*texts, np.bincount(rows, minlength=len(texts[2])), own(seen[part.word]), own(rare[part.word]), own(log_p)]
        columns[5] = columns[5].view(np.uint64)
        columns[6] = np.rint(np.maximum(-columns[6], 0) / _UNIT).astype(np.uint64)
        sums = _dealt(columns, buckets)
        homes = _dealt(_unpack_all(row["homes"], *_HOMES), buckets)
        filled = sorted(sums.keys() | homes.keys())
        yield arrow(
            _PARTIAL,
            {
                "bucket": filled,
                "sums": [_pack_all(*zip(sums[k], _SUMMED, strict=True)) if k in sums else None for k in filled],
                "homes": [_pack_all(*zip(homes[k], _HOMES, strict=True)) if k in homes else None for k in filled],
            },
        )


def _whole(frame: pd.DataFrame) -> pd.DataFrame:
    """The texts of a bucket of portions, with their sums over all parts."""
    homes = [_unpack_all(h, *_HOMES) for h in frame["homes"] if h is not None]
    sums = [_unpack_all(s, *_SUMMED) for s in frame["sums"] if s is not None]
    portion, size, keys, n, often, base = (np.concatenate([h[k] for h in homes] or [np.zeros(0, np.uint64)]) for k in range(6))
    begin = np.cumsum(size) - size
    order = np.argsort(portion)
    own, many, local, counted, rare, rare_base, score = (np.concatenate([s[k] for s in sums]) for k in range(7))
    at = np.minimum(np.searchsorted(portion[order], own), max(len(order) - 1, 0))
    if len(own) and (not len(order) or (portion[order[at]] != own).any()):
        raise RuntimeError("texts were read again in another order; write the documents to a table first")
    place = (np.repeat(begin[order[at]], many.astype(np.int64)) + local).astype(np.int64)
    add = lambda values: np.bincount(place, weights=values, minlength=len(keys))
    if (add(counted) != n).any():
        raise RuntimeError("texts were read again in another order; write the documents to a table first")
    return pd.DataFrame(
        {
            "_key": keys.view(np.int64),
            "n_tokens": n.astype(np.int64),
            "n_known": often.astype(np.int64) + np.rint(add(rare)).astype(np.int64),
            "base_score": base.view("<f8") + add(rare_base.view("<f8")),
            "score": -_UNIT * add(score),
        }
    )


_COUNTS = "bucket int, words binary, counts binary"


def _count_words(batches: Iterator[pa.RecordBatch], buckets: int) -> Iterator[pa.RecordBatch]:
    """Word counts of a task's texts, packed by buckets of words."""
    words, counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)

    def packed() -> pa.RecordBatch:
        bucket = (words % np.uint64(buckets)).astype(np.int64)
        own = [np.flatnonzero(bucket == k) for k in range(buckets)]
        filled = [k for k in range(buckets) if len(own[k])]
        return arrow(
            _COUNTS,
            {"bucket": filled, "words": [_pack(words[own[k]], 8) for k in filled], "counts": [_pack(counts[own[k]], 6) for k in filled]},
        )

    for batch in portions(batches, "_text", _PORTION):
        new, many = np.unique(tokens(*utf8(batch.column("_text")))[0], return_counts=True)
        words, where = np.unique(np.concatenate([words, new]), return_inverse=True)
        counts = np.bincount(where, weights=np.concatenate([counts, many]), minlength=len(words)).astype(np.int64)
        if len(words) > 1_000_000:  # the task's memory; what is sent on is added up again
            yield packed()
            words, counts = words[:0], counts[:0]
    yield packed()


_FOUND = "word long, n long, total long, distinct long"


def _add_words(frame: pd.DataFrame) -> pd.DataFrame:
    """A bucket's words of more than one occurrence, and in a row of its own how many words and tokens it has."""
    words, where = np.unique(np.concatenate([_unpack(w, 8) for w in frame["words"]]), return_inverse=True)
    counts = np.bincount(where, weights=np.concatenate([_unpack(c, 6) for c in frame["counts"]]), minlength=len(words)).astype(np.int64)
    more = counts > 1
    found = pd.DataFrame({"word": words[more].view(np.int64), "n": counts[more], "total": 0, "distinct": 0})
    return pd.concat([found, pd.DataFrame({"word": [0], "n": [0], "total": [int(counts.sum())], "distinct": [len(words)]})])


def vocabulary(texts: DataFrame) -> Known:
    """Counts over all training texts. A word that is a ``FREQUENT``-th of all tokens or more is frequent, so no more than that are."""
    buckets = max(8, int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions")))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _count_words(batches, buckets)

    train = texts.where("_train").select("_text")
    counts = materialise(train.mapInArrow(count, _COUNTS).groupBy("bucket").applyInPandas(_add_words, _FOUND))
    totals = counts.agg(F.sum("total").alias("total"), F.sum("distinct").alias("distinct")).first()
    total = int(totals["total"] or 0)
    top = counts.where(F.col("n") >= max(2, -(-total // FREQUENT))).select("word", "n").toArrow()
    words = top.column("word").to_numpy().view(np.uint64)
    order = np.argsort(words)
    return Known(words[order], top.column("n").to_numpy()[order].astype(np.int64), total, int(totals["distinct"] or 0))


def score_texts(docs: DataFrame, seed: int = 0) -> DataFrame:
    """Scores of every row under the model and under the smoothed word counts.

    Restaurants: one for each context word, one for beginnings of texts; all
    have the same parent. Every distinct word and pair of the training texts counts. Words
    are told apart by 64-bit hashes. A seating is sampled part by part; after
    each round the parts learn each other's tables.

    Defined cases: a missing text is empty and has one token, the end; without
    training texts every token is unseen. Repeated rows come back as often as
    they are given; a missing identifier hashes as an empty one. An empty table
    gives no rows. Other columns aren't read.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    remainder = fold(FOLDS)
    texts = docs.select(
        F.col("doc_id").cast(kind).alias("doc_id"),
        whole_text().alias("_text"),
        (remainder == HELD_OUT).alias("held_out"),
        (remainder != HELD_OUT).alias("_train"),
    ).withColumn("_key", F.xxhash64("doc_id", "_text"))
    known = vocabulary(texts)
    parts = max(4, -(-known.total // PART_TOKENS))
    context = docs.sparkSession.sparkContext
    words = context.broadcast(vars(known))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _packed(batches, Known(**words.value), parts)

    packed = texts.select("_key", "_train", "_text").mapInArrow(pack, _PACKED)
    cells = materialise(packed.groupBy("part").applyInPandas(_cells, _CELLS))
    near_buckets = max(8, parts // 4)
    state, near = _next_state(cells, known, None, seed, None, near_buckets)
    for turn in range(ROUNDS):
        state, near = _next_state(cells, known, state, seed + turn + 1, near, near_buckets)
    last = context.broadcast(vars(state))

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _scores(batches, Known(**words.value), State(**last.value), parts, near, near_buckets)

    sums = cells.mapInArrow(finish, _PARTIAL).groupBy("bucket").applyInPandas(_whole, _SCORES)
    # one row of sums for every row of the table; rows that repeat identifier and text share a key
    ids = texts.select("_key", "doc_id", "held_out").distinct()
    return ids.join(sums, "_key").select(
        "doc_id",
        "held_out",
        "n_tokens",
        "n_known",
        F.lit(known.total).cast("long").alias("train_tokens"),
        "base_score",
        "score",
    )
