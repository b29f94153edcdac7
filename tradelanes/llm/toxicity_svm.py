"""Toxic sentences by a subsequence string kernel and a support vector machine on Nyström landmarks."""

from __future__ import annotations

import re
import sys
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain, combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tradelanes.llm.common import fold, portions, whole_text
from tradelanes.llm.labelled import FOLDS, platt, sample, sigmoid

#: Documents of each label that are fitted on, and the bytes of the largest of them.
PER_CLASS = 1000
MOST_BYTES = 20_000
LANDMARKS = 256
#: What a gap inside a subsequence of three letters costs, per character.
DECAY = 0.5
#: Letters a unit is read by at most; longer ones are cut into overlapping units.
_WIDTH, _STRIDE = 16, 8
_CLASSES = 60
_REMEMBERED = 1_000_000
_ROUNDS = 5

#: Letters written apart ("a b c", "a.b.c") are one unit.
_APART = re.compile(r"(?<!\w)[^\W\d_](?:[\s._*\-]{1,3}[^\W\d_](?![^\W\d_])){2,}")


def classes(points: np.ndarray) -> np.ndarray:
    """A letter's class, 1 to 59; 0 for whatever is no letter and only widens a gap."""
    out = np.zeros(len(points), dtype=np.int64)
    plain = (points >= 97) & (points <= 122)
    out[plain] = points[plain] - 96
    other = (points >= 0xAA) & (points != 0xD7) & (points != 0xF7) & ~((points >= 0x2000) & (points <= 0x2BFF))
    out[other] = 27 + points[other] % 33
    return out


def grid(units: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Letter classes of units, one row for each window of ``_WIDTH`` characters, and the unit of every row."""
    points = np.frombuffer("".join(units).encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.int64)
    letters = classes(points)
    sizes = np.array([len(u) for u in units], dtype=np.int64)
    begins = np.cumsum(sizes) - sizes
    windows = np.maximum(1, -(-(sizes - _WIDTH) // _STRIDE) + 1)
    unit = np.repeat(np.arange(len(units)), windows)
    step = np.arange(len(unit)) - np.repeat(np.cumsum(windows) - windows, windows)
    at = begins[unit] + step * _STRIDE
    column = np.arange(_WIDTH)
    place = at[:, None] + column
    inside = place < (begins + sizes)[unit][:, None]
    cells = np.where(inside, letters[np.minimum(place, max(len(letters) - 1, 0))] if len(letters) else 0, 0)
    return cells, unit


def _triples(width: int) -> tuple[np.ndarray, np.ndarray]:
    places = np.array(list(combinations(range(width), 3)), dtype=np.int64).reshape(-1, 3)
    return places, DECAY ** (places[:, 2] - places[:, 0] - 2.0)


_PLACES = {width: _triples(width) for width in (6, 10, _WIDTH)}


def expanded(cells: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Every subsequence of three letters of each row, as a number, and its weight; rows of length 1 by weight.

    The dot product of two rows is the string kernel: common subsequences,
    each with the decay of its gaps on both sides.
    """
    used = int((cells > 0).any(axis=0).nonzero()[0].max(initial=0)) + 1
    places, weight = next(_PLACES[w] for w in sorted(_PLACES) if w >= used)
    a, b, c = (cells[:, places[:, k]] for k in range(3))
    codes = (a * _CLASSES + b) * _CLASSES + c
    weights = np.where((a > 0) & (b > 0) & (c > 0), weight, 0.0)
    norm = np.sqrt((weights**2).sum(axis=1, keepdims=True))
    return codes, weights / np.where(norm > 0, norm, 1)


@dataclass
class Machine:
    """The decision function, its landmarks summed into one weight for each subsequence."""

    weights: np.ndarray
    bias: float
    slope: float = 1.0
    offset: float = 0.0

    def units(self, units: list[str]) -> np.ndarray:
        """Decision value of each unit, the largest of its windows.

        Landmarks are summed up already, so a window costs one look-up for
        each of its subsequences, and its length in the kernel space follows
        from its letters before, between and after.
        """
        out = np.full(len(units), -np.inf)
        for start in range(0, len(units), 8192):
            part = units[start : start + 8192]
            cells, unit = grid(part)
            value = np.zeros(len(unit))
            last = np.where((cells > 0).any(axis=1), _WIDTH - (cells[:, ::-1] > 0).argmax(axis=1), 0)
            for width in range(3, _WIDTH + 1):
                rows = np.flatnonzero(last == width)
                if len(rows):
                    value[rows] = self._windows(np.ascontiguousarray(cells[rows, :width].T))
            np.maximum.at(out[start : start + len(part)], unit, value + self.bias)
        return out

    def _windows(self, letters: np.ndarray) -> np.ndarray:
        width, many = letters.shape
        total, square = np.zeros(many), np.zeros(many)
        present = (letters > 0).astype(np.float64)
        seen = present.cumsum(axis=0)
        for i in range(width - 2):
            for j in range(i + 1, width - 1):
                pair = (letters[i] * _CLASSES + letters[j]) * _CLASSES
                for k in range(j + 1, width):
                    total += DECAY ** (k - i - 2) * self.weights[pair + letters[k]]
            for k in range(i + 2, width):
                square += DECAY ** (2 * (k - i - 2)) * present[i] * present[k] * (seen[k - 1] - seen[i])
        return total / np.sqrt(np.where(square > 0, square, 1.0))

    def documents(self, texts: list[str], known: dict[str, float]) -> tuple[np.ndarray, list[int]]:
        """For each text the largest decision value of any sentence, and the number of toxic sentences.

        A sentence is as toxic as its most toxic unit: a word, or letters
        written apart. ``known`` remembers units over calls.
        """
        split = [units_of(t) for t in texts]
        new = [w for w in dict.fromkeys(chain.from_iterable(split)) if w not in known]
        if len(known) + len(new) > _REMEMBERED:
            known.clear()
            new = list(dict.fromkeys(chain.from_iterable(split)))
        known.update(zip(new, self.units(new).tolist(), strict=True))
        raw, sentences = np.full(len(texts), self.bias), []
        for i, words in enumerate(split):
            value = np.fromiter(map(known.__getitem__, words), dtype=float, count=len(words))
            raw[i] = value.max(initial=self.bias if not words else -np.inf)
            hits = np.flatnonzero(value > 0)
            if len(hits):
                ends = np.fromiter((w[-1] in ".!?" for w in words), dtype=np.int64, count=len(words)).cumsum()
                hits = np.unique(np.concatenate([[0], ends[:-1]])[hits])
            sentences.append(len(hits))
        return raw, sentences


def units_of(text: str) -> list[str]:
    """Words in small letters, then the letters written apart."""
    low = text.lower()
    words = low.split()
    apart = [" ".join(m.group().split()).replace(" ", "-") for m in _APART.finditer(low)] if len(words) > 2 else []
    return words + apart


def _dense(units: list[str]) -> np.ndarray:
    """Rows of the expanded kernel space, for a few units."""
    cells, unit = grid(units)
    codes, weights = expanded(cells)
    out = np.zeros((len(units), _CLASSES**3), dtype=np.float32)
    keep = np.flatnonzero(np.diff(unit, prepend=-1) > 0)  # the first window stands for a landmark
    np.add.at(out, (np.repeat(np.arange(len(units)), codes.shape[1]), codes[keep].ravel()), weights[keep].ravel())
    return out


def _compact(units: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Units in the expanded space, its unused coordinates left out: each coordinate's row, and the rows; row 0 is nothing."""
    cells, unit = grid(units)
    codes, weights = expanded(cells)
    keep = np.flatnonzero(np.diff(unit, prepend=-1) > 0)
    codes, weights = codes[keep], weights[keep]
    used = np.unique(codes[weights > 0])
    index = np.zeros(_CLASSES**3, dtype=np.int32)
    index[used] = np.arange(1, len(used) + 1)
    rows = np.zeros((len(used) + 1, len(units)), dtype=np.float32)
    real = weights > 0
    np.add.at(rows, (index[codes[real]], np.nonzero(real)[0]), weights[real])
    return index, rows


def _kernel(units: list[str], landmarks: np.ndarray | tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Kernel of units with landmarks, dense or compact; a unit of several windows has its largest values."""
    cells, unit = grid(units)
    if isinstance(landmarks, tuple):
        index, by_code = landmarks
    else:
        index, by_code = np.arange(_CLASSES**3), np.ascontiguousarray(landmarks.T)
    rows = np.zeros((len(unit), by_code.shape[1]), dtype=np.float32)
    for at, codes, weights in _by_width(cells):
        for start in range(0, len(at), 32):
            part = slice(start, start + 32)
            rows[at[part]] = np.einsum("uc,ucl->ul", weights[part].astype(np.float32), by_code[index[codes[part]]], optimize=True)
    out = np.zeros((len(units), by_code.shape[1]))
    np.maximum.at(out, unit, rows)
    return out


def _by_width(cells: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Rows of similar length together, expanded no wider than they are, a few hundred at a time."""
    last = np.where((cells > 0).any(axis=1), _WIDTH - (cells[:, ::-1] > 0).argmax(axis=1), 0)
    low = 0
    for width in sorted(_PLACES):
        rows = np.flatnonzero((last > low) & (last <= width))
        low = width
        for start in range(0, len(rows), 512):
            part = rows[start : start + 512]
            yield part, *expanded(cells[part, :width])


def _spread(units: list[str], many: int) -> list[str]:
    """Up to ``many`` units that are unlike each other: each next one is the least like those taken."""
    units = list(dict.fromkeys(units))[:1500]
    if not units:
        return []
    taken, near = [0], np.zeros(len(units))
    while len(taken) < min(many, len(units)):
        near = np.maximum(near, _kernel(units, _compact([units[taken[-1]]]))[:, 0])
        pick = int(np.argmin(near))
        if near[pick] > 0.98:
            break
        taken.append(pick)
    return [units[i] for i in taken]


def _svm(x: np.ndarray, y: np.ndarray, cost: np.ndarray, ridge: float = 0.1) -> np.ndarray:
    """Squared-hinge support vector machine by Newton steps; the last weight is the bias."""
    x = np.concatenate([x, np.ones((len(x), 1))], axis=1)
    w = np.zeros(x.shape[1])
    pull = np.full(len(w), ridge)
    pull[-1] = 1e-3
    for _ in range(30):
        inside = y * (x @ w) < 1
        part, c = x[inside], cost[inside]
        hessian = (part * c[:, None]).T @ part + np.diag(pull)
        new = np.linalg.solve(hessian, (part * c[:, None]).T @ y[inside])
        if np.abs(new - w).max() < 1e-6:
            break
        w = new
    return w


def _variants(unit: str) -> list[str]:
    """A unit with marks between its letters, and with one letter put in."""
    letters = [c for c in unit if c.isalpha()]
    half = len(letters) // 2
    return ["".join(letters), ".".join(letters), "".join(letters[:half] + ["x"] + letters[half:])]


def fit_machine(
    texts: list[str], labels: list[int], landmarks: int = LANDMARKS, rounds: int = _ROUNDS, toxic_share: float = 0.1
) -> Machine:
    """Trained on sentences whose labels come from their documents.

    All sentences of clean documents are clean. Of a toxic document the
    sentence that holds the most suspicious unit is toxic; at first that is
    the unit with the four letters that toxic documents favour most, beyond
    chance, then the one of such units that the machine itself ranks highest. Landmarks are taken anew each round
    from both sides, unlike each other.
    """
    same: dict[str, str] = {}  # one string for each unit, however many documents hold it
    bags = [list(dict.fromkeys(same.setdefault(u, u) for u in units_of(t))) for t in texts]
    y = np.array(labels)
    n_toxic, n_clean = max(int((y == 1).sum()), 1), max(int((y == 0).sum()), 1)
    grams: dict[str, tuple[str, ...]] = {}
    for unit in same:
        plain = "".join(c for c in unit if c.isalpha())
        grams[unit] = tuple({sys.intern(plain[i : i + 4]) for i in range(len(plain) - 3)})
    counts = (Counter(), Counter())
    for bag, label in zip(bags, labels, strict=True):
        counts[label].update({g for u in bag for g in grams[u]})
    share = n_toxic / (n_toxic + n_clean)
    sure = np.log(max(len(counts[1]), 1)) + 3  # beyond what chance gives the best of so many
    odds = {}
    for gram, k in counts[1].items():
        c = counts[0][gram]
        gain = k * np.log(k / ((k + c) * share)) + (c * np.log(c / ((k + c) * (1 - share))) if c else 0.0)
        if gain > sure and k / n_toxic > c / n_clean:
            odds[gram] = np.log((k + 0.5) / (n_toxic + 1)) - np.log((c + 0.5) / (n_clean + 1)) + 0.1 * np.log(k)
    evidence = {u: max((odds.get(g, -9.0) for g in gs), default=-9.0) for u, gs in grams.items()}
    value = evidence
    del grams
    machine, floor = Machine(np.zeros(_CLASSES**3, np.float32), -1.0), 2.5
    cold: list[str] = []
    for turn in range(rounds):
        hot = []
        for bag, label in zip(bags, labels, strict=True):
            ranked = sorted(bag, key=lambda u: -value[u])
            if label == 1:
                hot += [u for u in ranked[:2] if value[u] > floor and evidence[u] > 1.0]
            else:
                cold += ranked[:3]
        often = Counter(hot)
        hot_units = [u for u, _ in often.most_common()]
        clean = set(cold)
        hot_units = [u for u in hot_units if u not in clean]
        if not hot_units or not cold:
            return machine
        rng = np.random.default_rng(turn)
        plain = sorted({u for bag, label in zip(bags, labels, strict=True) if label == 0 for u in bag})
        plain = [plain[i] for i in rng.permutation(len(plain))[:3000].tolist()]
        marks = _spread(hot_units, landmarks // 2) + _spread([u for u, _ in Counter(cold).most_common()] + plain, landmarks // 2)
        index, compact = _compact(marks)
        inner = compact.T @ compact + 1e-3 * np.eye(len(marks))
        size, turned = np.linalg.eigh(inner)
        root = turned @ np.diag(1 / np.sqrt(size)) @ turned.T
        bent = [v for u in hot_units[:300] for v in _variants(u)]
        units = hot_units + bent + list(clean) + plain
        sign = np.array([1.0] * (len(hot_units) + len(bent)) + [-1.0] * (len(clean) + len(plain)))
        cost = np.array([float(min(often[u], 20)) for u in hot_units] + [1.0] * len(bent) + [1.0] * (len(clean) + len(plain)))
        w = _svm(_kernel(units, (index, compact)) @ root, sign, cost)
        machine = Machine((compact @ (root @ w[:-1]))[index].astype(np.float32), float(w[-1]))
        every = list(same)
        value = dict(zip(every, machine.units(every).tolist(), strict=True))
        floor = 0.0
    raw = np.array([max((value[u] for u in bag), default=machine.bias) for bag in bags])
    machine.slope, machine.offset = platt(raw, y, toxic_share)
    machine.slope = max(machine.slope, 1e-3)
    return machine


def fit(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> Machine:
    """The machine fitted on up to ``per_class`` labelled documents of each kind, of ``MOST_BYTES`` at most.

    The sample, bounded by these parameters, is fitted on the driver. Without
    documents of both kinds every score is 0.5 or what the bias gives.
    """
    rows = sample(docs, labels, "toxic", per_class, MOST_BYTES).collect()
    rows = sorted((r["_text"], r["_label"]) for r in rows)
    return fit_machine([r[0] for r in rows], [r[1] for r in rows])


def score_toxicity(docs: DataFrame, machine: Machine, text_col: str = "text", keep: bool = False) -> DataFrame:
    """``doc_id``, ``held_out``, ``score``, ``predicted`` and the number of toxic sentences of every row.

    Defined cases: a missing or empty text has no units and gets the score of
    the bias alone; a missing identifier hashes as an empty one. Repeated rows
    come back as often as they are given, an empty table gives no rows, and
    other columns aren't read. With ``keep`` the rows themselves come back,
    those predicted toxic left out.
    """
    shared = docs.sparkSession.sparkContext.broadcast(vars(machine))  # 0.9 MB whatever it was fitted on

    def scored(texts: pa.Array, known: dict[str, float]) -> tuple[np.ndarray, list[int]]:
        own = Machine(**shared.value)
        raw, sentences = own.documents([t or "" for t in texts.to_pylist()], known)
        return sigmoid(own.slope * raw + own.offset), sentences

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, float] = {}
        for batch in portions(batches, "_text"):
            score, count = scored(batch.column("_text"), known)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("held_out"), pa.array(score, pa.float64()), pa.array(count, pa.int32())],
                names=["doc_id", "held_out", "score", "toxic_sentences"],
            )

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, float] = {}
        for batch in portions(batches, text_col):
            score, _ = scored(batch.column(text_col), known)
            yield batch.filter(pa.array(score < 0.5))

    if keep:
        return docs.mapInArrow(clean, docs.schema)
    kind = docs.schema["doc_id"].dataType.simpleString()
    return (
        docs.select("doc_id", (fold(FOLDS) == 0).alias("held_out"), whole_text(text_col).alias("_text"))
        .mapInArrow(work, f"doc_id {kind}, held_out boolean, score double, toxic_sentences int")
        .select("doc_id", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "toxic_sentences")
    )
