"""Document quality from a linear-chain conditional random field over lines."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tradelanes.llm.common import arrow, fold, portions, span_hashes, sums, utf8, whole_text, word_spans
from tradelanes.llm.labelled import FOLDS, platt, sample, sigmoid

#: Documents of each label that are fitted on, and the bytes and lines of the largest of them.
PER_CLASS = 800
MOST_BYTES = 40_000
_ROUNDS = 80
#: Lines whose features are held at a time, and lines of a long text that follow one another step by step.
LINES = 1 << 16
_STRETCH = 1 << 11

_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_LOWER = np.zeros(256, bool)
_LOWER[97:123] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_PLAIN = np.zeros(256, bool)  # marks of ordinary prose
_PLAIN[[ord(c) for c in ".,;:'\"()-?"]] = True
_MARK = np.zeros(256, bool)
_MARK[33:127] = True
_MARK &= ~(_UPPER | _LOWER | _DIGIT | _PLAIN)


def lines_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every line, and the lines before each text. An empty text is one empty line."""
    breaks = np.flatnonzero(data == 10)
    text = np.searchsorted(offsets, breaks, side="right") - 1
    starts = np.concatenate([offsets[:-1], breaks + 1])
    owner = np.concatenate([np.arange(len(offsets) - 1), text])
    order = np.lexsort((starts, owner))
    starts, owner = starts[order], owner[order]
    first = np.searchsorted(owner, np.arange(len(offsets)))
    ends = np.empty_like(starts)
    ends[:-1] = starts[1:] - 1
    ends[first[1:] - 1] = offsets[1:]
    return starts, np.maximum(ends, starts), first


def repeats(hashes: np.ndarray) -> np.ndarray:
    """Hashes that occur more than once, in order."""
    ordered = np.sort(hashes)
    return np.unique(ordered[1:][ordered[1:] == ordered[:-1]])


def _among(hashes: np.ndarray, found: np.ndarray) -> np.ndarray:
    if not len(found):
        return np.zeros(len(hashes), bool)
    return found[np.minimum(np.searchsorted(found, hashes), len(found) - 1)] == hashes


def own_features(
    data: np.ndarray, offsets: np.ndarray, starts: np.ndarray, ends: np.ndarray, repeated: np.ndarray, last: np.uint64 | None = None
) -> tuple[np.ndarray, np.uint64 | None]:
    """Features of lines without their neighbours', and the hash of the last word; ``last`` is that of the word before."""
    length = (ends - starts).astype(np.float64)
    before = np.zeros(len(data), np.uint8)
    before[1:] = data[:-1]
    accented = (before == 0xC3) & (data >= 0x80) & (data <= 0x9E)  # capital letters with accents
    per = length + 1
    upper = sums(_UPPER[data] | accented, starts, ends)
    lower = sums(_LOWER[data] | ((before == 0xC3) & (data >= 0x9F)), starts, ends)
    marks = sums(_MARK[data], starts, ends)
    w_start, w_end, w_first = word_spans(data, offsets)
    lo, hi = np.searchsorted(w_start, starts), np.searchsorted(w_start, ends)
    words = hi - lo
    mark_end = _MARK[data[w_end - 1]] if len(w_end) else np.zeros(0, bool)
    lone_mark = (w_end - w_start == 1) & mark_end
    hashes = span_hashes(data, w_start, w_end)
    same = np.zeros(len(hashes), bool)
    same[1:] = hashes[1:] == hashes[:-1]
    same[w_first[:-1][w_first[:-1] < len(hashes)]] = False  # a text's first word follows none
    if len(hashes):
        if last is not None:
            same[0] = hashes[0] == last
        last = hashes[-1]
    safe = np.maximum(words, 1)
    own = np.stack(
        [
            upper / np.maximum(upper + lower, 1),
            marks / per,
            sums(_DIGIT[data], starts, ends) / per,
            sums(mark_end, lo, hi) / safe,
            sums(lone_mark, lo, hi) / safe,
            sums(same, lo, hi) / safe,
            np.minimum(length / safe, 30) / 10,
            np.log1p(length) / 5,
            np.log1p(words) / 3,
            (length == 0).astype(float),
            repeated.astype(float),
        ],
        axis=1,
    )
    return own, last


def line_features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features of all lines, own ones and their neighbours', the lines' lengths, and the lines before each text."""
    starts, ends, first = lines_of(data, offsets)
    text = np.repeat(np.arange(len(first) - 1), np.diff(first))
    whole = span_hashes(data, starts, ends) + text.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    own, _ = own_features(data, offsets, starts, ends, _among(whole, repeats(whole)))
    here = np.arange(len(starts))
    is_first, is_last = np.zeros(len(starts), bool), np.zeros(len(starts), bool)
    is_first[first[:-1]] = True
    is_last[first[1:] - 1] = True
    previous = np.where(is_first[:, None], 0, own[np.maximum(here - 1, 0)])
    following = np.where(is_last[:, None], 0, own[np.minimum(here + 1, len(here) - 1)])
    edges = np.stack([is_first, is_last, np.ones(len(here))], axis=1)
    return np.concatenate([own, previous, following, edges], axis=1), (ends - starts).astype(np.float64), first


def _stretches(data: np.ndarray, most: int) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """Bounds of a text's lines, line k from bound k to bound k + 1 less one, and stretches of ``most`` lines at most."""
    bounds = np.concatenate([[0], np.flatnonzero(data == 10) + 1, [len(data) + 1]])
    lines = len(bounds) - 1
    return bounds, [(k, min(k + most, lines)) for k in range(0, lines, most)]


def long_text(data: np.ndarray, weights: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Scores of the lines of one text for the state good, and their lengths, ``most`` lines at a time."""
    bounds, stretches = _stretches(data, most)
    cut = lambda a, b: (data[bounds[a] : bounds[b] - 1], bounds[a:b] - bounds[a], bounds[a + 1 : b + 1] - 1 - bounds[a])
    hashes = np.concatenate([span_hashes(*cut(a, b)) for a, b in stretches])
    found = repeats(hashes)
    score = np.zeros(len(hashes), np.float32)
    size, last = (len(weights) - 3) // 3, None
    for a, b in stretches:
        piece, starts, ends = cut(a, b)
        own, last = own_features(piece, np.array([0, len(piece)]), starts, ends, _among(hashes[a:b], found), last)
        score[a:b] += own @ weights[:size] + weights[-1]
        after = (own @ weights[size : 2 * size])[: len(score) - a - 1]
        score[a + 1 : b + 1] += after
        score[max(a - 1, 0) : b - 1] += (own @ weights[2 * size : 3 * size])[0 if a else 1 :]
    score[0] += weights[-3]
    score[-1] += weights[-2]
    return score, np.diff(bounds).astype(np.int32) - 1


@dataclass
class Field:
    """Weights of the line features for the state good, scores of a state after a state, and the calibration."""

    weights: np.ndarray
    moves: np.ndarray
    slope: float = 1.0
    offset: float = 0.0

    def marginals(self, features: np.ndarray, first: np.ndarray, pairs: bool = False):
        """Probability that each line is good, by the forward-backward recursion.

        All texts advance together, line by line; the longest ones go on alone.
        With ``pairs`` also the expected number of each move and the log of the
        partition function.
        """
        score = np.clip(features @ self.weights, -30, 30)
        local = np.stack([np.ones_like(score), np.exp(score)], axis=1)
        move = np.exp(self.moves)
        count = np.diff(first)
        order = np.argsort(-count, kind="stable")
        begin, count = first[:-1][order], count[order]
        steps = int(count[0]) if len(count) else 0
        active = np.searchsorted(-count, -np.arange(steps), side="left")
        ahead = np.empty((len(score), 2))
        log_z, state = 0.0, None
        for t in range(steps):
            at = begin[: active[t]] + t
            state = local[at] if t == 0 else (state[: active[t]] @ move) * local[at]
            total = state.sum(axis=1, keepdims=True)
            state = state / total
            log_z += float(np.log(total).sum())
            ahead[at] = state
        back = np.ones((len(score), 2))
        moved = np.zeros((2, 2))
        for t in range(steps - 2, -1, -1):
            at = begin[: active[t + 1]] + t
            after = local[at + 1] * back[at + 1]
            value = after @ move.T
            if pairs:
                joint = ahead[at][:, :, None] * move[None] * after[:, None, :]
                moved += (joint / joint.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
            back[at] = value / value.sum(axis=1, keepdims=True)
        both = ahead * back
        good = both[:, 1] / both.sum(axis=1)
        return (good, moved, log_z) if pairs else good

    def mean_of_chain(self, score: np.ndarray, length: np.ndarray) -> float:
        """Mean probability of good over one text's lines, weighing by length, without a step for each line.

        The text is cut into stretches of ``_STRETCH`` lines, which advance
        together: once to find what each does to any message that enters it,
        then, with the messages carried from stretch to stretch, forward and
        backward as in ``marginals``.
        """
        move = np.exp(self.moves)
        begin = np.arange(0, len(score), _STRETCH)
        steps, rest = min(_STRETCH, len(score)), len(score) - begin[-1]

        def local(at: np.ndarray) -> np.ndarray:
            return np.stack([np.ones(len(at)), np.exp(np.clip(score[at].astype(np.float64), -30, 30))], axis=1)

        through = np.tile(np.eye(2), (len(begin), 1, 1))
        for t in range(steps):
            live = len(begin) - (t >= rest)
            here = (through[:live] @ move) * local(begin[:live] + t)[:, None, :]
            through[:live] = here / here.sum(axis=(1, 2), keepdims=True)
            if t == 0:
                through[0] = local(begin[:1])  # nothing comes before the first line
        enter, leave = np.empty((len(begin), 2)), np.ones((len(begin), 2))
        enter[0] = 0.5
        for k in range(1, len(begin)):
            enter[k] = through[0, 0] if k == 1 else enter[k - 1] @ through[k - 1]
            enter[k] /= enter[k].sum()
            leave[-k - 1] = through[-k] @ leave[-k]
            leave[-k - 1] /= leave[-k - 1].sum()
        ahead = np.empty(len(score), np.float32)
        state = enter
        for t in range(steps):
            at = begin[: len(begin) - (t >= rest)] + t
            here = (state[: len(at)] @ move) * local(at)
            if t == 0:
                here[0] = local(begin[:1])[0]
            state = here / here.sum(axis=1, keepdims=True)
            ahead[at] = state[:, 1] / state[:, 0]
        total, back = 0.0, leave
        for t in range(steps - 1, -1, -1):
            at = begin[: len(begin) - (t >= rest)] + t
            odds = ahead[at].astype(np.float64) * back[: len(at), 1]
            total += float((odds / (odds + back[: len(at), 0]) * (length[at] + 1)).sum())
            before = (local(at) * back[: len(at)]) @ move.T
            back[: len(at)] = before / before.sum(axis=1, keepdims=True)
        return total / float(length.sum(dtype=np.float64) + len(length))

    def raw(self, features: np.ndarray, length: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Log odds of the mean probability of good, lines weighing by their length."""
        good = self.marginals(features, first)
        weight = length + 1
        mean = np.add.reduceat(good * weight, first[:-1]) / np.add.reduceat(weight, first[:-1])
        return self.odds(mean)

    @staticmethod
    def odds(mean):
        mean = np.clip(mean, 1e-6, 1 - 1e-6)
        return np.log(mean / (1 - mean))

    def score_texts(self, data: np.ndarray, offsets: np.ndarray, most: int) -> np.ndarray:
        """Scores of texts, ``most`` lines at a time; a text of more is cut itself."""
        breaks = np.searchsorted(np.flatnonzero(data == 10), offsets)
        lines = breaks + np.arange(len(offsets))
        out, start = np.empty(len(offsets) - 1), 0
        while start < len(out):
            end = max(int(np.searchsorted(lines, lines[start] + most, side="right")) - 1, start + 1)
            own = data[offsets[start] : offsets[end]]
            if lines[end] - lines[start] > most:
                mean = self.mean_of_chain(*long_text(own, self.weights, most))
                out[start] = sigmoid(self.slope * self.odds(mean) + self.offset)
            else:
                out[start:end] = self.score(*line_features(own, offsets[start : end + 1] - offsets[start]))
            start = end
        return out

    def score(self, features: np.ndarray, length: np.ndarray, first: np.ndarray) -> np.ndarray:
        return sigmoid(self.slope * self.raw(features, length, first) + self.offset)


def fit_field(features: np.ndarray, length: np.ndarray, first: np.ndarray, label: np.ndarray, rounds: int = _ROUNDS) -> Field:
    """Maximum likelihood with a ridge, by adaptive gradient steps; every line has its document's label."""
    lines = np.repeat(label, np.diff(first)).astype(float)
    begins = np.zeros(len(lines), bool)
    begins[first[:-1]] = True
    after = np.flatnonzero(~begins)
    seen = np.zeros((2, 2))
    np.add.at(seen, (lines[after - 1].astype(int), lines[after].astype(int)), 1)
    field = Field(np.zeros(features.shape[1]), np.zeros((2, 2)))
    size = max(len(lines), 1)
    square_w, square_m = np.full(len(field.weights), 1e-8), np.full((2, 2), 1e-8)
    for step in range(rounds):
        good, moved, _ = field.marginals(features, first, pairs=True)
        grad_w = features.T @ (lines - good) / size - 1e-4 * field.weights
        grad_m = (seen - moved) / size - 1e-3 * field.moves
        square_w, square_m = square_w * 0.9 + 0.1 * grad_w**2, square_m * 0.9 + 0.1 * grad_m**2
        rate = 0.3 / (1 + 0.05 * step)
        field.weights = field.weights + rate * grad_w / np.sqrt(square_w)
        field.moves = np.clip(field.moves + rate * grad_m / np.sqrt(square_m), -3, 3)
    field.slope, field.offset = platt(field.raw(features, length, first), label)
    field.slope = max(field.slope, 1e-3)
    return field


def fit(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> Field:
    """The field fitted on up to ``per_class`` labelled documents of each kind.

    Tasks turn the sample into line features; those, bounded by
    ``PER_CLASS * MOST_BYTES``, are all that reaches the driver. Without any
    labelled document every score is 0.5.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in portions(batches, "_text", LINES):  # a byte may be a line
            features, length, first = line_features(*utf8(batch.column("_text")))
            cells = [features[a:b].astype("<f4").tobytes() for a, b in zip(first[:-1], first[1:], strict=True)]
            sizes = [length[a:b].astype("<f4").tobytes() for a, b in zip(first[:-1], first[1:], strict=True)]
            yield arrow("_label int, _cells binary, _sizes binary", {"_label": batch.column("_label"), "_cells": cells, "_sizes": sizes})

    rows = sample(docs, labels, "quality", per_class, MOST_BYTES).mapInArrow(work, "_label int, _cells binary, _sizes binary").collect()
    if not rows:
        return Field(np.zeros(36), np.zeros((2, 2)), 0.0, 0.0)
    length = [np.frombuffer(r["_sizes"], "<f4") for r in rows]
    first = np.concatenate([[0], np.cumsum([len(x) for x in length])])
    length = np.concatenate(length).astype(float)
    features = np.frombuffer(b"".join(r["_cells"] for r in rows), "<f4").reshape(len(length), -1).astype(float)
    return fit_field(features, length, first, np.array([r["_label"] for r in rows]))


def score_quality(docs: DataFrame, field: Field) -> DataFrame:
    """``doc_id``, ``held_out``, ``score`` and ``predicted`` of every row.

    Defined cases: a missing text is empty; an empty text is one empty line
    and gets that line's score; a missing identifier hashes as an empty one.
    Repeated rows come back as often as they are given, an empty table gives
    no rows, and other columns aren't read.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in portions(batches, "_text", 4 << 20):
            score = field.score_texts(*utf8(batch.column("_text")), LINES)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(score)], names=["doc_id", "held_out", "score"])

    scored = docs.select("doc_id", (fold(FOLDS) == 0).alias("held_out"), whole_text().alias("_text")).mapInArrow(
        work, f"doc_id {kind}, held_out boolean, score double"
    )
    return scored.withColumn("predicted", (F.col("score") >= 0.3).cast("int"))
