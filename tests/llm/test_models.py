"""Classifiers on held-out rows, the language model against plain counts, the mix."""

import math
import re
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import pytest

pytest.importorskip("tradelanes.llm")

from tests.llm.conftest import SMALL  # noqa: E402
from tradelanes.llm import hpy_lm, mixing, quality_crf, toxicity_svm  # noqa: E402
from tradelanes.llm.common import span_hashes, table, word_spans  # noqa: E402

MEDIUM = "/root/testdata/sf0.01"


def rate(scored, labels, column):
    marks = {r["doc_id"]: r[column] for r in labels.collect()}
    return [(r["held_out"], r["predicted"], marks[r["doc_id"]]) for r in scored.collect() if r["doc_id"] in marks]


def test_quality_on_held_out_rows(spark):
    docs, labels = table(spark, MEDIUM, "documents"), table(spark, MEDIUM, "labels")
    scored = quality_crf.score_quality(docs, quality_crf.fit(docs, labels))
    held = [(p, y) for h, p, y in rate(scored, labels, "quality") if h]
    assert sum(p == y for p, y in held) >= 0.97 * len(held)


def test_quality_marginals_against_enumeration():
    rng = np.random.default_rng(0)
    first = np.array([0, 1, 5, 9])
    features = rng.normal(size=(9, 3))
    field = quality_crf.Field(rng.normal(size=3), rng.normal(size=(2, 2)))
    good, moved, log_z = field.marginals(features, first, pairs=True)
    score = features @ field.weights
    want, moves, z_all = np.zeros(9), np.zeros((2, 2)), 0.0
    for a, b in zip(first[:-1], first[1:], strict=True):
        total, part, pairs = 0.0, np.zeros(b - a), np.zeros((2, 2))
        for code in range(1 << (b - a)):
            y = [code >> i & 1 for i in range(b - a)]
            w = math.exp(sum(score[a + i] * v for i, v in enumerate(y)) + sum(field.moves[p, q] for p, q in zip(y, y[1:], strict=False)))
            total += w
            part += w * np.array(y)
            for p, q in zip(y, y[1:], strict=False):
                pairs[p, q] += w
        want[a:b], moves, z_all = part / total, moves + pairs / total, z_all + math.log(total)
    assert np.allclose(good, want) and np.allclose(moved, moves) and math.isclose(log_z, z_all)


def test_lines_and_words():
    texts = ["a b\n\nc", "", "\n", "x\ty", "é"]
    raw = [t.encode() for t in texts]
    data = np.frombuffer(b"".join(raw), np.uint8)
    offsets = np.cumsum([0] + [len(r) for r in raw])
    starts, ends, first = quality_crf.lines_of(data, offsets)
    lines = [[bytes(data[s:e]) for s, e in zip(starts[a:b], ends[a:b], strict=True)] for a, b in zip(first[:-1], first[1:], strict=True)]
    assert lines == [r.split(b"\n") for r in raw]
    s, e, begin = word_spans(data, offsets)
    words = [[bytes(data[i:j]) for i, j in zip(s[a:b], e[a:b], strict=True)] for a, b in zip(begin[:-1], begin[1:], strict=True)]
    assert words == [r.split() for r in raw]
    own = span_hashes(data, s, e)
    assert len(set(own.tolist())) == len({w for x in words for w in x})


def test_toxicity_on_held_out_rows(spark):
    docs, labels = table(spark, MEDIUM, "documents"), table(spark, MEDIUM, "labels")
    rows = rate(toxicity_svm.score_toxicity(docs, toxicity_svm.fit(docs, labels)), labels, "toxic")
    for fold in (True, False):
        some = [(p, y) for h, p, y in rows if h == fold]
        assert sum(p > y for p, y in some) <= 0.02 * len(some)
        assert sum(p == y for p, y in some) >= 0.95 * len(some)


def _insulting(n, words):
    rng = np.random.default_rng(n)
    made = ["".join(rng.choice(list("thearonisu"), 5)) for _ in range(400)]
    out = []
    for i in range(n):
        text = list(rng.choice(made, 40))
        if i % 2:
            text[int(rng.integers(40))] = words[i // 2 % len(words)]
        out.append((" ".join(text) + ".", i % 2))
    return out


def test_toxicity_tolerates_gaps_and_insertions():
    rows = _insulting(300, ["blockhead", "nitwit"])
    machine = toxicity_svm.fit_machine([t for t, _ in rows], [y for _, y in rows])
    fine = "she walks along the river and reads. nothing more."
    raw, sentences = machine.documents(
        [fine, "what a blockhead.", "you b.l.o.c.k.h.e.a.d you", "so n i t w i t then", "a blockxhead here", "nitwiit", ""], {}
    )
    assert raw[0] < 0 and all(raw[1:6] > raw[0]) and all(raw[1:4] > 0)
    assert sentences[:2] == [0, 1]


def test_toxicity_kernel_against_definition():
    def plain(s, t):
        from itertools import combinations

        def expand(x):
            out = Counter()
            for i, j, k in combinations(range(len(x)), 3):
                out[x[i] + x[j] + x[k]] += toxicity_svm.DECAY ** (k - i - 2)
            return out

        a, b = expand(s), expand(t)
        norm = lambda x: math.sqrt(sum(toxicity_svm.DECAY ** (2 * (k - i - 2)) for i in range(len(x)) for j in range(i + 1, len(x)) for k in range(j + 1, len(x))))
        return sum(a[c] * b[c] for c in a) / (norm(s) * norm(t))

    units, marks = ["idiot", "idioot", "banana", "clown", "stupidity"], ["idiot", "bananas", "clowning"]
    dense = toxicity_svm._dense(marks)
    got = toxicity_svm._kernel(units, dense)
    assert np.allclose(got, [[plain(u, m) for m in marks] for u in units], atol=1e-5)
    machine = toxicity_svm.Machine(dense.T @ np.array([1.0, -0.5, 2.0], np.float32), -0.25)
    assert np.allclose(machine.units(units), got @ [1.0, -0.5, 2.0] - 0.25, atol=1e-5)


def test_classifiers_messy(messy, empty, labels):
    for fit, score in ((quality_crf.fit, quality_crf.score_quality), (toxicity_svm.fit, toxicity_svm.score_toxicity)):
        model = fit(messy, labels)
        got = score(messy, model).collect()
        assert len(got) == 12 and all(0 <= r["score"] <= 1 for r in got)
        for r in got:
            assert r["held_out"] == (zlib.crc32(("" if r["doc_id"] is None else str(r["doc_id"])).encode()) % 5 == 0)
        assert score(empty, fit(empty, labels.limit(0))).count() == 0
    assert toxicity_svm.score_toxicity(messy, toxicity_svm.fit(messy, labels), keep=True).columns == messy.columns


def test_language_model_counts(spark, documents, messy, empty):
    for docs in (documents, messy):
        rows = [(r["doc_id"], r["text"] or "") for r in docs.select("doc_id", "text").collect()]

        def tokens(text):
            low = re.sub("[A-Z]", lambda m: m[0].lower(), text)
            return re.findall(r"[^\x20\x09-\x0D]+", low) + [None]

        crc = lambda d: zlib.crc32(("" if d is None else str(d)).encode()) % 7
        counts = Counter(t for d, x in rows if crc(d) != 2 for t in tokens(x))
        total, distinct = sum(counts.values()), len(counts)
        want = sorted(
            ((d, crc(d) == 2, len(tokens(x)), sum(counts[t] > 0 for t in tokens(x)), total, round(sum(math.log10((counts[t] + 1) / (total + distinct + 1)) for t in tokens(x)), 4)) for d, x in rows),
            key=repr,
        )
        found = hpy_lm.score_texts(docs).collect()
        assert sorted(((*r[:5], round(r["base_score"], 4)) for r in found), key=repr) == want
        assert all(r["score"] < 0 for r in found)
    assert hpy_lm.score_texts(empty).count() == 0


def test_language_model_beats_counts_on_held_out_rows(spark):
    held = [r for r in hpy_lm.score_texts(table(spark, MEDIUM, "documents")).collect() if r["held_out"]]
    assert sum(r["score"] for r in held) > 0.9 * sum(r["base_score"] for r in held)


def _lined_text(rng, lines):
    words = [b"the", b"The", b"!!", "\u00c9t\u00e9".encode(), b"12", b"cat.", b"$x$", b""]
    return b"\n".join(b" ".join(words[k] for k in rng.integers(0, 8, rng.integers(0, 6))) for _ in range(lines))


def test_quality_of_texts_cut_by_lines(monkeypatch):
    """Texts cut into stretches of lines, with messages carried between them, score as whole ones do."""
    rng = np.random.default_rng(0)
    field = quality_crf.Field(rng.normal(size=36), rng.normal(size=(2, 2)), 1.3, -0.2)
    texts = [_lined_text(rng, n) for n in (1, 300, 3, 0, 1, 101, 2, 100)] + [b"", b"\n", b"\n\n\n"]
    data, offsets = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0] + [len(t) for t in texts])
    want = field.score(*quality_crf.line_features(data, offsets))
    for stretch in (1, 2, 50, 2048):
        monkeypatch.setattr(quality_crf, "_STRETCH", stretch)
        for most in (1, 3, 64, 10_000):
            assert np.abs(field.score_texts(data, offsets, most) - want).max() < 1e-5


def test_quality_does_not_depend_on_the_texts_beside():
    rng = np.random.default_rng(1)
    field = quality_crf.Field(rng.normal(size=36), rng.normal(size=(2, 2)))
    texts = [b"cat cat", b"cat", b"cat\ncat", b"cat"]
    data, offsets = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0] + [len(t) for t in texts])
    together = field.score(*quality_crf.line_features(data, offsets))
    alone = [field.score(*quality_crf.line_features(np.frombuffer(t, np.uint8), np.array([0, len(t)])))[0] for t in texts]
    assert np.allclose(together, alone, atol=1e-12)


def test_quality_of_millions_of_empty_lines():
    """A text of line breaks takes some fifty bytes of memory a line."""
    field = quality_crf.Field(np.full(36, 0.1), np.zeros((2, 2)))
    data = np.full(2_000_000, 10, np.uint8)
    tracemalloc.start()
    score = field.score_texts(data, np.array([0, len(data)]), quality_crf.LINES)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert 0 < score[0] < 1 and peak < 200 << 20


def test_language_model_refuses_mixed_reads():
    """A part made from another reading of the texts than the one that holds their keys isn't added up."""
    one = lambda *values: np.array(values, np.uint64)
    home = hpy_lm._pack_all(*zip([one(7), one(2), one(11, 12), one(1, 2), one(1, 1), np.zeros(2).view(np.uint64)], hpy_lm._HOMES, strict=True))

    def sums(portion, tokens):
        score = np.array([1.0, 2.0]) / hpy_lm._UNIT
        return hpy_lm._pack_all(
            *zip([one(portion), one(2), one(0, 1), one(*tokens), one(0, 1), np.zeros(2).view(np.uint64), score], hpy_lm._SUMMED, strict=True)
        )

    def whole(*parts):
        return hpy_lm._whole(pd.DataFrame({"homes": [home] + [None] * (len(parts) - 1), "sums": list(parts)}))

    found = whole(sums(7, (1, 1)), sums(7, (0, 1)))
    assert found["_key"].tolist() == [11, 12] and found["n_tokens"].tolist() == [1, 2]
    assert found["n_known"].tolist() == [1, 3] and found["score"].tolist() == [-2.0, -4.0]
    for parts in ([sums(7, (1, 1))], [sums(7, (1, 2)), sums(8, (1, 1))]):
        with pytest.raises(RuntimeError):
            whole(*parts)


def test_language_model_gives_each_context_its_own_restaurant(spark):
    """Words whose hashes differ in their high bits only have restaurants of their own, and sums over all parts."""
    known = hpy_lm.Known(np.zeros(0, np.uint64), np.zeros(0, np.int64), 1, 1)
    word = 0x123456789ABCDEF0
    alike = np.array([word, word ^ (1 << 50), word ^ 1, 5], np.uint64)
    assert len(set(known.contexts(alike, np.array([0, 4])).tolist())) == 4  # three words and the beginning

    texts = [f"w{i % 7} w{i % 11} w{i % 3} w{i % 50}" for i in range(200)]
    frame = spark.createDataFrame([(i, True, t) for i, t in enumerate(texts)], "_key long, _train boolean, _text string")
    packed = frame.mapInArrow(lambda batches: hpy_lm._packed(batches, known, 5), hpy_lm._PACKED)
    cells = hpy_lm.materialise(packed.groupBy("part").applyInPandas(hpy_lm._cells, hpy_lm._CELLS))
    state, near = hpy_lm._next_state(cells, known, None, 0, None, 3)
    want = Counter(w for t in texts for w in t.split())  # each of them comes before one token
    parts = [hpy_lm.Part(r, known, near, 3) for r in cells.collect()]
    assert len(parts) == 5
    found = {}
    for part in parts:
        for hashed, customers in zip(part.rare.tolist(), part.near[1].tolist(), strict=True):
            assert found.setdefault(hashed, customers) == customers
    assert sorted(found.values()) == sorted(want.values())
    assert state.customers[hpy_lm.FREQUENT] == len(texts)
    assert state.all_tables == sum(len(p.counts) for p in parts)


def test_language_model_is_a_distribution():
    """Over all known words and the unseen one, probabilities sum to 1 in every context."""
    rng = np.random.default_rng(1)
    counts = rng.integers(0, 6, size=(4, 30)) * (rng.random((4, 30)) < 0.5)
    counts[0, counts.sum(axis=0) == 0] = 1
    flat = counts.ravel()
    pull = np.full(len(flat), 0.3)
    tables = hpy_lm.seat(flat, pull, 0.6, rng, 3).reshape(counts.shape)
    assert ((tables >= (counts > 0)) & (tables <= counts)).all()
    by_context, by_word = tables.sum(axis=1), tables.sum(axis=0)
    state = hpy_lm.State(by_context, counts.sum(axis=1), by_word, 0.6, 0.5, int(tables.sum()), 30)
    words = state.parent(by_word)
    assert math.isclose(words.sum() + state.unseen(), 1, rel_tol=1e-9)
    for c in range(4):
        room = hpy_lm.CONCENTRATION + 0.6 * by_context[c]
        p = (counts[c] - 0.6 * tables[c] + room * words) / (hpy_lm.CONCENTRATION + counts[c].sum())
        assert math.isclose(p.sum() + room * state.unseen() / (hpy_lm.CONCENTRATION + counts[c].sum()), 1, rel_tol=1e-9)


def _table_weights(n, discount, pull):
    """How likely each number of tables is among all seatings of n customers, one customer after the other."""
    likely = np.zeros(n + 1)
    likely[1] = 1.0
    for seated in range(1, n):
        grown = likely * np.maximum(seated - discount * np.arange(n + 1), 0)
        grown[1:] += pull * likely[:-1]
        likely = grown / grown.sum()
    return likely


def test_seating_against_the_exact_distribution():
    """Tables of a cell follow the weights of all seatings of its customers, with the sweeps that are used."""
    for n, discount, pull in ((2, 0.75, 0.01), (5, 0.4, 0.8), (32, 0.75, 3.0), (33, 0.75, 3.0), (60, 0.2, 8.0)):
        likely = _table_weights(n, discount, pull)
        got = hpy_lm.seat(np.full(40_000, n), np.full(40_000, pull), discount, np.random.default_rng(0), hpy_lm.SWEEPS)
        assert np.abs(np.bincount(got, minlength=n + 1) / 40_000 - likely).max() < 0.02


def test_tables_of_large_cells():
    """Cells of few and of many customers have as many tables as they should, within a twentieth."""
    for n in (5, 20, 100, 500, 2_000, 20_000):
        for pull in (0.05, 1.0, 10.0, 100.0):
            for discount in (0.4, 0.75):
                mean = float(_table_weights(min(n, 5_000), discount, pull) @ np.arange(min(n, 5_000) + 1))
                got = hpy_lm.seat(np.full(2_000, n), np.full(2_000, pull), discount, np.random.default_rng(1), hpy_lm.SWEEPS)
                assert got.min() >= 1 and got.max() <= n
                assert abs(got.mean() / mean - 1) < 0.05


def test_seating_of_mixed_cells():
    """Cells of all sizes at once, none and one customer among them; huge and tiny weights of new tables."""
    counts = np.array([0, 1, 2, 33, 0, 1_000_000, 5, 40, 2, 700])
    rng = np.random.default_rng(2)
    for pull in (0.0, 1e-12, 1.0, 1e12):
        got = hpy_lm.seat(counts, np.full(len(counts), pull), 0.75, rng, hpy_lm.SWEEPS)
        assert (got[counts > 0] >= 1).all() and (got <= counts).all()
        if pull < 1e-9:
            assert (got == np.minimum(counts, 1)).all()
    assert len(hpy_lm.seat(np.zeros(0, np.int64), np.zeros(0), 0.5, rng, 3)) == 0


def test_mix_messy(messy, empty, documents):
    got = mixing.mix(messy, block=16).collect()
    assert len(got) == 12
    goal = {}
    for r in got:
        assert 0 <= r["taken"] <= 3 * r["size"]
        goal.setdefault(r["source"], [r["target"], 0])[1] += r["taken"]
    assert all(abs(t - n) <= 0.5 for t, n in goal.values())
    assert mixing.mix(empty).count() == 0 and mixing.mixed_documents(empty).count() == 0
    assert sorted(mixing.mix(documents).collect()) == sorted(mixing.mix(documents.repartition(5)).collect())
    mixed = mixing.mixed_documents(messy)
    assert mixed.columns == messy.columns and mixed.count() > 0


def test_schedule_is_even(spark):
    rows = [("a", 500, 0.0, 5000), ("b", 300, 0.0, 3000), (None, 100, 0.0, 1000), ("c", 10, 0.0, 7), ("d", 9, 0.0, 0)]
    targets = spark.createDataFrame(rows, "source string, source_size long, target double, goal long")
    got = sorted((r["position"], r["source"], r["slot"]) for r in mixing.slot_schedule(targets, 10).collect())
    assert Counter(s for _, s, _ in got) == {"a": 500, "b": 300, None: 100, "c": 1}
    assert len({(s, k) for _, s, k in got}) == len(got) == 901
    for n in (100, 300, 600):  # every beginning of the schedule is close to the shares
        part = Counter(s for _, s, _ in got[:n])
        assert abs(part["a"] - n * 500 / 901) < 8 and abs(part["b"] - n * 300 / 901) < 8


def test_shares_fill_up(spark):
    sizes = spark.createDataFrame([("a", 10, 1), ("b", 1000, 1), ("c", 1000, 1), (None, 990, 1)], "source string, size long, _rows long")
    got = {r["source"]: r["target"] for r in mixing.source_targets(sizes).collect()}
    assert got["a"] == 30  # 5/13 of 3000 is more than three times its size
    rest = 2970 / 8
    assert math.isclose(got["b"], rest * 2) and math.isclose(got["c"], rest) and math.isclose(got[None], rest * 5)


def test_pipeline(spark):
    import corpus_pipeline

    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "exact_dedup", "simhash_near_dedup", "mixing", "byte_bpe"]
    docs = table(spark, SMALL, "documents")
    steps = [docs]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        steps.append(stage(spark, steps[-1], SMALL).cache())
        assert steps[-1].columns == docs.columns
    counts = [s.count() for s in steps]
    assert counts[0] >= counts[1] > counts[2] >= counts[3] > 0
    assert corpus_pipeline.run(spark, SMALL).count() == counts[4]


def test_span_hashes_do_not_depend_on_place():
    rng = np.random.default_rng(4)
    data = rng.integers(97, 100, 5 << 20).astype(np.uint8)
    starts = np.sort(rng.integers(0, len(data) - 4000, 3000))
    starts[-1] = len(data) - 10
    ends = starts + rng.integers(0, 9, 3000)
    ends[:5] += 3000
    got = span_hashes(data, starts, ends)
    seen = {}
    for h, s, e in zip(got.tolist(), starts.tolist(), ends.tolist(), strict=True):
        assert seen.setdefault(bytes(data[s:e]), h) == h
    assert len(set(seen.values())) == len(seen)
