"""Frequent phrases and their scores against a plain count of all phrases."""

import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

pytest.importorskip("tradelanes.llm")

from tests.llm.conftest import MESSY  # noqa: E402
from tradelanes.llm import collocations  # noqa: E402


def brute_counts(rows):
    sizes, f = Counter(), Counter()
    for _, text, lang in rows:
        small = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", small):
            words = [w for w in re.split("[ \t]+", piece) if w]
            sizes[lang or "und"] += len(words)
            for k in range(1, 6):
                for i in range(len(words) - k + 1):
                    f[(lang or "und", *words[i : i + k])] += 1
    return sizes, f


def brute(rows, least, top):
    sizes, f = brute_counts(rows)
    often = {p: n for p, n in f.items() if n >= least}
    inside = {(q[0], *q[i : i + k]) for q, n in often.items() for k in range(2, len(q) - 1) for i in range(1, len(q) - k + 1) if n >= f[(q[0], *q[i : i + k])]}
    out = {}
    for p, a in often.items():
        if len(p) < 3 or p in inside:
            continue
        lang, words = p[0], p[1:]
        cuts = []
        for k in range(1, len(words)):
            left, right = f[(lang, *words[:k])], f[(lang, *words[k:])]
            cuts.append((1000 * a * sizes[lang] // (left * right), k, left, right))
        score, _, left, right = min(cuts)
        out.setdefault(lang, []).append((-score, -a, " ".join(words).encode(), left, right))
    return sorted(
        (lang, i, p.decode(), -a, left, right, sizes[lang], -s)
        for lang, found in out.items()
        for i, (s, a, p, left, right) in enumerate(sorted(found)[:top], 1)
    )


def got(df):
    return sorted(tuple(r) for r in df.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())


def made_up(seed=3, n=400):
    rng = np.random.default_rng(seed)
    vocabulary = ["a", "B", "É", "é", "don't", "x-y", "\x85", "\U0001f642", "q", "z"]
    rows = []
    for i in range(n):
        words = rng.choice(vocabulary, rng.integers(0, 30), p=[0.3, 0.2, 0.1, 0.1, 0.1, 0.05, 0.05, 0.04, 0.03, 0.03])
        joins = rng.choice([" ", "\t ", ". ", ",", "\n", "  "], len(words))
        rows.append((i, "".join(w + j for w, j in zip(words, joins, strict=True)), ["en", "de", None][i % 3]))
    # one language is rare in the sample and one not in it at all
    rows += [(None, "never sampled alike again and again", "xx")] * 20 + [(7, None, "fr"), (8, "", None), (9, " . ,", "es")]
    return rows


@pytest.mark.parametrize("sampled, lowered", [(8, 0.25), (1 << 20, 0.5), (1, 1.0)])
def test_against_a_plain_count(spark, monkeypatch, sampled, lowered):
    monkeypatch.setattr(collocations, "SAMPLED", sampled)
    monkeypatch.setattr(collocations, "LOWERED", lowered)
    rows = made_up()
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4)
    assert got(collocations.collocations(df, least=12, top=40)) == brute(rows, 12, 40)


def test_full_filters_count_more_and_never_less(spark, monkeypatch):
    monkeypatch.setattr(collocations, "FILTER_BITS", 8)
    rows = made_up(4, 200)
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert got(collocations.collocations(df, least=5, top=1000)) == brute(rows, 5, 1000)


def test_messy_and_real_texts(messy, documents):
    assert got(collocations.collocations(messy, least=2)) == brute([r[:3] for r in MESSY], 2, 2000)
    rows = [tuple(r) for r in documents.select("doc_id", "text", "lang").collect()]
    assert got(collocations.collocations(documents, least=8)) == brute(rows, 8, 2000)


def test_a_text_longer_than_a_portion_is_cut_without_loss(spark, monkeypatch):
    monkeypatch.setattr(collocations, "_PORTION", 50)
    rows = made_up(5, 60) + [(100, "one two three four five six " * 200, "en"), (101, "w" * 500 + " tail of a long word", "en"), (102, "a.b.c d. " * 90, "de")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert got(collocations.collocations(df, least=4, top=500)) == brute(rows, 4, 500)


def test_scores_beyond_64_bits(spark):
    big = 3 * 10**13
    phrases = spark.createDataFrame(
        [("en", 1, "a", big), ("en", 1, "b", big - 7), ("en", 2, "a b", big - 11)], "lang string, words int, phrase string, f long"
    )
    sizes = spark.createDataFrame([("en", 9 * big)], "lang string, n long")
    row = collocations.scored_phrases(phrases, sizes).first()
    assert row["score"] == 1000 * (big - 11) * 9 * big // (big * (big - 7))


def test_empty(empty):
    assert collocations.collocations(empty).collect() == []


def test_earlier_filters_see_what_the_last_lets_through(monkeypatch):
    rng = np.random.default_rng(3)
    texts = [" ".join(rng.choice(["a", "b", "c", "d", "e"], 40)) + ". one" for _ in range(50)]
    words = collocations.Words(pa.array([t.encode() for t in texts], pa.binary()), pa.array(["en"] * 50))
    filters = [rng.integers(0, 2**63, 64, dtype=np.uint64) for _ in range(3)]
    phrases = list(words.phrases())
    for known in (filters[:1], filters[:2], filters):
        got = list(collocations.wanted(words, known))
        for k, (length, whole, h) in enumerate(phrases):
            passed = np.full(len(h), length > 1 or len(known) == 1)
            if length > 1:
                both = [collocations.marked(bits, phrases[k - 1][2]) for bits in known]
                both = [had & np.append(had[1:], False) for had in both]
                passed = both[-1] & ~np.any([*both[:-1], np.zeros(len(h), bool)], axis=0)
            assert np.array_equal(got[k], h[whole & words.own & passed])
    asked, plain = [], collocations.marked
    monkeypatch.setattr(collocations, "marked", lambda bits, h: asked.append(len(h)) or plain(bits, h))
    assert not any(map(len, collocations.wanted(words, [*filters, np.zeros(64, dtype=np.uint64)])))
    assert sum(asked) == (collocations.LONGEST - 1) * len(words.starts)
