"""Spelling variants against all pairs of words."""

import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

pytest.importorskip("tradelanes.llm")

from tests.llm.conftest import MESSY  # noqa: E402
from tradelanes.llm import spelling  # noqa: E402


def brute_words(rows):
    counts = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 7 and n >= 2}


def brute(counts):
    """Near words by the patterns two words share when a letter of either is left out or blotted out."""
    keys = defaultdict(set)
    for w in counts:
        for i in range(len(w)):
            keys[("=", w[:i], w[i + 1 :])].add(w)  # same length, place i blotted out
            keys[("-", w[:i] + w[i + 1 :])].add(w)
        keys[("-", w)].add(w)
    near = defaultdict(set)
    for key, group in keys.items():
        for a in group:
            for b in group:
                if a < b and (key[0] == "=" or len(a) != len(b)):
                    near[a].add(b)
                    near[b].add(a)
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda x: (-counts[x], x))
        if counts[best] >= 10 * counts[w]:
            form[w] = best
    out = set()
    for w, n in counts.items():
        root = w
        while root in form:
            root = form[root]
        out.add((w, form.get(w), root, n, len(near.get(w, ())), counts[form[w]] if w in form else None))
    return out


def got(df):
    rows = [tuple(r) for r in df.select("word", "form", "root", "n", "n_near", "form_n").collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def made_up(n=3000, seed=2):
    rng = np.random.default_rng(seed)
    letters = list("abeinorstéÉß×zq")
    base = ["".join(rng.choice(letters, rng.integers(6, 12))) for _ in range(150)]
    out = []
    for _ in range(n):
        w = list(base[int(rng.zipf(1.5)) % len(base)])
        for _ in range(rng.integers(0, 3)):
            at, what = int(rng.integers(0, len(w))), rng.integers(0, 3)
            if what == 0:
                w[at] = str(rng.choice(letters))
            elif what == 1:
                w.insert(at, str(rng.choice(letters)))
            elif len(w) > 1:
                del w[at]
        out.append("".join(w))
    return out


def test_against_all_pairs(spark, messy, documents, monkeypatch):
    tokens = made_up()
    rows = [(i % 50 or None, " ".join(tokens[i :: 200]).upper() if i % 3 else "1".join(tokens[i :: 200])) for i in range(200)]
    rows += [(7, "colour " * 30 + "coloured color-colours"), (8, "colours " * 2 + "ābcdefgh abcdefgh_abcdefgh"), (9, None), (9, "")]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    want = brute(brute_words(rows))
    assert sum(f is not None for _, f, *_ in want) > 50
    assert got(spelling.spelling_groups(frame)) == want
    monkeypatch.setattr(spelling, "NODE_WORDS", 5)
    counted = spelling.words(frame)
    deep = spelling.near_words(counted, 5)
    near = {(w, k) for w, _, _, _, k, _ in want if k}
    assert {(r["word"], r["n_near"]) for r in deep.collect()} == near
    assert got(spelling.spelling_groups(messy)) == brute(brute_words([r[:2] for r in MESSY]))
    real = [tuple(r) for r in documents.select("doc_id", "text").collect()]
    assert got(spelling.spelling_groups(documents)) == brute(brute_words(real))


@pytest.mark.parametrize("depth", [2, 3, 5, 8, spelling.LEVELS])
def test_pairs_meet_once_at_any_depth(depth):
    words = sorted({w for w in made_up(1500, depth) if len(w) >= 7})
    import pyarrow as pa

    batch = pa.record_batch({"word": words, "n": [1] * len(words)})
    rows = [r for out in spelling._visits(depth)([batch]) for r in out.to_pylist()]
    names = {x: i for i, x in enumerate(sorted({r["_node"] for r in rows}))}
    p, q = spelling.near_rows(
        [r["word"] for r in rows], np.array([names[r["_node"]] for r in rows]), np.array([r["_home"] for r in rows])
    )
    pairs = Counter(tuple(sorted((rows[a]["word"], rows[b]["word"]))) for a, b in zip(p.tolist(), q.tolist(), strict=True))
    assert set(pairs.values()) <= {1}
    degree = Counter(w for pair in pairs for w in pair)
    assert degree == {w: k for w, _, _, _, k, _ in brute(dict.fromkeys(words, 1)) if k}


def test_one_edit_is_exact():
    a = ["abcdefg", "abcdefg", "abcdefg", "aaaaaaa", "abcdefg", "abcdefg"]
    b = ["abcdefgh", "xabcdefg", "abdcefgh", "aaaaaaaa", "abcxdefg", "abcdegfh"]
    letters = spelling._letters(a + b)
    assert spelling.one_edit(letters[:6], letters[6:], True).tolist() == [True, True, False, True, True, False]
    a, b = ["abcdefg", "abcdefg", "abcdefg"], ["abcdefg", "abcdefx", "abcdegf"]
    letters = spelling._letters(a + b)
    assert spelling.one_edit(letters[:3], letters[3:], False).tolist() == [False, True, False]


def test_roots_follow_long_chains(spark):
    chain = [(f"w{i:02d}", f"w{i + 1:02d}") for i in range(13)] + [("x", "y")]
    found = {r["word"]: r["root"] for r in spelling.roots(spark.createDataFrame(chain, "word string, form string")).collect()}
    assert found == {w: "w13" for w, _ in chain[:-1]} | {"x": "y"}


def test_empty(empty):
    assert spelling.spelling_groups(empty).collect() == []
