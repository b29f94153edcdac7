"""Exact duplicates and SimHash groups."""

import hashlib
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash

pytest.importorskip("tradelanes.llm")

from tests.llm.conftest import MESSY  # noqa: E402
from tradelanes.llm import components, exact_dedup, simhash  # noqa: E402


def normal(text):
    return re.sub(r"[\x20\x09-\x0D]+", " ", text or "")


def test_exact_messy(messy):
    groups = defaultdict(list)
    for row in MESSY:
        groups[normal(row[1])].append(row[0])
    want = Counter()
    for ids in groups.values():
        known = [i for i in ids if i is not None]
        keep = min(known) if known else None
        kept = False
        for i in ids:
            now = i == keep and not kept
            kept |= now
            want[(i, keep, len(ids), now)] += 1
    got = Counter(tuple(r)[:4] for r in exact_dedup.exact_dedup(messy).collect())
    assert got == want


@pytest.mark.parametrize("run_rows, bits", [(1 << 20, 4), (40, 2), (10, 1)])
def test_runs_merge_into_one_row_a_text(spark, run_rows, bits):
    rng = np.random.default_rng(bits)
    # a third of all rows is one text, and a third has no identifier
    rows = [(None if i % 3 == 1 else i, "hot" if i % 3 == 0 else f"text {rng.integers(0, 60)}") for i in rng.permutation(600).tolist()]
    members = exact_dedup.digests(spark.createDataFrame(rows, "doc_id long, text string")).selectExpr("*", "1L AS _rows")
    got = exact_dedup.merged_runs(members, run_rows, bits)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" in plan and "HashAggregate" not in plan
    want = defaultdict(list)
    for doc_id, text in rows:
        want[hashlib.sha256(text.encode()).hexdigest()].append(doc_id)
    assert {r["text_sha256"]: (r["keep_id"], r["group_size"]) for r in got.collect()} == {
        key: (min((i for i in ids if i is not None), default=None), len(ids)) for key, ids in want.items()
    }
    assert got.count() == len(want)


def test_rows_repeated_very_often(spark):
    frame = spark.range(25_000).selectExpr("CAST(NULL AS long) AS doc_id", "'' AS text").union(
        spark.range(2001).selectExpr("5L AS doc_id", "'' AS text")
    )
    got = exact_dedup.exact_dedup(frame).groupBy("doc_id", "keep_id", "group_size", "kept").count().collect()
    assert {tuple(r) for r in got} == {(None, 5, 27_001, False, 25_000), (5, 5, 27_001, False, 2000), (5, 5, 27_001, True, 1)}


def test_exact_stage_with_columns_that_have_no_order(spark):
    docs = spark.sql("SELECT 1L AS doc_id, 'a' AS text, map('k', v) AS tags FROM VALUES (2), (1) AS t(v)")
    assert [tuple(r) for r in exact_dedup.keep_first(docs).collect()] == [(1, "a", {"k": 1})]


def test_exact_stage_keeps_columns_and_one_row_each(messy):
    kept = exact_dedup.keep_first(messy)
    assert kept.columns == messy.columns
    rows = kept.collect()
    texts = [normal(r["text"]) for r in rows]
    assert len(texts) == len(set(texts)) == len({normal(r[1]) for r in MESSY})
    assert {r["doc_id"] for r in rows if r["text"] and "quick" in r["text"]} == {1}


def test_empty(empty):
    assert exact_dedup.exact_dedup(empty).count() == 0
    assert exact_dedup.keep_first(empty).count() == 0
    assert simhash.simhash_groups(empty).count() == 0
    assert simhash.keep_one(empty).count() == 0


def brute_print(text):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if w]
    runs = [" ".join(words[i : i + 3]) for i in range(max(len(words) - 2, 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(r.encode(), 42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_groups(rows):
    return Counter((d, fingerprint, least) for d, fingerprint, least, _ in brute_components(rows))


def brute_components(rows):
    """Identifier, fingerprint, smallest reachable identifier and component of every row."""
    prints = [brute_print(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 3:
                parent[root(i)] = root(j)
    least = defaultdict(list)
    for i, (doc_id, _) in enumerate(rows):
        if doc_id is not None:
            least[root(i)].append(doc_id)
    return [(d, f"{prints[i]:016x}", min(least[root(i)], default=None), root(i)) for i, (d, _) in enumerate(rows)]


def test_simhash_against_all_pairs(documents, messy):
    for docs in (documents, messy):
        rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
        assert Counter(tuple(r) for r in simhash.simhash_groups(docs).collect()) == brute_groups(rows)


def test_simhash_stage(messy):
    found = {(least, component) for _, _, least, component in brute_components([(r[0], r[1]) for r in MESSY])}
    kept = simhash.keep_one(messy)
    assert kept.columns == messy.columns
    # two unlinked texts share identifier 9, and each component keeps one row
    assert Counter(r["doc_id"] for r in kept.collect()) == Counter(least for least, _ in found)


def test_simhash_stage_keeps_unlinked_rows_without_or_with_equal_identifiers(spark):
    rng = np.random.default_rng(5)
    texts = [" ".join(map(str, rng.integers(0, 1 << 30, 40))) for _ in range(6)]
    rows = [(None, texts[0]), (None, texts[0]), (None, texts[1]), (None, texts[2]), (4, texts[3]), (4, texts[4]), (6, texts[5])]
    assert len({c for _, _, c in brute_groups([(i, t) for i, t in enumerate(texts)])}) == len(texts)
    kept = simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(r["text"] for r in kept.collect()) == sorted(texts)


@pytest.mark.parametrize("budget", [0, 1, 3])
def test_trie_pairs_against_all_pairs(budget):
    rng = np.random.default_rng(budget)
    base = rng.integers(0, 1 << 63, 40, dtype=np.uint64)
    flips = np.array([np.bitwise_or.reduce(np.uint64(1) << rng.integers(0, 64, 2, dtype=np.uint64)) for _ in range(300)])
    v = np.unique(np.concatenate([base, base[rng.integers(0, 40, 300)] ^ flips]))
    got = simhash.trie_pairs(v, np.array([0]), *[np.array([k]) for k in (0, len(v), 0, len(v))], budget=budget)
    want = {(i, j) for i in range(len(v)) for j in range(i + 1, len(v)) if int(v[i] ^ v[j]).bit_count() <= budget}
    assert {(min(a, b), max(a, b)) for a, b in got.T.tolist()} == want


def test_large_groups_are_split_without_loss(spark, monkeypatch):
    rng = np.random.default_rng(1)
    # all values share their first block, so one group has them all; near values sit on both sides of the splits
    head = np.uint64(0x1234) << np.uint64(48)
    base = rng.integers(0, 1 << 48, 150, dtype=np.uint64)
    v = np.concatenate([base, base ^ (np.uint64(1) << rng.integers(0, 48, 150, dtype=np.uint64)), base ^ np.uint64(0b10101)])
    v = np.unique(v | head)
    monkeypatch.setattr(simhash, "GROUP_ROWS", 20)
    frame = spark.createDataFrame([(int(x.view(np.int64)),) for x in v], "_fp long")
    found = [(np.int64(a).view(np.uint64), np.int64(b).view(np.uint64)) for a, b in simhash.near_links(frame).collect()]
    assert all(int(a ^ b).bit_count() > 0 for a, b in found)
    where = {int(x): i for i, x in enumerate(v)}
    got = simhash.spanning(len(v), np.array([[where[int(a)] for a, _ in found], [where[int(b)] for _, b in found]]))
    pairs = np.array([(i, j) for i in range(len(v)) for j in range(i) if int(v[i] ^ v[j]).bit_count() <= 3]).T
    assert np.array_equal(got, simhash.spanning(len(v), pairs))


def test_components(spark):
    chain = [(i, i + 1) for i in range(0, 60)] + [(100 + i, 100) for i in range(1, 30)] + [(-5, -9)]
    frame = spark.createDataFrame([(b, a) if i % 2 else (a, b) for i, (a, b) in enumerate(chain)], "a long, b long")
    got = {r["node"]: r["label"] for r in components.components(frame).collect()}
    want = {i: 0 for i in range(61)} | {100 + i: 100 for i in range(30)} | {-5: -9, -9: -9}
    assert got == want
