import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from shopflow.llm import ngram_join as J
from shopflow.llm.queries import QUERIES

from .conftest import MEDIUM

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text, k):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    if len(w) < k:
        return frozenset([tuple(w)] if w else [])
    return frozenset(tuple(w[i:i + k]) for i in range(len(w) - k + 1))


def brute(rows, k, num, den):
    """{id: (set size, least id of its component)} by counting all overlaps."""
    sets = {i: shingles(t, k) for i, t in rows}
    holders = defaultdict(list)
    for i, s in sets.items():
        for x in s:
            holders[x].append(i)
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x
    for i, s in sets.items():
        for j, o in Counter(j for x in s for j in holders[x]).items():
            if j < i and den * o >= num * (len(s) + len(sets[j]) - o):
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    return {i: (len(s), root(i)) for i, s in sets.items()}


def _got(df):
    return {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in df.collect()}


def test_query_equals_brute_force(spark):
    docs = spark.read.parquet(f"{MEDIUM}/documents.parquet").select("doc_id", "text")
    rows = [tuple(r) for r in docs.collect()]
    assert _got(QUERIES["op6_ngram_jaccard_join"](spark, MEDIUM)) == brute(rows, 4, 85, 100)


def _edited(rng, words, n):
    words = list(words)
    for _ in range(n):
        at = rng.randrange(len(words))
        words[at:at + rng.randrange(2)] = [f"e{rng.randrange(10**6)}"] * rng.randrange(2)
    return words


@pytest.mark.parametrize("k,num,den,block", [(4, 85, 100, 1_000_000), (5, 80, 100, 200), (2, 50, 100, 400),
                                             (3, 1, 1, 1000)])
def test_chains_groups_and_sizes(spark, k, num, den, block):
    """Short sets, chains of edits, hot groups and shared passages, all sizes."""
    rng = random.Random(k)
    passage = [f"p{i}" for i in range(60)]
    texts = []
    for n in (1, 2, 3, 4, 6, 9, 13, 17, 22, 25, 28, 40, 90, 200):
        base = [f"b{n}_{i}" for i in range(n)]
        for _ in range(12):
            texts.append(" ".join(_edited(rng, base, rng.randrange(1 + n // 8) if n > 7 else rng.randrange(2))))
            base = _edited(rng, base, 1 if n > 12 and rng.random() < 0.4 else 0)
    for i in range(40):
        texts.append(" ".join(passage + [f"q{i}_{j}" for j in range(rng.randrange(5, 40))]))
    texts += [" ".join(passage)] * 30 + ["", " \n", "One", "one", "ONE two"]
    rows = list(enumerate(texts))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = _got(J.ngram_components(docs, k, num, den, block_shingles=block))
    assert got == brute(rows, k, num, den)


def test_light_and_heavy_boundary():
    bound = J.Bound(85, 100)
    assert J.light_boundary({}, bound) == 0
    assert J.light_boundary({n: 1000 for n in range(1, 30)}, bound) >= 5
    for m in range(1, 60):
        for n in range(m, 60):
            o = bound.overlap(m, n)
            assert 100 * o >= 85 * (m + n - o) and 100 * (o - 1) < 85 * (m + n - o + 1)
            if o <= m:
                assert bound.least(n) <= m and n <= bound.most(m)


def test_scan_finds_components():
    rng = np.random.default_rng(4)
    sets = [np.unique(rng.integers(0, 40, size=30)).astype(np.uint64) for _ in range(60)]
    bound = J.Bound(60, 100)
    parent = list(range(60))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for i in range(60):
        for j in range(i):
            o = len(np.intersect1d(sets[i], sets[j]))
            if 100 * o >= 60 * (len(sets[i]) + len(sets[j]) - o):
                parent[root(i)] = root(j)
    want = {tuple(sorted(i for i in range(60) if root(i) == r)) for r in map(root, range(60))}
    links = J.scan_lists(np.arange(60), sets, bound)
    parent = list(range(60))
    for a, b in links:
        parent[root(a)] = root(b)
    assert {tuple(sorted(i for i in range(60) if root(i) == r)) for r in map(root, range(60))} == want


def test_odd_rows(odd_docs, no_docs):
    rows = J.ngram_components(odd_docs).collect()
    assert sorted((str(r["doc_id"]), r["n_shingles"], str(r["component_id"])) for r in rows) == sorted([
        ("None", 0, "None"), ("None", 0, "None"), ("5", 29997, "5"), ("5", 29997, "5"),
        ("5", 3, "5"), ("None", 29997, "5"), ("7", 0, "7"), ("7", 0, "7"), ("8", 1, "8"), ("9", 1, "9")])
    assert J.ngram_components(no_docs).collect() == []
