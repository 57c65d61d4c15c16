"""The n-gram Jaccard join against a brute-force version."""

import itertools
import random
import re

import numpy as np
import pytest

from lodestone.llm import jaccard_join as J


def shingles(text, words):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not w:
        return set()
    return {tuple(w[i : i + words]) for i in range(len(w) - words + 1)} if len(w) >= words else {tuple(w)}


def brute(docs, words, threshold):
    sets = [(d, shingles(t, words)) for d, t in docs]
    parent = list(range(len(docs)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for (i, (_, a)), (j, (_, b)) in itertools.combinations(enumerate(sets), 2):
        if a and b and 100 * len(a & b) >= threshold * len(a | b):
            parent[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(sets):
        least[root(i)] = min(d, least.get(root(i), d))
    return sorted((d, len(s), least[root(i)]) for i, (d, s) in enumerate(sets))


def run(spark, docs, words, threshold):
    rows = J.jaccard_components(spark.createDataFrame(docs, "doc_id long, text string"), words, threshold).collect()
    return sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in rows)


@pytest.mark.parametrize("words, threshold, seed", [(3, 90, 1), (5, 80, 2), (3, 90, 3)])
def test_against_brute_force(spark, words, threshold, seed):
    """Families of copies edited a little or a lot, short and long, some of which share edits: chains, near misses and exact hits of the threshold."""
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(400)]
    docs = []
    for family in range(14):
        base = rng.choices(vocab, k=rng.choice([1, 2, 4, 9, 11, 12, 14, 22, 40, 90, 200]))
        text = list(base)
        for _ in range(rng.randint(1, 14)):
            text = list(base if rng.random() < 0.5 else text)  # from the base, or a chain of edits
            for _ in range(rng.randint(0, max(1, len(text) // 20))):
                k, kind = rng.randrange(len(text)), rng.random()
                if kind < 0.5:
                    text[k] = rng.choice(vocab)
                elif kind < 0.8:
                    text.insert(k, rng.choice(vocab))
                elif len(text) > 2:
                    del text[k]
            docs.append((len(docs) * 7 % 1009, " ".join(text).upper() if rng.random() < 0.2 else "\t".join(text)))
    docs += [(5000, None), (5001, ""), (5002, " \n "), (5003, "w1 w2"), (5004, "W1  w2")]
    assert run(spark, docs, words, threshold) == brute(docs, words, threshold)


def test_hot_family(spark):
    """A family of copies that are too far apart to link, beside a base with many near copies."""
    rng = random.Random(5)
    base = [f"w{i}" for i in range(120)]
    docs = [(0, " ".join(base))]
    for d in range(1, 150):
        text = list(base)
        for k in rng.sample(range(120), rng.choice([0, 1, 2, 4, 5])):
            text[k] = f"x{rng.randrange(60)}"
        docs.append((d, " ".join(text)))
    assert run(spark, docs, 3, 90) == brute(docs, 3, 90)


def test_edges(spark):
    long = " ".join(f"v{i}" for i in range(30000))
    docs = [(1, "a b c d", 5), (1, "a b c d", 5), (None, "a b c d", 6), (2, long, 7), (3, long + " z", 8), (4, "é É", 9)]
    rows = J.jaccard_components(spark.createDataFrame(docs, "doc_id long, text string, component_id int"), 3, 90).collect()
    assert sorted(((r["doc_id"] or 0, r["n_shingles"], r["component_id"]) for r in rows), key=str) == sorted([(1, 2, 1), (1, 2, 1), (0, 2, 1), (2, 29998, 2), (3, 29999, 2), (4, 1, 4)], key=str)
    assert J.jaccard_components(spark.createDataFrame([], "doc_id long, text string")).count() == 0


@pytest.mark.parametrize("threshold", [80, 90])
def test_plans_reach_the_bound(threshold):
    for hi in range(1, 3000):
        exact, near, spare = J.plan(hi, threshold, 10**6)
        assert exact + 2 * near > (100 - threshold) * 2 * hi // (100 + threshold) + spare
    for n in range(1, 2000):
        for m in range(n, n * 100 // threshold + 1):
            assert set(J.bands(n, threshold)) & set(J.bands(m, threshold)), (n, m)


def test_parities_bound_the_difference():
    rng = np.random.default_rng(0)
    for _ in range(300):
        pool = rng.integers(0, 2**63, 600, dtype=np.uint64)
        a, b = (np.unique(rng.choice(pool, rng.integers(1, 400))) for _ in range(2))
        assert J.apart(J.parity(a), J.parity(b)) <= len(np.setxor1d(a, b))
    assert J.apart(J.parity(a), J.parity(a)) == 0
