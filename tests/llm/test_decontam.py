"""Benchmark decontamination against a brute-force search of all windows."""

import random
import re

import numpy as np
import pytest

from lodestone.llm import decontam as D


def words(text):
    return [w.lower() for w in re.findall(r"[A-Za-z0-9\x80-￿]+", text or "")]


def infix(item, text):
    row = [0] * (len(text) + 1)
    for i, x in enumerate(item, 1):
        new = [i]
        for j, y in enumerate(text, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return min(row)


def edited(rng, text, n, vocab):
    w = text.split()
    for _ in range(n):
        k, kind = rng.randrange(len(w)), rng.random()
        if kind < 0.34:
            w[k] = rng.choice(vocab)
        elif kind < 0.67:
            w.insert(k, rng.choice(vocab))
        elif len(w) > 2:
            del w[k]
    return " ".join(w)


@pytest.mark.parametrize("seed", [1, 2])
def test_recall_and_exactness(spark, seed):
    rng = random.Random(seed)
    vocab = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 6))) for _ in range(500)]
    items = [(i, " ".join(rng.choices(vocab, k=rng.choice([1, 3, 8, 15, 30, 45, 60, 200])))) for i in range(40)]
    docs = []
    for d in range(200):
        i, text = rng.choice(items)
        n = int(rng.choice([0, 0.05, 0.12, 0.19, 0.3]) * len(text.split()))
        body = rng.choices(vocab, k=rng.randint(0, 60)) + edited(rng, text, n, vocab).split() * rng.choice([0, 1, 1, 2]) + rng.choices(vocab, k=rng.randint(0, 60))
        docs.append((d, rng.choice([" ", ", ", "\n"]).join(body).upper() if rng.random() < 0.2 else " ".join(body)))
    rows = D.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    got = {(r["doc_id"], r["item_id"]): r["edits"] for r in rows}
    want = {}
    for d, text in docs:
        w = words(text)
        for i, item in items:
            x = words(item)
            limit = D.edits_of(len(x), 0.8)
            if (n := infix(x, w)) <= limit:
                want[d, i] = n
    assert set(got) <= set(want)
    assert all(want[k] == v for k, v in got.items())
    assert len(got) >= 0.98 * len(want) > 100
    assert all(k in got for k, v in want.items() if v == 0)
    for r in rows:
        part = dict(docs)[r["doc_id"]].encode()[r["start"] : r["end"]].decode()
        assert infix(words(dict(items)[r["item_id"]]), words(part)) == r["edits"]


def test_edges(spark):
    benchmark = spark.createDataFrame([(1, None, 0), (2, "", 0), (3, "...", 0), (4, "alpha beta gamma delta epsilon zeta", 0), (5, "alpha beta gamma delta epsilon zeta", 0)], "item_id long, text string, doc_id int")
    long = "x " * 50000 + "Alpha, beta; gamma delta EPSILON zeta" + " y" * 50000
    docs = [(1, None), (2, ""), (3, long), (3, long), (None, "alpha beta gamma delta epsilon"), (7, "alpha beta")]
    rows = D.leaks(spark.createDataFrame(docs, "doc_id long, text string"), benchmark).collect()
    assert sorted((r["doc_id"] or 0, r["item_id"], r["edits"]) for r in rows) == [(0, 4, 1), (0, 5, 1), (3, 4, 0), (3, 4, 0), (3, 5, 0), (3, 5, 0)]
    assert D.leaks(spark.createDataFrame([], "doc_id long, text string"), benchmark).count() == 0
    assert D.leaks(spark.createDataFrame(docs, "doc_id long, text string"), benchmark.where("false")).count() == 0


def test_blocks_give_the_same(spark, monkeypatch):
    items = spark.createDataFrame([(i, " ".join(f"a{i}b{k}" for k in range(20))) for i in range(12)], "item_id long, text string")
    docs = spark.createDataFrame([(i, "zz " + " ".join(f"a{i}b{k}" for k in range(20))) for i in range(12)], "doc_id long, text string")
    whole = sorted(map(tuple, D.leaks(docs, items).collect()))
    monkeypatch.setattr(D, "BLOCK_BYTES", 400)
    assert sorted(map(tuple, D.leaks(docs, items).collect())) == whole and len(whole) == 12


def test_infix_distance():
    rng = np.random.default_rng(0)
    for _ in range(300):
        a, b = rng.integers(0, 4, rng.integers(1, 80)).astype(np.uint64), rng.integers(0, 4, rng.integers(0, 120)).astype(np.uint64)
        assert D.infix_distance(a, b)[0] == infix(a.tolist(), b.tolist())
