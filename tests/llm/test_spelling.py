"""Spelling variants against all pairs of words, and the query against its SQL."""

import itertools
import random
import re
import zlib
from collections import Counter

import duckdb
import pytest

from lodestone.llm import _words as W
from lodestone.llm import queries, spelling
from lodestone.llm._shared import prepare


def _near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def _plain(counts):
    near = {w: [] for w in counts}
    for a, b in itertools.combinations(counts, 2):
        if abs(len(a) - len(b)) < 2 and _near(a, b):
            near[a].append(b)
            near[b].append(a)
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda o: (-counts[o], o), default=None)
        form[w] = best if best is not None and counts[best] >= 5 * counts[w] else None

    def root(w):
        while form[w] is not None:
            w = form[w]
        return w

    return sorted((w, form[w] or "", root(w), n, len(near[w]), counts.get(form[w]) or 0) for w, n in counts.items())


def _rows(df):
    return sorted((r["word"], r["form"] or "", r["root"], r["n"], r["n_near"], r["form_n"] or 0) for r in df.collect())


def _vocabulary(rng, n):
    words = {"".join(rng.choices("aabÿ×", k=rng.randint(1, 7))): rng.choice([1, 2, 5, 10, 60, 400, 9000]) for _ in range(n)}
    for w in list(words)[: n // 3]:
        i = rng.randrange(len(w))
        words[w[:i] + rng.choice(["", "a", w[i] * 2]) + w[i + 1 :] or "a"] = rng.choice([1, 3])
    return words


@pytest.mark.parametrize("seed", range(3))
def test_all_pairs(spark, seed):
    prepare(spark)
    counts = _vocabulary(random.Random(seed), 250)
    df = spark.createDataFrame(list(counts.items()), "word string, n long").repartition(3)
    assert _rows(spelling.variants(df)) == _plain(counts)


def test_equal_hashes(spark, monkeypatch):
    """Keys that hardly tell strings apart cost time, not results."""
    prepare(spark)
    # words of a few code points only, as the workers' own hash can't be replaced from here: the keys are made on the driver
    counts = _vocabulary(random.Random(9), 80)
    words = spark.createDataFrame([(i, w, n) for i, (w, n) in enumerate(counts.items())], "id long, word string, n long")
    monkeypatch.setattr(W, "mix", lambda x: x % 3)
    rows = [r for b in spelling._keys(iter(words.toArrow().to_batches())) for r in b.to_pylist()]
    monkeypatch.undo()
    keys = spark.createDataFrame(rows, "key long, id long, n long, first int, last int")
    monkeypatch.setattr(spelling, "cut", lambda df, name: keys if name == "spelling-keys" else df)
    found = {tuple(sorted((r["a"], r["b"]))) for r in spelling.near_words(words).collect()}
    names = list(counts)
    assert found == {(i, j) for i, j in itertools.combinations(range(len(names)), 2) if _near(names[i], names[j])}


def test_long_words_take_linear_space(spark):
    prepare(spark)
    a = "ab" * 60_000
    counts = {a: 50, a[:-1]: 7, a[:50_000] + "c" + a[50_001:]: 5, "a" * 90_000: 5, "a" * 90_001: 30}
    df = spark.createDataFrame(list(counts.items()), "word string, n long")
    assert _rows(spelling.variants(df)) == _plain_long(counts)


def _plain_long(counts):
    a, shorter, other, b, longer = counts
    return sorted([(a, "", a, 50, 2, 0), (shorter, a, a, 7, 1, 50), (other, a, a, 5, 1, 50), (b, longer, longer, 5, 1, 30), (longer, "", longer, 30, 1, 0)])


def _counted(docs):
    found = Counter()
    for d, t in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if d is None else d}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            found[run] += 1
    return {w: n for w, n in found.items() if len(w) >= 6 and n >= 5}


def test_query_against_its_sql_and_all_pairs(spark, tmp_path):
    rng = random.Random(4)
    base = ["Straße", "colour", "color×r", "wonderful", "ÀÉÎÕÜÿ", "abcdefg", "short", "it's", "x" * 900]
    docs = [(rng.choice([i, 5, None]), rng.choice([None, "", " ".join(rng.choices(base, k=rng.randint(1, 60)))])) for i in range(400)]
    docs += [(i, "Wonderfull colours and colours") for i in range(6)]
    spark.createDataFrame([(d, t, 1) for d, t in docs], "doc_id long, text string, n int").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    mine = _rows(queries.op12_spelling_variants(spark, str(tmp_path)))
    counts = _counted(docs)
    assert mine == _plain(counts) and any(r[1] for r in mine)
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    theirs = con.execute(f"select word, coalesce(form, ''), root, n, n_near, coalesce(form_n, 0) from ({queries.oracle_sql()['op12_spelling_variants']})").fetchall()
    assert sorted(theirs) == mine


def test_empty(spark):
    prepare(spark)
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert spelling.variants(spelling.word_counts(empty)).collect() == []
