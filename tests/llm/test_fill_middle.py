"""Fill-in-middle: the lists of boundaries, every form rebuilt, and the query against its SQL."""

import hashlib
import random
import re

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lodestone.llm import fill_middle as fm
from lodestone.llm import queries
from lodestone.llm._shared import prepare


@settings(max_examples=200, deadline=None)
@given(st.sets(st.integers(0, 5000), max_size=900), st.integers(0, 1 << 30))
def test_elias_fano(values, more):
    values = np.array(sorted(values), dtype=np.int64)
    bound = int(values[-1]) + 1 + more if len(values) else more
    packed = fm.EliasFano.pack(values, bound)
    found = fm.EliasFano(packed)
    assert [found[i] for i in range(len(found))] == values.tolist()
    with pytest.raises(IndexError):
        found[len(values)]


def test_lists_are_small():
    text = "words of about five letters " * 4000
    assert len(fm.boundaries(text)) < 0.2 * len(text)


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="aZ é<PSM>1\n🙂", max_size=60))
def test_boundaries(text):
    ends = fm.EliasFano(fm.boundaries(text))
    assert [ends[i] for i in range(len(ends))] == [m.end() for m in re.finditer("[A-Za-z]+|[^A-Za-z]", text)]


def _plain(d, t):
    t = t or ""
    units = re.findall("[A-Za-z]+|[^A-Za-z]", t)
    sign = hashlib.sha256(f"1:{'' if d is None else d}".encode()).hexdigest()
    h = [int(sign[i : i + 8], 16) for i in range(0, 32, 8)]
    a, b = sorted(x % (len(units) + 1) for x in h[:2])
    prefix, middle, suffix = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not t or any(m in t for m in fm.MARKERS) or h[2] % 100 >= 90:
        return d, len(units), "plain", None, None, t
    if h[3] % 100 < 20:
        return d, len(units), "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}"
    return d, len(units), "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}"


def _docs(rng, n):
    texts = ["", None, "<P> marked", "<", "<S", "a<P", "P>", "S>M>", "é🙂\n", "one two  three", "x" * 5000, "<" * 40, "<S<P<M" * 9]
    return [(rng.choice([i, 3, None]), rng.choice([*texts, " ".join(rng.choices(["lo", "Wörd", "<", "S>", ">\r\n"], k=rng.randint(0, 90)))])) for i in range(n)]


KEY = lambda r: tuple((x is None, x) for x in r)


@pytest.mark.parametrize("copies", [1000, 3])
def test_transform(spark, monkeypatch, copies):
    """Small COPIES split the frequent texts into parts."""
    prepare(spark)
    monkeypatch.setattr(fm, "COPIES", copies)
    docs = _docs(random.Random(copies), 700) + [(i, "a copy of one text") for i in range(1000, 1400)] + [(None, "one row, again and again")] * 300
    table = spark.createDataFrame([(d, t, 1) for d, t in docs], "doc_id int, text string, n int").repartition(5)
    if copies == 3:
        assert max(len(r["docs"]) for r in fm._grouped(table).collect()) < 90  # a task's share of equal rows stays together
    rows = fm.transform(table).withColumn("restored", fm.restored()).collect()
    assert sorted((tuple(r)[:6] for r in rows), key=KEY) == sorted((_plain(d, t) for d, t in docs), key=KEY)
    assert sorted((r["doc_id"] is None, r["doc_id"], r["restored"]) for r in rows if r["doc_id"] is not None) == sorted((False, d, t or "") for d, t in docs if d is not None)
    assert {r["form"] for r in rows} == {"plain", "psm", "spm"}


def test_query_against_its_sql(spark, tmp_path):
    docs = _docs(random.Random(8), 300)
    spark.createDataFrame(docs, "doc_id long, text string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    mine = [tuple(r) for r in queries.op13_fill_in_middle(spark, str(tmp_path)).collect()]
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    theirs = con.execute(f"select doc_id, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256 from ({queries.oracle_sql()['op13_fill_in_middle']})").fetchall()
    assert sorted(mine, key=KEY) == sorted(theirs, key=KEY)
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert fm.transform(empty).collect() == []
