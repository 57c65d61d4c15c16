"""Packing against the plain library call and a plain best fit, over rounds, hot lengths and odd tables."""

import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers as P
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from lodestone.llm import packing, queries, word_pieces
from lodestone.llm._shared import prepare

JSON = P.path("word_bpe_49k.json")
LIBRARY = Tokenizer.from_file(JSON)


def ids(texts):
    data = [t.encode() for t in texts]
    flat, counts = word_pieces.encoder(JSON).ids(np.frombuffer(b"".join(data), np.uint8), np.concatenate([[0], np.cumsum([len(d) for d in data])]).astype(np.int64))
    return [x.tolist() for x in np.split(flat, np.cumsum(counts)[:-1])]


def plain(texts):
    return [LIBRARY.encode(t, add_special_tokens=False).ids for t in texts]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.text(alphabet="aZé'sT't ll vé̸=≠İſΣς 1²٣,.!<|endoftext|>\n\t  \x1c\x85日🙂", max_size=40), min_size=1, max_size=6))
def test_odd_texts(texts):
    assert ids(texts) == plain(texts)


def test_special_tokens_and_long_pieces():
    texts = ["a<|endoftext|>b", "", "<|startoftext|>", "x" * 3000, "don't 'Student's' 'S", " ", "<|endof text|> Word-word's", "á" * 500]
    assert ids(texts) == plain(texts)


def test_every_code_point():
    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    texts = ["".join(f"a{chr(c)}b {chr(c)}1{chr(c)}' " for c in points[k : k + 400]) for k in [*range(0, 0x3000, 400), *range(0x3000, len(points), 8000)]]
    assert ids(texts) == plain(texts)


def _plain_best_fit(sizes, room):
    left = []
    for s in sorted(sizes, reverse=True):
        fits = [i for i, r in enumerate(left) if r >= s]
        if fits:
            left[min(fits, key=lambda i: left[i])] -= s
        else:
            left.append(room - s)
    return len(left), sorted(left)


def test_best_fit():
    rng = random.Random(1)
    for room in (10, 64, 4096):
        for _ in range(20):
            sizes = np.array([rng.randint(1, room) for _ in range(rng.randint(0, 200))], dtype=np.int64)
            bins, offsets, full = packing.best_fit(sizes, room)
            assert (len(full), sorted((room - full).tolist())) == _plain_best_fit(sizes.tolist(), room)
            spans = defaultdict(list)
            for s, b, o in zip(sizes, bins, offsets):
                spans[b].append((o, o + s))
            for b, x in spans.items():
                x.sort()
                assert x[0][0] == 0 and all(p[1] == q[0] for p, q in zip(x, x[1:])) and x[-1][1] == full[b]


def _check(rows, docs, room):
    """Whole documents, gapless places; returns the number of sequences and the tokens."""
    want, tokens = [], 0
    for d, t in docs:
        seq = [*LIBRARY.encode(t or "", add_special_tokens=False).ids, 1]
        tokens += len(seq)
        for k, a in enumerate(range(0, len(seq), room)):
            want.append((d is not None, d, k, a, len(seq[a : a + room]), zlib.crc32(np.array(seq[a : a + room], "<u4").tobytes())))
    key = lambda r: tuple((x is None, x) for x in r)
    assert sorted(((r["doc_id"] is not None, r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows), key=key) == sorted(want, key=key)
    spans = defaultdict(list)
    for r in rows:
        spans[r["sequence_id"]].append((r["offset"], r["offset"] + r["length"]))
    for x in spans.values():
        x.sort()
        assert x[0][0] == 0 and all(p[1] == q[0] for p, q in zip(x, x[1:])) and x[-1][1] <= room
    return len(spans), tokens


def _docs(rng, n, most):
    return [(rng.choice([i, 7, None]), rng.choice([None, "", " ".join(rng.choices(["alpha", "be", "gamma's", "Été,"], k=rng.randint(0, most)))])) for i in range(n)]


@pytest.mark.parametrize("room", [8, 64, 4096])
def test_rounds(spark, monkeypatch, room):
    prepare(spark)
    monkeypatch.setattr(packing, "CHUNK", 50)
    monkeypatch.setattr(packing, "MERGE", 40)
    docs = _docs(random.Random(room), 500, 40)
    table = spark.createDataFrame([(d, t, 1) for d, t in docs], "doc_id int, text string, piece int").repartition(9)
    rows = packing.pieces(packing.pack(table, JSON, end_id=1, room=room)).collect()
    n, tokens = _check(rows, docs, room)
    assert n <= 1.1 * -(-tokens // room) + 3


def test_one_length_fills_the_table(spark, monkeypatch):
    """Sequences that can't share a bin end the rounds, and no task gets them all."""
    prepare(spark)
    monkeypatch.setattr(packing, "MERGE", 20)
    monkeypatch.setattr(packing, "CHUNK", 10)
    monkeypatch.setattr(packing, "CARRIED", 5)
    docs = [(i, "be " * 4) for i in range(300)] + [(i, "be " * k) for i, k in zip(range(300, 400), range(100))]
    for room in (8, 9, 11):
        rows = packing.pieces(packing.pack(spark.createDataFrame(docs, "doc_id long, text string").repartition(8), JSON, end_id=1, room=room)).collect()
        n, tokens = _check(rows, docs, room)
        assert n <= _plain_best_fit([r["length"] for r in rows], room)[0] * 1.1 + 3


def test_query(spark, tmp_path):
    docs = [*_docs(random.Random(3), 60, 300), (1, "word " * 9000), (2, "x<|endoftext|>y")]
    spark.createDataFrame(docs, "doc_id long, text string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    df = queries.op11_best_fit_packing(spark, str(tmp_path))
    assert dict(df.dtypes) == {"doc_id": "bigint", "piece": "int", "start": "bigint", "length": "bigint", "ids_crc32": "bigint", "sequence_id": "bigint", "offset": "bigint"}
    n, tokens = _check(df.collect(), docs, 4096)
    assert n <= -(-tokens // 4096) + 1
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert packing.pieces(packing.pack(empty, JSON, 1)).collect() == []
