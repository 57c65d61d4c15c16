"""Byte-level BPE against tiktoken and the tokenizers library, whole texts and every code point."""

import base64
import hashlib
import random
import zlib

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from lodestone.llm import _words as W
from lodestone.llm import bpe_codec, pretokens, token_store
from lodestone.llm._shared import fresh_path, prepare

RANKS, JSON = P.path("byte_bpe_50k.tiktoken"), P.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    with open(RANKS, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def ids(texts, table=None):
    data = [t.encode() for t in texts]
    flat, counts = (table or bpe_codec.table(RANKS)).ids(np.frombuffer(b"".join(data), np.uint8), np.concatenate([[0], np.cumsum([len(d) for d in data])]))
    ends = np.cumsum(counts)
    return [flat[a:b].tolist() for a, b in zip(np.concatenate([[0], ends]), ends)]


def test_monoid_is_small_and_associative():
    _, table, functions, _, identity = pretokens.monoid()
    assert len(table) < 1000 and (table[identity] == np.arange(len(table))).all()
    rng = np.random.default_rng(0)
    a, b, c = rng.integers(0, len(table), (3, 2000))
    assert (table[table[a, b], c] == table[a, table[b, c]]).all()
    x = rng.integers(0, len(table), 5000).astype(np.uint16)
    out = pretokens.scan(x, table)
    acc = x[0]
    for i in range(1, 300):
        acc = table[acc, x[i]]
        assert out[i] == acc


def test_every_code_point(library):
    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    texts = ["a" + chr(c) + "1" + chr(c) + " " + chr(c) + ". " for c in points[::3] + points[:0x3000]]
    assert ids(texts) == [library.encode_ordinary(t) for t in texts]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet="ab's t're ve ll  \n\t é1²'.,!\"日　🙂Ⅷ́ dm", max_size=40), max_size=6))
def test_odd_texts(texts):
    with open(RANKS, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    enc = test_odd_texts.__dict__.setdefault("enc", tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={}))
    assert ids(texts) == [enc.encode_ordinary(t) for t in texts]


def test_long_pieces_and_a_full_table(library):
    texts = ["a" * 5000, "ab" * 3000 + " x", "", "<|endoftext|>", " " * 1000 + "a", "'s'st 'll'"]
    assert ids(texts) == [library.encode_ordinary(t) for t in texts]
    small = bpe_codec.PieceTable(bpe_codec.table(RANKS).encode, np.int32, most=16)
    rng = random.Random(0)
    many = [" ".join("".join(rng.choices("abcdef", k=rng.randint(1, 12))) for _ in range(200)) for _ in range(30)]
    for t in many:
        assert ids([t], small) == [library.encode_ordinary(t)]


DOCS = [(3, "The cat's hat.", 1), (1, None, 2), (2, "", 3), (2, "x " * 40000, 4), (None, "été 日本", 5), (3, "The cat's hat.", 6)]


def test_round_trip(spark, library):
    prepare(spark)
    docs = spark.createDataFrame(DOCS, "doc_id long, text string, ids int")
    rows = bpe_codec.decode(bpe_codec.encode(docs, RANKS), RANKS).collect()
    assert sorted((str(r["doc_id"]), bytes(r["bytes"]).decode()) for r in rows) == sorted((str(d), t or "") for d, t, _ in DOCS)
    for r in rows:
        text = bytes(r["bytes"])
        assert list(r["ids"]) == library.encode_ordinary(text.decode())
        for a, b in ((0, 3), (2, 9), (5, 5), (0, len(text))):
            assert bpe_codec.decode_range(r["ids"], r["ends"], RANKS, a, b) == text[a:b]
    assert bpe_codec.encode(spark.createDataFrame([], "doc_id long, text string"), RANKS).count() == 0


def test_token_files(spark):
    prepare(spark)
    docs = spark.createDataFrame(DOCS, "doc_id long, text string, start int")
    path = fresh_path(spark, "test-tokens")
    token_store.write(docs, path, JSON)
    rows = token_store.with_starts(token_store.read(spark, path)).collect()
    library = Tokenizer.from_file(JSON)
    at = 0
    order = sorted(DOCS, key=lambda d: (d[0] is not None, d[0] or 0, d[1] is not None, d[1] or ""))
    for r, (d, t, _) in zip(sorted(rows, key=lambda r: r["start"]), order, strict=True):
        want = [*library.encode(t or "", add_special_tokens=False).ids, 0]
        assert (r["doc_id"], r["start"], r["n_tokens"], list(r["ids"])) == (d, at, len(want), want)
        assert r["ids_crc32"] == zlib.crc32(np.array(want, "<u4").tobytes())
        at += len(want)
    assert {r["doc_id"] for r in token_store.read(spark, path, [3]).collect()} == {3}
    import glob
    import zstandard

    files = glob.glob(path.removeprefix("file://") + "/*.txt")
    whole = b""
    for f in files:
        raw = open(f, "rb").read()
        whole += zstandard.ZstdDecompressor().stream_reader(raw, read_across_frames=True).read()
        file = token_store.TokenFile(raw)
        # as a reader of the seekable format looks at it: the footer is the last nine bytes, and frames lie end to end up to the seek table
        frames = int.from_bytes(raw[-9:-5], "little")
        assert raw[-5:] == b"\x80" + (0x8F92EAB1).to_bytes(4, "little") and frames == len(file) + 1
        table = len(raw) - 9 - 12 * frames
        assert raw[table - 8 : table - 4] == (0x184D2A5E).to_bytes(4, "little") and int(file.starts[-1]) == table - 8
        assert file.ids(0).tolist()[-1] == 0
        broken = bytearray(raw)
        broken[int(file.starts[0]) + 12] ^= 0xFF
        with pytest.raises(Exception):
            token_store.TokenFile(bytes(broken)).ids(0)
    assert hashlib.md5(whole).hexdigest()  # any zstandard decoder reads the files whole
    empty = fresh_path(spark, "test-empty")
    token_store.write(spark.createDataFrame([], "doc_id long, text string"), empty, JSON)
    assert token_store.with_starts(token_store.read(spark, empty)).count() == 0


def _thue_morse(n, a, b):
    return "".join((a, b)[bin(i).count("1") % 2] for i in range(1 << n))


def test_pieces_of_equal_hashes(library, monkeypatch):
    """Pieces that sums of powers can't tell apart, then a hash that tells hardly any apart."""
    texts = [x + _thue_morse(n, *y) for n in (4, 6, 10, 11, 12) for x in ("", "cccccccc") for y in ("ab", "ba")]
    assert ids(texts) == [library.encode_ordinary(t) for t in texts]
    monkeypatch.setattr(W, "hashes", lambda data, a, b: np.asarray((b - a) % 3 + 1, dtype=np.uint64))
    table = bpe_codec.PieceTable(bpe_codec.table(RANKS).encode, np.int32, most=500)
    rng = random.Random(1)
    many = [" ".join("".join(rng.choices("abé", k=rng.choice([2, 7, 8, 9, 15, 16, 17, 70]))) for _ in range(60)) for _ in range(8)]
    for t in (many[:4], many[4:], many):
        assert ids(t, table) == [library.encode_ordinary(x) for x in t]


def test_registered_queries(spark, library, tmp_path):
    from lodestone.llm import queries

    rows = [(3, "The cat's hat. <|endoftext|>"), (1, None), (2, ""), (7, "x " * 3000), (5, "été 日本 " + _thue_morse(9, "a", "b")), (6, _thue_morse(9, "b", "a")), (8, "a<|endoftext|>b<|endoftext|><|endoftext|>"), (9, "<|endoftext|")]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(2).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r for r in queries.op2_byte_level_bpe(spark, str(tmp_path)).collect()}
    for d, t in rows:
        want = library.encode_ordinary(t or "")
        digest = hashlib.sha256(" ".join(map(str, want)).encode()).hexdigest()
        assert tuple(got[d]) == (d, len(want), digest, hashlib.sha256((t or "").encode()).hexdigest())
    plain, at = Tokenizer.from_file(JSON), 0  # the library call as it stands: a special token's string is the token
    assert 50256 in plain.encode("<|endoftext|>", add_special_tokens=False).ids
    found = {r["doc_id"]: tuple(r) for r in queries.op5_token_id_files(spark, str(tmp_path)).collect()}
    for d, t in sorted(rows, key=lambda r: r[0]):
        want = [*plain.encode(t or "", add_special_tokens=False).ids, 0]
        assert found[d] == (d, at, len(want), zlib.crc32(np.array(want, "<u4").tobytes()))
        at += len(want)


def test_files_are_cut_by_size(spark, monkeypatch):
    monkeypatch.setattr(token_store, "FILE_TEXT_BYTES", 5000)
    prepare(spark)
    rng = random.Random(2)
    docs = [(rng.choice([i, 7]), " ".join(rng.choices(["alpha", "be", "gamma"], k=rng.randint(0, 900)))) for i in range(120)]
    path = fresh_path(spark, "test-cut")
    token_store.write(spark.createDataFrame(docs, "doc_id long, text string"), path, JSON)
    rows = sorted(token_store.with_starts(token_store.read(spark, path)).collect(), key=lambda r: r["start"])
    library, at = Tokenizer.from_file(JSON), 0
    for r, (d, t) in zip(rows, sorted(docs), strict=True):
        want = [*library.encode(t, add_special_tokens=False).ids, 0]
        assert (r["doc_id"], r["start"], list(r["ids"])) == (d, at, want)
        at += len(want)
    assert len({r["file"] for r in rows}) > 20
