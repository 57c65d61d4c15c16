"""Fill-in-middle transformation by an index of distinct texts.

Documents are grouped by their texts themselves (Spark compares the grouped bytes, so the groups are verified), combined on the map side, with the ids of a text's documents in a list. For each
distinct text the ends of its tokens are kept once as an Elias-Fano list, 2 + log2(chars / tokens) bits a token with a small directory, whose i-th entry is found without decoding the others; the list is joined back to the text's documents, and each
selects the two entries that its seed draws. A text that holds more than a 1 / HOT_SHARE of all rows (and more than COPIES rows) has its documents dealt into parts of about that size, each a group of its own, so no list
and no task is larger than that; at most HOT_SHARE texts can be so frequent, which bounds the table of them that is broadcast.

Cases: a null text is empty, and an empty text has no tokens and form plain; a text of any length is whole; rows of one doc_id each have a row; a null doc_id has the seed of `<seed>:` alone; an empty table has no rows; other columns are left out.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._shared import cut, give_back

COPIES, HOT_SHARE = 1000, 20_000
#: Bytes of output of one Arrow batch, about.
OUT_BYTES = 2_000_000
_BLOCK = 64
MARKERS = ("<P>", "<S>", "<M>")


class EliasFano:
    """An increasing list of numbers below a bound, as bytes: the low bits of each side by side, the high parts as steps in a bit array, and the number of ones before each of its blocks."""

    def __init__(self, packed: bytes):
        self.n, self.width, blocks, high = struct.unpack("<QBQQ", packed[:25])
        self.ranks = np.frombuffer(packed, "<i8", blocks, 25)
        self.high = np.frombuffer(packed, np.uint8, high, 25 + 8 * blocks)
        self.low = np.frombuffer(packed, np.uint8, offset=25 + 8 * blocks + high)

    @staticmethod
    def pack(values: np.ndarray, bound: int) -> bytes:
        n = len(values)
        width = max(0, (bound // n).bit_length() - 1) if n else 0
        bits = np.zeros(-(-(n + (bound >> width) + 1) // (8 * _BLOCK)) * 8 * _BLOCK, dtype=np.uint8)
        bits[(values >> width) + np.arange(n)] = 1
        ones = bits.reshape(-1, 8 * _BLOCK).sum(axis=1, dtype=np.int64)
        low = np.packbits(((values[:, None] >> np.arange(width)) & 1).astype(np.uint8).ravel(), bitorder="little")
        high = np.packbits(bits, bitorder="little")
        return struct.pack("<QBQQ", n, width, len(ones), len(high)) + (np.cumsum(ones) - ones).astype("<i8").tobytes() + high.tobytes() + low.tobytes()

    def __len__(self) -> int:
        return self.n

    def __getitem__(self, i: int) -> int:
        if not 0 <= i < self.n:
            raise IndexError(i)
        block = int(np.searchsorted(self.ranks, i, side="right")) - 1
        bits = np.unpackbits(self.high[block * _BLOCK : (block + 1) * _BLOCK], bitorder="little")
        place = block * 8 * _BLOCK + int(np.flatnonzero(bits)[i - int(self.ranks[block])])
        begin = i * self.width
        some = int.from_bytes(self.low[begin // 8 : (begin + self.width + 7) // 8].tobytes(), "little") >> begin % 8
        return (place - i) << self.width | some & (1 << self.width) - 1


def boundaries(text: str) -> bytes:
    """The ends, in code points, of the tokens [A-Za-z]+|[^A-Za-z] of a text."""
    codes = np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32)
    letter = ((codes | 32) - 97) < 26
    ends = np.flatnonzero(~(letter[:-1] & letter[1:])) + 1
    return EliasFano.pack(np.append(ends, len(codes)) if len(codes) else ends[:0], len(codes) + 1)


def _drawn(doc_id, seed: int, n: int) -> tuple[int, int, int, int]:
    """The tokens before the first and the second cut, and the two numbers below 100 that decide on the form."""
    sign = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(sign[i : i + 8], 16) for i in (0, 8, 16, 24))
    a, b = h1 % (n + 1), h2 % (n + 1)
    return min(a, b), max(a, b), h3 % 100, h4 % 100


def _grouped(docs: DataFrame) -> DataFrame:
    """(text, docs): each distinct text, or part of a very frequent one, with the ids of its documents, each in a struct."""
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    copies = cut(docs.groupBy(F.xxhash64("text").alias("sign")).agg(F.count("*").alias("copies")), "fim-copies")
    rows = copies.agg(F.sum("copies")).first()[0] or 0
    most = max(COPIES, rows // HOT_SHARE)
    hot = copies.where(F.col("copies") > most).select("sign", F.ceil(F.col("copies") / most).alias("parts"))
    dealt = docs.withColumn("sign", F.xxhash64("text")).join(F.broadcast(hot), "sign", "left")  # hot has fewer than HOT_SHARE rows
    part = F.coalesce(F.pmod(F.xxhash64("doc_id", F.spark_partition_id()), "parts"), F.lit(0))  # equal rows part by where they lie
    return dealt.select(part.alias("part"), "text", "doc_id").groupBy("part", "text").agg(F.collect_list(F.struct("doc_id")).alias("docs")).select("text", "docs")


def transform(docs: DataFrame, seed: int = 1, plain: int = 90, spm: int = 20) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output) of docs(doc_id, text). Of a hundred drawn documents about 100 - plain stay plain, and of the others spm in a hundred are suffix first; texts that hold a marker stay plain."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        size = 0

        def batch_of() -> pa.RecordBatch:
            columns = list(zip(*out, strict=True))
            kinds = [id_type, pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.large_string()]
            made = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])
            out.clear()
            return made

        for batch in batches:
            id_type = batch.column(1).type.value_type.field(0).type
            for text, owners in zip(batch.column(0), batch.column(1), strict=True):
                text = text.as_py()
                ends = EliasFano(boundaries(text))
                marked = not text or any(m in text for m in MARKERS)
                for doc in owners.as_py():
                    a, b, h3, h4 = _drawn(doc["doc_id"], seed, len(ends))
                    if marked or h3 >= plain:
                        out.append((doc["doc_id"], len(ends), "plain", None, None, text))
                    else:
                        i, j = (ends[k - 1] if k else 0 for k in (a, b))
                        prefix, middle, suffix = text[:i], text[i:j], text[j:]
                        form, made = ("spm", f"<S>{suffix}<P>{prefix}<M>{middle}") if h4 < spm else ("psm", f"<P>{prefix}<S>{suffix}<M>{middle}")
                        out.append((doc["doc_id"], len(ends), form, i, j - i, made))
                    size += len(text)
                    if size >= OUT_BYTES or len(out) >= 4096:
                        yield batch_of()
                        size = 0
        if out:
            yield batch_of()
        give_back()

    return _grouped(docs).mapInArrow(run, f"doc_id {kind}, n long, form string, prefix_chars long, middle_chars long, output string")


def restored(output: str = "output", form: str = "form") -> Column:
    """The text that an output was made of, by its form. A marker's first place is the true one: texts that hold one stay plain, and none can arise across a marker's edge, as `<` stands at their beginning alone."""
    out, spm = F.col(output), F.col(form) == "spm"
    p = F.when(spm, F.locate("<P>", out, 4)).otherwise(F.locate("<S>", out, 4))
    m = F.locate("<M>", out, 4)
    one, two, three = F.substring(out, F.lit(4), p - 4), F.substring(out, p + 3, m - p - 3), F.substring(out, m + 3, F.length(out))
    return F.when(F.col(form) == "plain", out).when(spm, F.concat(two, three, one)).otherwise(F.concat(one, three, two))
