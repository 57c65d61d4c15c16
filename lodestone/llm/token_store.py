"""Token-id files: one zstandard frame a document, with a trailing seek table and a checksum for each frame, so a reader decompresses only the documents it asks for.

A file is a row of frames, in the seekable zstandard format: the documents' frames in ascending id order, each with the ids little-endian in 2 or 4 bytes; a skippable frame (magic 0x184D2A5D) with
the document ids; and at the very end the seek table (skippable frame 0x184D2A5E: compressed size, size and low 32 bits of the xxh64 of the content of each frame, that of the ids with size 0, then the number of
frames, the flag byte 0x80 and the magic 0x8F92EAB1). Any zstandard decoder reads a file whole, and readers of the seekable format find its frames. Spark's own text writer writes them to any file system under its
commit protocol: a row is a file but for its last five bytes, FOOTER, which are the writer's line end.

Cases: a null or empty text has the end id alone; a text is one frame, whatever its length (of ids and frames up to 2 GB, what an Arrow value holds); equal ids lie together, ordered by text; a null id comes first; an empty table makes no file and
no row; other columns are left out.
"""

from __future__ import annotations

import json
import os
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._shared import cut, text_slices
from .piece_table import PieceTable
from .word_pieces import with_special

#: What ends a file: the seek table's flags, which tell of checksums, and the magic of seekable files.
FOOTER = bytes([0x80, 0xB1, 0xEA, 0x92, 0x8F])
IDS_MAGIC, SEEK_MAGIC, SEEKABLE = 0x184D2A5D, 0x184D2A5E, 0x8F92EAB1
#: Bytes of text that go to one file, about.
FILE_TEXT_BYTES = 24 << 20
_known: dict[str, Encoder] = {}


class Encoder:
    """A tokenizer file of the tokenizers library, with the ids of the pieces met lately."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        before = spec.get("pre_tokenizer") or {}
        #: Strings that the library takes for tokens wherever they stand.
        self.special = [t["content"].encode() for t in spec.get("added_tokens", [])]
        vocabulary = self.tokenizer.get_vocab()
        self.kind = np.uint16 if len(vocabulary) <= 65536 else np.uint32
        self.width = np.zeros(max(vocabulary.values()) + 1, dtype=np.int64)
        for token, i in vocabulary.items():
            self.width[i] = len(token)  # a byte-level token has a character for each byte
        #: A byte-level tokenizer without normaliser treats pieces apart, so each distinct piece need be encoded once only.
        apart = spec.get("normalizer") is None and before.get("type") == "ByteLevel" and not before.get("add_prefix_space") and before.get("use_regex", True)
        self.table = PieceTable(self.encode_pieces, self.kind) if apart else None

    def encode_pieces(self, new: list[bytes]) -> list[np.ndarray]:
        """Words with a space before are encoded many at a time: laid end to end they split again where they met."""
        texts = [p.decode() for p in new]
        out: list = [None] * len(new)
        words = [i for i, t in enumerate(texts) if t[0] == " " and t[1:].isalpha()]
        other = sorted(set(range(len(new))).difference(words))
        for i in range(0, len(words), 4000):
            part = words[i : i + 4000]
            ids = np.array(self.tokenizer.encode_batch_fast(["".join([texts[k] for k in part])], add_special_tokens=False)[0].ids, dtype=self.kind)
            token_ends = np.cumsum(self.width[ids])
            word_ends = np.cumsum([len(new[k]) for k in part])
            last = np.searchsorted(token_ends, word_ends)
            if not len(ids) or last[-1] >= len(ids) or (token_ends[last] != word_ends).any():
                other += part
                continue
            cuts = (last + 1).tolist()
            for k, a, b in zip(part, [0, *cuts], cuts, strict=False):
                out[k] = ids[a:b]
        for k, e in zip(other, self.tokenizer.encode_batch_fast([texts[k] for k in other], add_special_tokens=False), strict=True):
            out[k] = np.array(e.ids, dtype=self.kind)
        return out

    def packed(self, part: pa.RecordBatch, data: np.ndarray, offsets: np.ndarray, end_id: int) -> list[bytes]:
        """The ids of each text with the end id, packed."""
        tail = np.array([end_id], dtype=self.kind).tobytes()
        if self.table is None:
            texts = [x or "" for x in part.column(1).to_pylist()]
            return [np.array(e.ids, dtype=self.kind).tobytes() + tail for e in self.tokenizer.encode_batch(texts, add_special_tokens=False)]
        whole = lambda texts: [np.array(self.tokenizer.encode(t.decode(), add_special_tokens=False).ids, dtype=self.kind) for t in texts]
        flat, counts = with_special(*self.table.ids(data, offsets), data, offsets, self.special, whole)
        raw, at = flat.tobytes(), (np.concatenate([[0], np.cumsum(counts)]) * flat.itemsize).tolist()
        return [raw[a:b] + tail for a, b in zip(at, at[1:], strict=False)]


def _encoder(path: str) -> Encoder:
    if path not in _known:
        _known[path] = Encoder(path)
    return _known[path]


def _skippable(magic: int, content: bytes) -> bytes:
    return struct.pack("<II", magic, len(content)) + content


def write(docs: DataFrame, path: str, tokenizer_path: str, end_id: int = 0) -> None:
    """Writes docs(doc_id, text) as token files under path, files and the documents in them in ascending doc_id order."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    dealt = docs.repartitionByRange(max(1, -(-size // FILE_TEXT_BYTES)), "doc_id").sortWithinPartitions("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash
        import zstandard

        encoder = _encoder(tokenizer_path)
        press = zstandard.ZstdCompressor(level=3, write_content_size=True)
        width = np.dtype(encoder.kind).itemsize
        ids, table, frames, read = [], [], [], 0

        def file() -> pa.RecordBatch:
            head = json.dumps({"version": 2, "width": width, "nulls": [i for i, x in enumerate(ids) if x is None]}).encode()
            names = _skippable(IDS_MAGIC, struct.pack("<I", len(head)) + head + np.array([x or 0 for x in ids], dtype="<i8").tobytes())
            rows = [*table, struct.pack("<III", len(names), 0, xxhash.xxh64_intdigest(b"") & 0xFFFFFFFF)]
            seek = _skippable(SEEK_MAGIC, b"".join(rows) + struct.pack("<I", len(rows)) + FOOTER)
            content = b"".join([*frames, names, seek.removesuffix(FOOTER)])
            for x in (ids, table, frames):
                x.clear()
            return pa.RecordBatch.from_arrays([pa.array([content], pa.binary())], ["file"])

        for batch in batches:
            for part, data, offsets in text_slices(batch, "text"):
                content = encoder.packed(part, data, offsets, end_id)
                new = [press.compress(x) for x in content]
                ids += part.column(0).to_pylist()
                table += [struct.pack("<III", len(f), len(x), xxhash.xxh64_intdigest(x) & 0xFFFFFFFF) for f, x in zip(new, content, strict=True)]
                frames += new
                read += len(data)
                if read >= FILE_TEXT_BYTES:
                    yield file()
                    read = 0
        if ids:
            yield file()

    files = dealt.mapInArrow(run, "file binary").select(F.col("file").cast("string").alias("value"))
    files.write.option("lineSep", FOOTER.decode("latin-1")).option("encoding", "ISO-8859-1").option("maxRecordsPerFile", 1).text(path)


class TokenFile:
    """A reader of one file's bytes (bytes, or a memory map): finds the frames by the seek table and decompresses those that are asked for."""

    def __init__(self, data):
        import zstandard

        self.data, end = data, len(data)
        count, flags, magic = struct.unpack("<IBI", data[end - 9 : end])
        if magic != SEEKABLE or flags != 0x80:
            raise ValueError("no seek table")
        begin = end - 9 - 12 * count
        if struct.unpack("<II", data[begin - 8 : begin]) != (SEEK_MAGIC, 12 * count + 9):
            raise ValueError("the seek table is damaged")
        self.table = np.frombuffer(data[begin : end - 9], dtype="<u4").reshape(count, 3)
        self.starts = np.concatenate([[0], np.cumsum(self.table[:, 0], dtype=np.int64)])
        self.table = self.table[:-1]  # the last frame has the document ids
        at = int(self.starts[-2])
        magic, size = struct.unpack("<II", data[at : at + 8])
        (head,) = struct.unpack("<I", data[at + 8 : at + 12])
        spec = json.loads(bytes(data[at + 12 : at + 12 + head]))
        self.kind = np.dtype(f"<u{spec['width']}")
        self.doc_ids: list[int | None] = np.frombuffer(data[at + 12 + head : at + 8 + size], dtype="<i8").tolist()
        for i in spec["nulls"]:
            self.doc_ids[i] = None
        self.unpack = zstandard.ZstdDecompressor()

    def __len__(self) -> int:
        return len(self.table)

    def ids(self, i: int) -> np.ndarray:
        """The token ids of the i-th document of the file, checked against its checksum."""
        import xxhash

        a, b = int(self.starts[i]), int(self.starts[i + 1])
        content = self.unpack.decompress(self.data[a:b])
        if len(content) != self.table[i, 1] or xxhash.xxh64_intdigest(content) & 0xFFFFFFFF != self.table[i, 2]:
            raise ValueError(f"frame {i} is damaged")
        return np.frombuffer(content, dtype=self.kind)


def read(spark: SparkSession, path: str, doc_ids: list[int] | None = None, with_ids: bool = True) -> DataFrame:
    """(file, doc_id, local_start, n_tokens, ids_crc32, ids) of the documents in the files under path, all or those asked for; other frames are not decompressed.

    local_start counts the ids before it in its file; n_tokens comes from the seek table, ids_crc32 from the ids as 32-bit integers. Without with_ids, ids is null."""
    wanted = None if doc_ids is None else frozenset(doc_ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                file = TokenFile(memoryview(content.as_buffer()))
                counts = file.table[:, 1].astype(np.int64) // file.kind.itemsize
                starts = np.cumsum(counts) - counts
                take = [i for i in range(len(file)) if wanted is None or file.doc_ids[i] in wanted]
                for k in range(0, len(take), 1024):
                    some = take[k : k + 1024]
                    ids = [file.ids(i).astype("<u4") for i in some]
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([name] * len(some)),
                            pa.array([file.doc_ids[i] for i in some], pa.int64()),
                            pa.array(starts[some]),
                            pa.array(counts[some]),
                            pa.array([zlib.crc32(x) for x in ids], pa.int64()),
                            pa.array([x.astype(np.int32) if with_ids else None for x in ids], pa.list_(pa.int32())),
                        ],
                        ["file", "doc_id", "local_start", "n_tokens", "ids_crc32", "ids"],
                    )

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.txt").load(path).select("path", "content")
    return files.mapInArrow(run, "file string, doc_id long, local_start long, n_tokens long, ids_crc32 long, ids array<int>")


def with_starts(rows: DataFrame) -> DataFrame:
    """read()'s rows of all documents, with `start`, the ids of all documents before each in ascending doc_id order. Only a row for each file meets in one task."""
    rows = cut(rows, "token-rows")
    files = rows.groupBy("file").agg(F.sum("n_tokens").alias("size"), F.min(F.coalesce("doc_id", F.lit(-(2**63)))).alias("lowest"))
    number = lambda pattern: F.regexp_extract("file", pattern, 1).cast("long")
    order = Window.orderBy("lowest", number(r"part-(\d+)"), number(r"-c(\d+)"), "file").rowsBetween(Window.unboundedPreceding, -1)
    files = files.select("file", F.coalesce(F.sum("size").over(order), F.lit(0)).alias("before"))
    return rows.join(files, "file").withColumn("start", F.col("before") + F.col("local_start")).drop("before")
