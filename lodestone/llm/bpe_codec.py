"""Byte-level BPE from a rank file: encoding and decoding.

Texts are cut by pretokens.boundaries; each distinct piece is merged once and kept in a PieceTable, pairs of lowest rank first and leftmost among equals. `ends`, the byte offset
behind each token, lets decoding find the tokens of any byte range. The vocabulary is a file that every worker can read by its path.

Cases: a null or empty text has no ids and decodes to no bytes; a text of any length is whole; a piece of any length is merged in n log n steps; repeated rows each get a row; other columns are left out.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ._shared import text_slices
from .piece_table import PieceTable


@lru_cache(4)
def ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


@lru_cache(4)
def vocabulary(path: str) -> list[bytes]:
    by = ranks(path)
    out = [b""] * (max(by.values()) + 1)
    for token, i in by.items():
        out[i] = token
    return out


def merge(piece: bytes, rank: dict[bytes, int]) -> list[int]:
    """The ids of one piece."""
    whole = rank.get(piece)
    if whole is not None:
        return [whole]
    n = len(piece)
    if n > 48:
        return _merge_long(piece, rank)
    parts = [piece[i : i + 1] for i in range(n)]
    pairs = [rank.get(a + b) for a, b in zip(parts, parts[1:], strict=False)]
    while True:
        best, at = None, -1
        for i, r in enumerate(pairs):
            if r is not None and (best is None or r < best):
                best, at = r, i
        if best is None:
            return [rank[p] for p in parts]
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
        del pairs[at]
        if at:
            pairs[at - 1] = rank.get(parts[at - 1] + parts[at])
        if at < len(pairs):
            pairs[at] = rank.get(parts[at] + parts[at + 1])


def _merge_long(piece: bytes, rank: dict[bytes, int]) -> list[int]:
    n = len(piece)
    end, after, before = list(range(1, n + 1)), list(range(1, n + 1)), list(range(-1, n - 1))
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := rank.get(piece[i : i + 2])) is not None]
    heapq.heapify(heap)
    alive = [True] * n
    while heap:
        _, i, stop = heapq.heappop(heap)
        j = after[i]
        if not alive[i] or j >= n or end[j] != stop:
            continue
        alive[j], end[i], after[i] = False, stop, after[j]
        if after[i] < n:
            before[after[i]] = i
        for a in (before[i], i):
            if a >= 0 and after[a] < n and (r := rank.get(piece[a : end[after[a]]])) is not None:
                heapq.heappush(heap, (r, a, end[after[a]]))
    return [rank[piece[i : end[i]]] for i in range(n) if alive[i]]


_tables: dict[str, PieceTable] = {}


def table(path: str) -> PieceTable:
    """This worker's cache of merged pieces."""
    if path not in _tables:
        rank = ranks(path)
        _tables[path] = PieceTable(lambda pieces: [np.array(merge(p, rank), dtype=np.int32) for p in pieces], np.int32)
    return _tables[path]


def _encoded(batches: Iterator[pa.RecordBatch], path: str, id_column: str, text_column: str) -> Iterator[pa.RecordBatch]:
    cache = table(path)
    width = np.array([len(x) for x in vocabulary(path)], dtype=np.int32)
    for batch in batches:
        for part, data, offsets in text_slices(batch, text_column):
            flat, counts = cache.ids(data, offsets)
            at = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
            ends = np.cumsum(width[flat], dtype=np.int64)
            ends -= np.repeat(np.concatenate([[0], ends])[at[:-1]], counts)
            lists = [pa.ListArray.from_arrays(pa.array(at), pa.array(x.astype(np.int32))) for x in (flat, ends)]
            yield pa.RecordBatch.from_arrays([part.column(0), *lists], [id_column, "ids", "ends"])


def _decoded(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    get = vocabulary(path).__getitem__
    for batch in batches:
        at = batch.schema.get_field_index("ids")
        decoded = [b"".join(map(get, x.values.to_numpy().tolist())) if x.is_valid else b"" for x in batch.column(at)]
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(decoded, pa.binary())], [*batch.schema.names, "bytes"])


def encode(docs: DataFrame, path: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, ids, ends) for each row: token ids, and the byte offset behind each token."""
    kept = docs.select(id_column, text_column)
    kind = kept.schema[0].dataType.simpleString()
    return kept.mapInArrow(lambda batches: _encoded(batches, path, id_column, text_column), f"`{id_column}` {kind}, ids array<int>, ends array<int>")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """encoded(id, ids, ...) with `bytes`, the decoded text, beside."""
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema)
    return encoded.mapInArrow(lambda batches: _decoded(batches, path), f"{fields}, bytes binary")


def round_trip(docs: DataFrame, path: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, ids, bytes): encode() and, of its ids, decode(), one after the other in the same worker, so that no second one is kept for each task."""
    kept = docs.select(id_column, text_column)
    kind = kept.schema[0].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coded = (pa.RecordBatch.from_arrays([b.column(0), b.column(1)], [id_column, "ids"]) for b in _encoded(batches, path, id_column, text_column))
        return _decoded(coded, path)

    return kept.mapInArrow(run, f"`{id_column}` {kind}, ids array<int>, bytes binary")


def decode_range(ids: list[int], ends: list[int], path: str, start: int, stop: int) -> bytes:
    """The bytes from start to stop of a text, from the tokens that cover them alone."""
    first = int(np.searchsorted(ends, start, side="right"))
    last = min(len(ids), int(np.searchsorted(ends, stop, side="left")) + 1)
    offset = ends[first - 1] if first else 0
    return b"".join(vocabulary(path)[i] for i in ids[first:last])[start - offset : stop - offset]
