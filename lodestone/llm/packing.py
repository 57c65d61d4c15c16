"""Best-fit packing of tokenised documents into sequences, by hierarchical residual packing.

A text becomes its token ids and an end id; one longer than a sequence is cut into pieces of a whole sequence, the last of which may be shorter. Each scan task packs the pieces it meets by best fit, largest first (into the bin whose room
is the least that does), in chunks of CHUNK pieces: bins that are nearly full (room of at most SLACK tokens) are done, and the underfull ones are items of the next chunk. What a task has left at its end is
written, and tree-merged: underfull bins, whole, are the items of a next round of best fit in fewer tasks, until one task has fitted all that is left, or a round merges next to nothing, when no two bins that are left fit together often
enough to go on. A round's tasks hold MERGE bins or MEMBERS pieces each at most on average, whatever the data, so a third of all rows of one length costs rounds, not memory. Nothing meets on the driver but the counts of a round.

A bin is a row with its pieces in an array of at most `room` entries, as every piece has a token at least. Each round ends in a written table, so a lost executor costs no more than its own tasks, and sequences never change once written.

Cases: a null or empty text is the end id alone; a text of any length is whole; rows of one doc_id, and null ids, are documents of their own; an empty table has no rows; other columns are left out.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import cut, text_slices

#: Tokens of room that a bin that counts as nearly full has at most.
SLACK = 4
#: Pieces that one best fit of a scan task takes, and those underfull bins it may carry from chunk to chunk.
CHUNK, CARRIED = 50_000, 25_000
#: Bins, and pieces in them, of a task of a merging round.
MERGE, MEMBERS = 20_000, 200_000
#: A round that leaves more than this share of its bins is the last.
GAIN = 0.98
_MEMBER = pa.struct([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("offset", pa.int64())])
_ROW = pa.schema([("sequence_id", pa.int64()), ("size", pa.int32()), ("members", pa.list_(_MEMBER))])
SCHEMA = "sequence_id long, size int, members array<struct<doc_id:long,piece:int,start:long,length:long,ids_crc32:long,offset:long>>"


def best_fit(sizes: np.ndarray, room: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bin of each item, its offset there, size of each bin): best fit, largest items first, equal ones in the order given."""
    order = np.argsort(-sizes, kind="stable")
    bins, offsets, left = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64), []
    waiting: list[list[int]] = [[] for _ in range(room + 1)]  # bins by the room that they have
    rooms = 0  # a bit for each room that some bin has
    for i, s in zip(order.tolist(), sizes[order].tolist(), strict=True):
        fits = rooms >> s
        if fits:
            had = s + (fits & -fits).bit_length() - 1
            b = waiting[had].pop()
            if not waiting[had]:
                rooms ^= 1 << had
        else:
            b, had = len(left), room
            left.append(room)
        bins[i], offsets[i], left[b] = b, room - had, had - s
        if had > s:
            waiting[had - s].append(b)
            rooms |= 1 << (had - s)
    return bins, offsets, room - np.array(left, dtype=np.int64)


class _Bins:
    """Items of one best fit: sizes, and the members (columns of _MEMBER) of each, laid end to end."""

    def __init__(self, sizes: np.ndarray, counts: np.ndarray, members: list[np.ndarray], known: np.ndarray):
        self.sizes, self.counts, self.members, self.known = sizes, counts, members, known

    @staticmethod
    def of(pieces: list[np.ndarray], known: np.ndarray) -> _Bins:
        n = len(known)
        return _Bins(pieces[3], np.ones(n, np.int64), [*pieces, np.zeros(n, np.int64)], known)

    @staticmethod
    def read(batch: pa.RecordBatch) -> _Bins:
        lists = batch.column(batch.schema.get_field_index("members"))
        flat = lists.flatten()
        ids = flat.field(0)
        columns = [np.asarray(ids.fill_null(0)), *[np.asarray(flat.field(k)) for k in range(1, 6)]]
        return _Bins(np.asarray(batch.column(batch.schema.get_field_index("size"))).astype(np.int64), np.asarray(lists.value_lengths()).astype(np.int64), columns, np.asarray(ids.is_valid()))

    @staticmethod
    def joined(parts: list[_Bins]) -> _Bins:
        return _Bins(np.concatenate([p.sizes for p in parts]), np.concatenate([p.counts for p in parts]), [np.concatenate(c) for c in zip(*[p.members for p in parts], strict=True)], np.concatenate([p.known for p in parts]))

    def ordered(self) -> _Bins:
        """The same items in an order that does not depend on the order of arrival."""
        first = np.cumsum(self.counts) - self.counts
        return self.taken(np.lexsort([*[c[first] for c in self.members[::-1]], self.known[first], -self.sizes]))

    def taken(self, rows: np.ndarray) -> _Bins:
        counts = self.counts[rows]
        begin = (np.cumsum(self.counts) - self.counts)[rows]
        at = np.repeat(begin - (np.cumsum(counts) - counts), counts) + np.arange(int(counts.sum()))
        return _Bins(self.sizes[rows], counts, [c[at] for c in self.members], self.known[at])

    def packed(self, room: int) -> _Bins:
        """One best fit: bins with the members of the items in them, by offset."""
        items = self.ordered()
        bins, offsets, sizes = best_fit(items.sizes, room)
        items.members[5] = items.members[5] + np.repeat(offsets, items.counts)
        items = items.taken(np.lexsort([offsets, bins]))
        bins = np.sort(bins)
        return _Bins(sizes, np.bincount(bins, weights=items.counts, minlength=len(sizes)).astype(np.int64), items.members, items.known)

    def rows(self, first_id: int) -> Iterator[pa.RecordBatch]:
        """Bins as rows, numbered from first_id on, in batches of about a hundred thousand members."""
        upto = np.cumsum(self.counts)
        i = 0
        while i < len(self.sizes):
            j = max(i + 1, int(np.searchsorted(upto, upto[i] + 100_000)))
            part = self.taken(np.arange(i, min(j, len(self.sizes))))
            i = j
            columns = [pa.array(c, f.type, mask=~part.known if k == 0 else None) for k, (c, f) in enumerate(zip(part.members, _MEMBER, strict=True))]
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(part.counts)]), pa.int32()), pa.StructArray.from_arrays(columns, fields=list(_MEMBER)))
            ids = np.arange(first_id, first_id + len(part.sizes))
            first_id += len(ids)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(part.sizes, pa.int32()), lists], schema=_ROW)


class _Numbers:
    """Sequence ids of one task: the round, the partition, a count."""

    def __init__(self, level: int):
        self.next = (level << 56) + (TaskContext.get().partitionId() << 32)

    def take(self, n: int) -> int:
        self.next += n
        return self.next - n


def _pieces(part: pa.RecordBatch, data: np.ndarray, offsets: np.ndarray, encoder, end_id: int, room: int) -> _Bins:
    """The pieces of a slice of texts."""
    flat, counts = encoder.ids(data, offsets)
    lengths = counts + 1
    ends = np.cumsum(lengths)
    ids = np.full(int(ends[-1]), end_id, dtype="<u4")
    own = np.ones(len(ids), dtype=bool)
    own[ends - 1] = False
    ids[own] = flat
    cuts = -(-lengths // room)
    doc = np.repeat(np.arange(len(lengths)), cuts)
    piece = np.arange(len(doc)) - np.repeat(np.cumsum(cuts) - cuts, cuts)
    start = piece * room
    length = np.minimum(lengths[doc] - start, room)
    begin = ((ends - lengths)[doc] + start) * 4
    raw = memoryview(ids.tobytes())
    crc = np.array([zlib.crc32(raw[a:b]) for a, b in zip(begin.tolist(), (begin + length * 4).tolist(), strict=True)], dtype=np.int64)
    name = part.column(0)
    return _Bins.of([np.asarray(name.fill_null(0))[doc], piece.astype(np.int32), start, length, crc], np.asarray(name.is_valid())[doc])


def pack(docs: DataFrame, tokenizer_path: str, end_id: int, room: int = 4096) -> DataFrame:
    """(sequence_id, size, members) of docs(doc_id, text): sequences of at most `room` tokens with their pieces in order of offset."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from .word_pieces import encoder

        tokenizer, numbers, parts, waiting = encoder(tokenizer_path), _Numbers(0), [], 0
        for batch in batches:
            for part, data, offsets in text_slices(batch, "text"):
                parts.append(_pieces(part, data, offsets, tokenizer, end_id, room))
                waiting += len(parts[-1].sizes)
                if waiting >= CHUNK:
                    bins = _Bins.joined(parts).packed(room)
                    full = bins.sizes >= room - SLACK
                    if (~full).sum() > CARRIED:
                        full[:] = True
                    yield from bins.taken(np.flatnonzero(full)).rows(numbers.take(int(full.sum())))
                    parts, waiting = [bins.taken(np.flatnonzero(~full))], int((~full).sum())
        if waiting:
            bins = _Bins.joined(parts).packed(room)
            yield from bins.rows(numbers.take(len(bins.sizes)))

    def merge(level: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            numbers = _Numbers(level)
            parts = [_Bins.read(b) for b in batches if b.num_rows]
            if parts:
                bins = _Bins.joined(parts).packed(room)
                yield from bins.rows(numbers.take(len(bins.sizes)))

        return run

    done = []
    fresh = cut(docs.mapInArrow(scan, SCHEMA), "packing-0")
    level, before = 0, None
    while True:
        full = F.col("size") >= room - SLACK
        done.append(fresh.where(full))
        left = fresh.where(~full)
        bins, members, smallest = left.agg(F.count("*"), F.coalesce(F.sum(F.size("members")), F.lit(0)), F.min("size")).first()
        tasks = max(1, -(-bins // MERGE), -(-members // MEMBERS))
        # a bin can only go into one whose room is the smallest bin's size at least
        if bins < 2 or 2 * smallest > room or (before is not None and (before[1] == 1 or bins > GAIN * before[0])):
            done.append(left)
            return reduce(DataFrame.unionByName, done)
        level, before = level + 1, (bins, tasks)
        fresh = cut(left.repartition(tasks).mapInArrow(merge(level), SCHEMA), f"packing-{level}")


def pieces(sequences: DataFrame) -> DataFrame:
    """pack()'s rows as one row a piece: (doc_id, piece, start, length, ids_crc32, sequence_id, offset)."""
    return sequences.select("sequence_id", F.explode("members").alias("m")).select("m.doc_id", "m.piece", "m.start", "m.length", "m.ids_crc32", "sequence_id", "m.offset")
