"""A cache of encoded pieces that is looked up for a whole slice of texts at once.

Open addressing over 64-bit hashes of the pieces' bytes; a hit must also agree in length and in all of its bytes, so pieces of equal hashes are told apart. Only pieces that are not there yet reach Python.
At `most` pieces, or when their bytes reach MOST_BYTES, the table starts afresh, so memory is bounded.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

from . import _words as W
from .pretokens import boundaries

_U = np.uint64
_KEEP = np.array([(1 << 8 * k) - 1 for k in range(9)], dtype=np.uint64)
#: Bytes of pieces of more than eight bytes that a table keeps.
MOST_BYTES = 16 << 20


class PieceTable:
    def __init__(self, encode: Callable[[list[bytes]], list[np.ndarray]], kind, most: int = 400_000):
        self.encode, self.kind, self.most = encode, np.dtype(kind), most
        self.slots = 1 << (2 * most - 1).bit_length()
        self.reset()

    def reset(self) -> None:
        self.hash = np.zeros(self.slots, dtype=np.uint64)
        self.row = np.zeros(self.slots, dtype=np.int32)
        self.head, self.size, self.start, self.count = np.zeros(1024, np.uint64), np.zeros(1024, np.int32), np.zeros(1024, np.int64), np.zeros(1024, np.int32)
        self.pool, self.rows, self.used = np.zeros(4096, dtype=self.kind), 0, 0
        self.raw, self.raw_used, self.raw_start = np.zeros(4096, np.uint8), 0, np.zeros(1024, np.int64)

    def _equal(self, row: np.ndarray, size: np.ndarray, start: np.ndarray, data: np.ndarray, words: np.ndarray) -> np.ndarray:
        """Whether pieces that lie in data at start are those of the rows, from their ninth byte on."""
        out = np.ones(len(row), dtype=bool)
        at = np.flatnonzero(size > 8)
        if not len(at):
            return out
        kept = np.ndarray(len(self.raw) - 7, "<u8", self.raw, strides=(1,))
        for j in range(8, W.LONG, 8):
            at = at[out[at] & (size[at] > j)]
            if not len(at):
                return out
            keep = _KEEP[np.minimum(size[at] - j, 8)]
            out[at] = (words[start[at] + j] & keep) == (kept[self.raw_start[row[at]] + j] & keep)
        for i in at[out[at] & (size[at] > W.LONG)].tolist():
            a, b, n = int(start[i]), int(self.raw_start[row[i]]), int(size[i])
            out[i] = np.array_equal(data[a : a + n], self.raw[b : b + n])
        return out

    def _find(self, h: np.ndarray, head: np.ndarray, size: np.ndarray, start: np.ndarray, data: np.ndarray, words: np.ndarray) -> np.ndarray:
        """The row of each piece, -1 for unknown ones."""
        mask = _U(self.slots - 1)
        out = np.full(len(h), -1, dtype=np.int64)
        todo, slot = np.arange(len(h)), (h & mask).astype(np.int64)
        while len(todo):
            there = self.hash[slot]
            row = self.row[slot]
            same = (there == h[todo]) & (self.head[row] == head[todo]) & (self.size[row] == size[todo])
            at = np.flatnonzero(same)
            same[at] = self._equal(row[at], size[todo[at]], start[todo[at]], data, words)
            out[todo[same]] = row[same]
            go = ~same & (there != 0)
            todo, slot = todo[go], (slot[go] + 1) & (self.slots - 1)
        return out

    def _add(self, h: np.ndarray, head: np.ndarray, size: np.ndarray, pieces: list[bytes]) -> None:
        n, ids = len(h), self.encode(pieces)
        for name in ("head", "size", "start", "count", "raw_start"):
            have = getattr(self, name)
            if self.rows + n > len(have):
                setattr(self, name, np.concatenate([have, np.zeros(max(n, len(have) // 2), have.dtype)]))
        flat = np.concatenate(ids).astype(self.kind)
        if self.used + len(flat) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros(max(len(flat), len(self.pool) // 2), self.kind)])
        counts = np.array([len(x) for x in ids], dtype=np.int32)
        at = slice(self.rows, self.rows + n)
        self.head[at], self.size[at], self.count[at] = head, size, counts
        self.start[at] = self.used + np.cumsum(counts) - counts
        long = [p if len(p) > 8 else b"" for p in pieces]
        sizes = np.array([len(p) for p in long], dtype=np.int64)
        self.raw_start[at] = self.raw_used + np.cumsum(sizes) - sizes
        fresh = np.frombuffer(b"".join(long), np.uint8)
        if self.raw_used + len(fresh) + 8 > len(self.raw):
            self.raw = np.concatenate([self.raw, np.zeros(max(len(fresh) + 8, len(self.raw) // 2), np.uint8)])
        self.raw[self.raw_used : self.raw_used + len(fresh)] = fresh
        self.raw_used += len(fresh)
        self.pool[self.used : self.used + len(flat)] = flat
        rows = np.arange(self.rows, self.rows + n, dtype=np.int32)
        self.rows, self.used = self.rows + n, self.used + len(flat)
        todo, slot = np.arange(n), (h & _U(self.slots - 1)).astype(np.int64)
        while len(todo):  # those that find an empty slot try to take it; the last to write one has it
            empty = self.hash[slot] == 0
            taken, place = todo[empty], slot[empty]
            self.row[place] = rows[taken]
            self.hash[place] = h[taken]
            won = np.zeros(len(todo), dtype=bool)
            won[empty] = self.row[place] == rows[taken]
            todo, slot = todo[~won], (slot[~won] + 1) & (self.slots - 1)

    def pieces(self, data: np.ndarray, raw: bytes, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts and ends, in bytes, of the pieces of texts laid end to end."""
        codes = np.frombuffer(raw.decode().encode("utf-32-le"), dtype=np.uint32)
        leads = np.flatnonzero((data & 0xC0) != 0x80)  # the first byte of each code point
        filled = offsets[:-1][np.diff(offsets) > 0]
        starts = leads[boundaries(codes, np.searchsorted(leads, filled))]
        return starts, np.append(starts[1:], len(data))

    def ids(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of texts given by their UTF-8 bytes, laid end to end, and each text's number of ids."""
        if not len(data):
            return np.zeros(0, self.kind), np.zeros(len(offsets) - 1, np.int64)
        raw = data.tobytes()
        starts, ends = self.pieces(data, raw, offsets)
        if not len(starts):
            return np.zeros(0, self.kind), np.zeros(len(offsets) - 1, np.int64)
        size = (ends - starts).astype(np.int32)
        h = W.hashes(data, starts, ends)
        h[h == 0] = 1
        words = W.parts(data)
        head = words[starts] & _KEEP[np.minimum(size, 8)]
        if self.rows > self.most or self.raw_used > MOST_BYTES:
            self.reset()
        rows = self._find(h, head, size, starts, data, words)
        lost = np.flatnonzero(rows < 0)
        while len(lost):  # once; again where unequal pieces have one hash
            _, first = np.unique(h[lost], return_index=True)
            new = lost[first]
            if self.rows + len(new) > self.slots * 3 // 4:  # a single slice with more pieces than the table holds
                self.slots = 1 << (2 * (self.rows + len(new))).bit_length()
                self.reset()
                return self.ids(data, offsets)
            self._add(h[new], head[new], size[new], [raw[a:b] for a, b in zip(starts[new].tolist(), ends[new].tolist(), strict=True)])
            rows[lost] = self._find(h[lost], head[lost], size[lost], starts[lost], data, words)
            lost = lost[rows[lost] < 0]
        counts = self.count[rows].astype(np.int64)
        done = np.cumsum(counts)
        flat = self.pool[np.repeat(self.start[rows] - (done - counts), counts) + np.arange(int(done[-1]))]
        upto = np.concatenate([[0], done])[np.searchsorted(starts, offsets)]
        return flat, np.diff(upto)
