"""Benchmark decontamination: passages of documents within a bounded edit distance of a benchmark item.

Texts are words: runs of ASCII letters, digits and non-ASCII bytes, A-Z lower-cased. An item of L words leaks into a document if some passage is within floor((1 - similarity) * L) word edits of it.

CGK embedding: a random walk reads a word sequence, writing the current word at each step and moving on if a random bit of (step, word) says so; sequences at a small edit distance get embeddings at a
small Hamming distance. Each of a length band's walks has its own bits, and samples `bits` places of the embedding as a key; windows of item size meet items by these keys. A band has as many walks as
trials with the most edits allowed, at the places that cost most, need to reach the recall asked for. Windows begin at every word from 2d + 1 before to the first of a run of shared word pairs: a passage with d
edits keeps at least L - 1 - 2d of the item's pairs, so runs with fewer are left out without loss, and the first kept pair lies at most 2d words behind its begin; one more word, and words before a text's
begin, are read as nothing. Each candidate is verified by the exact edit distance (bit-parallel). Walks are as long as the shortest item of a length band allows, so a window needs no end.

Distinct benchmark texts reach each worker in blocks of at most BLOCK_BYTES, or one text; a larger benchmark is taken in several passes. A document is handled by itself, so no key, source or copy is hot.

Cases: null and empty texts, and items without words, match nothing; items of so few words that no edit is allowed match exactly only; whole documents are read, however long; repeated items and rows each count;
an item that occurs several times in a document gives one row, its nearest passage and then its first; a null id is kept; other columns are left out.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _words as W
from ._shared import text_slices

_U = np.uint64
BLOCK_BYTES = 16 << 20
#: Windows times walks that are followed at once.
WINDOW_CELLS = 1 << 17
BAND_RATIO = 1.25
#: Recall of items with the most edits allowed for which the number of walks is chosen, and the trials that it is chosen by.
RECALL, TRIALS, WALKS_TRIED = 0.98, 12, 96
#: What separates words: ASCII that is neither letter nor digit.
APART = np.ones(256, dtype=bool)
APART[48:58] = APART[65:91] = APART[97:123] = APART[128:] = False


def words_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    low = W.LOWER[data]
    starts, ends, first = W.spans(low, offsets, APART)
    return W.hashes(low, starts, ends), first, starts, ends


@dataclass
class Band:
    need: int  # word pairs that a passage keeps at least
    edits: int
    reach: int  # words of the longest passage
    walks: Walks
    keys: np.ndarray  # sorted
    owners: np.ndarray  # item of each key


@dataclass
class Walks:
    seeds: np.ndarray  # steps x repeats
    read: list[np.ndarray]  # the repeats that sample each step


@dataclass
class Block:
    ids: list
    items: list[np.ndarray]
    own: list[np.ndarray]  # word pairs of each item, sorted
    edits: list[int]
    pairs: np.ndarray  # sorted
    bands: list[Band]
    singles: dict[int, list[int]]
    filter_: np.ndarray


def edits_of(words: int, similarity: float) -> int:
    return int((1 - similarity) * words + 1e-9)


def walks(low: int, repeats: int, bits: int) -> Walks:
    rng = np.random.default_rng([20240502, low])
    steps = max(bits, int(1.5 * low)) if low > 3 else low
    seeds = rng.integers(0, 2**63, size=(steps, repeats), dtype=np.uint64)
    places = np.array([rng.choice(steps, size=min(bits, steps), replace=False) for _ in range(repeats)]).reshape(repeats, -1)
    return Walks(seeds, [np.flatnonzero((places == j).any(axis=1)) for j in range(steps)])


def keys_of(words: np.ndarray, begin: np.ndarray, low: np.ndarray, end: np.ndarray, w: Walks) -> np.ndarray:
    """windows x repeats keys: the words at each walk's sampled steps. Windows of a word array begin anywhere; outside low to end they read zeros."""
    repeats = w.seeds.shape[1]
    at = np.repeat(begin[:, None], repeats, axis=1)
    key = np.repeat(np.arange(1, repeats + 1, dtype=np.uint64)[None, :] * _U(0xD1B54A32D192ED03), len(begin), axis=0)
    padded, low, stop = np.append(words, _U(0)), low[:, None], end[:, None]
    for seed, read in zip(w.seeds, w.read, strict=True):
        now = padded[np.where((at >= low) & (at < stop), at, len(words))]
        if len(read):
            key[:, read] = W.mix(key[:, read] ^ now[:, read])
        at += ((((now ^ seed) * _U(0x9E3779B97F4A7C15)) >> _U(57)) & _U(1)).astype(np.int64)
    return key


@lru_cache(None)
def repeats_for(low: int, high: int, similarity: float, bits: int, recall: float) -> int:
    """Walks that find an item of `high` words with all its edits, spread evenly or at its begin, in at least so many of all cases: by the share of walks that find it in trials with random words."""
    d = edits_of(high, similarity)
    if not d:
        return 1
    rng = np.random.default_rng([7, low, high])
    w = walks(low, WALKS_TRIED, bits)
    hit = []
    for trial in range(2 * TRIALS):
        words = rng.integers(1, 2**63, high + 2 * (2 * d + 2), dtype=np.uint64)
        begin = 2 * d + 2
        item = words[begin : begin + high].copy()
        changed = begin + (np.arange(d) * high // d if trial % 2 else np.arange(d))
        words[changed] = rng.integers(1, 2**63, d, dtype=np.uint64)
        want = keys_of(item, np.array([0]), np.array([0]), np.array([high]), w)
        starts = np.arange(begin + d + 2)
        got = keys_of(words, starts, np.zeros_like(starts), np.full_like(starts, len(words)), w)
        hit.append((got == want).any(axis=0).mean())
    # one of the hit shares for each way of editing; the harder one counts
    share = min(np.mean(hit[::2]), np.mean(hit[1::2]))
    return int(np.ceil(np.log(1 - recall) / np.log(1 - min(0.99, max(share, 0.005)))))


def build(ids: list, texts: list[str], similarity: float, bits: int, recall: float) -> Block:
    items, kept = [], []
    for i, t in zip(ids, texts, strict=True):
        data = np.frombuffer((t or "").encode(), dtype=np.uint8)
        h = words_of(data, np.array([0, len(data)]))[0]
        if len(h):
            items.append(h)
            kept.append(i)
    own = [np.unique(pair_hashes(h)) for h in items]
    pairs = np.unique(np.concatenate(own)) if items else np.zeros(0, np.uint64)
    bands, lengths = [], np.array([len(h) for h in items])
    singles: dict[int, list[int]] = {}
    for i in np.flatnonzero(lengths == 1).tolist():
        singles.setdefault(int(items[i][0]), []).append(i)
    low = 2
    while len(items) and low <= lengths.max():
        high = max(low, int(low * BAND_RATIO))
        inside = np.flatnonzero((lengths >= low) & (lengths <= high))
        if len(inside):
            d = edits_of(high, similarity)
            need = min(int(n) - 1 - 2 * edits_of(int(n), similarity) for n in lengths[inside])
            w = walks(low, repeats_for(low, high, similarity, bits, recall), bits)
            flat = np.concatenate([items[i] for i in inside])
            ends = np.cumsum(lengths[inside])
            keys = keys_of(flat, ends - lengths[inside], ends - lengths[inside], ends, w)
            owners = np.repeat(inside, keys.shape[1])
            order = np.argsort(keys.ravel(), kind="stable")
            bands.append(Band(need, d, high + d, w, keys.ravel()[order], owners[order]))
        low = high + 1
    filter_ = np.zeros(1 << 22, dtype=bool)
    filter_[pairs >> _U(42)] = True
    return Block(kept, items, own, [edits_of(len(h), similarity) for h in items], pairs, bands, singles, filter_)


def pair_hashes(h: np.ndarray) -> np.ndarray:
    """Hashes of neighbouring words; of a single word, itself."""
    if len(h) == 1:
        return W.mix(h ^ _U(0xA5A5A5A5A5A5A5A5))
    return W.mix(h[:-1] * _U(0x9FB21C651E98DF25) + h[1:])


def infix_distance(item: np.ndarray, text: np.ndarray) -> tuple[int, int]:
    """The least edit distance of item to any passage of text, and where the first such passage ends. One machine word a step (Myers)."""
    n = len(item)
    masks: dict[int, int] = {}
    for i, x in enumerate(item.tolist()):
        masks[x] = masks.get(x, 0) | 1 << i
    full, top = (1 << n) - 1, 1 << (n - 1)
    up, down, score = full, 0, n
    best, where = n, 0
    for j, x in enumerate(text.tolist()):
        eq = masks.get(x, 0)
        d = (((eq & up) + up) ^ up) | eq | down
        hp, hn = down | (full & ~(d | up)), up & d
        if hp & top:
            score += 1
        if hn & top:
            score -= 1
        hp, hn = (hp << 1) & full, (hn << 1) & full  # a passage may begin anywhere
        up, down = hn | (full & ~(d | hp)), hp & d
        if score < best:
            best, where = score, j + 1
    return best, where


def matches(block: Block, data: np.ndarray, offsets: np.ndarray) -> list[tuple[int, int, int, int, int]]:
    """(text, item, edits, first byte, last byte) of all leaks into the texts."""
    h, first, starts, ends = words_of(data, offsets)
    if not len(h) or not block.items:
        return []
    owner = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
    pair = np.zeros(len(h), dtype=np.uint64)
    pair[:-1] = W.mix(h[:-1] * _U(0x9FB21C651E98DF25) + h[1:])
    same = np.zeros(len(h), dtype=bool)
    same[:-1] = owner[1:] == owner[:-1]
    maybe = np.flatnonzero(block.filter_[pair >> _U(42)] & same)
    at = np.minimum(np.searchsorted(block.pairs, pair[maybe]), len(block.pairs) - 1)
    hits = maybe[block.pairs[at] == pair[maybe]]
    candidates: dict[tuple[int, int], list[int]] = {}
    if block.singles:
        for p in np.flatnonzero(np.isin(h, np.array(list(block.singles), dtype=np.uint64))).tolist():
            for i in block.singles[int(h[p])]:
                candidates.setdefault((int(owner[p]), i), []).append(p)
    for band in block.bands:
        if band.need > 0:
            limit = np.minimum(hits + band.reach, first[owner[hits] + 1])
            seen = hits[np.searchsorted(hits, limit) - np.arange(len(hits)) >= band.need]
        else:  # nothing can be left out
            seen = np.arange(len(h))
        if not len(seen):
            continue
        back = 2 * band.edits + 1 if band.edits else 0
        place = (owner[seen].astype(np.int64)[:, None] << 40) + (seen[:, None] - np.arange(back + 1)[None, :] + back)
        place = np.unique(place)
        text, begin = place >> 40, (place & ((1 << 40) - 1)) - back
        step = max(1, WINDOW_CELLS // band.walks.seeds.shape[1])
        for k in range(0, len(begin), step):
            b, t = begin[k : k + step], text[k : k + step]
            keys = keys_of(h, b, first[t], first[t + 1], band.walks)
            left = np.searchsorted(band.keys, keys, side="left")
            there = band.keys[np.minimum(left, len(band.keys) - 1)] == keys
            for row, col in np.argwhere(there).tolist():
                stop = int(np.searchsorted(band.keys, keys[row, col], side="right"))
                for item in set(band.owners[left[row, col] : stop].tolist()):
                    candidates.setdefault((int(t[row]), item), []).append(int(b[row]))
    out = []
    for (text, item), places in candidates.items():
        words, d = block.items[item], block.edits[item]
        n, best = len(words), None
        places = sorted(set(places))
        k = 0
        while k < len(places):  # places whose reaches overlap are one region
            last = k
            while last + 1 < len(places) and places[last + 1] - places[last] <= n + d:
                last += 1
            a, b = max(int(first[text]), places[k] - d - 3), min(int(first[text + 1]), places[last] + n + 3 * d + 4)
            k = last + 1
            if n > 1 and np.isin(pair[a : b - 1], block.own[item]).sum() < n - 1 - 2 * d:
                continue
            edits, stop = infix_distance(words, h[a:b])
            if edits <= d and (best is None or edits < best[0]):
                back, length = infix_distance(words[::-1], h[a : a + stop][::-1][: n + d])
                best = (edits, a + stop - max(length, 1), a + stop - 1)
        if best:
            out.append((text, item, best[0], int(starts[best[1]] - offsets[text]), int(ends[best[2]] - offsets[text])))
    return out


@lru_cache(2)
def _built(key: bytes, similarity: float, bits: int, recall: float) -> Block:
    import pickle

    return build(*pickle.loads(key), similarity, bits, recall)


def text_blocks(benchmark: DataFrame) -> tuple[DataFrame, int]:
    """(key, text, block) of the distinct texts, and the number of blocks, none of which holds more than BLOCK_BYTES or one text."""
    texts = benchmark.where("text is not null").select("text").distinct().withColumn("key", F.md5("text"))
    blocks = 1
    while True:
        dealt = texts.withColumn("block", F.pmod(F.xxhash64("text"), F.lit(blocks)))
        size = dealt.groupBy("block").agg(F.sum(F.octet_length("text")).alias("bytes"), F.count("*").alias("n")).agg(F.max(F.when(F.col("n") > 1, F.col("bytes"))), F.sum("bytes")).first()
        if (size[0] or 0) <= BLOCK_BYTES:
            return dealt, blocks
        blocks = max(2 * blocks, 2 * size[1] // BLOCK_BYTES)


def leaks(docs: DataFrame, benchmark: DataFrame, similarity: float = 0.8, bits: int = 2, recall: float = RECALL) -> DataFrame:
    """(doc_id, item_id, edits, similarity, start, end): one row for each document and item that leaks into it, with the bytes of the nearest passage."""
    import pickle

    spark = docs.sparkSession
    dealt, blocks = text_blocks(benchmark)
    parts = []
    for k in range(blocks):
        rows = dealt.where(F.col("block") == k).select("key", "text").orderBy("key").collect()  # checked: BLOCK_BYTES, or one text
        shared = spark.sparkContext.broadcast(pickle.dumps(([r[0] for r in rows], [r[1] for r in rows])))

        def run(batches, shared=shared):
            block = _built(shared.value, similarity, bits, recall)
            for batch in batches:
                for part, data, offsets in text_slices(batch, "text"):
                    found = matches(block, data, offsets)
                    if found:
                        take = pa.array([f[0] for f in found])
                        yield pa.RecordBatch.from_arrays(
                            [
                                part.column(0).take(take).cast(pa.int64()),
                                pa.array([block.ids[f[1]] for f in found], pa.string()),
                                pa.array([f[2] for f in found], pa.int64()),
                                pa.array([1 - f[2] / len(block.items[f[1]]) for f in found], pa.float64()),
                                pa.array([f[3] for f in found], pa.int64()),
                                pa.array([f[4] for f in found], pa.int64()),
                            ],
                            ["doc_id", "key", "edits", "similarity", "start", "end"],
                        )

        parts.append(docs.select("doc_id", "text").mapInArrow(run, "doc_id long, key string, edits long, similarity double, start long, end long"))
    named = benchmark.where("text is not null").select(F.md5("text").alias("key"), F.col("item_id").cast("long").alias("item_id"))
    return reduce(DataFrame.unionByName, parts).join(named, "key").select("doc_id", "item_id", "edits", "similarity", "start", "end")
