"""N-gram Jaccard join by the universe-partition pigeonhole.

Each document is the set of its distinct word shingles, as 64-bit hashes of whole words. Two sets of a size band whose Jaccard similarity reaches the threshold
differ in at most H elements. A second hash deals the universe into segments; a plan of `exact` segments and `near` segments with exact + 2 * near > H + spare leaves more than `spare` exact
segments on which both sets agree (a near segment on which they differ in one element at most counts as two). A set with at most `spare` empty exact segments leaves these out, as many sets agree on them. So a set is indexed by its subset in each exact segment, and
by its subset and that subset's one-deletion neighbourhood in each near segment. The plan of a band is the cheapest by a cost of index keys and
expected chance meetings, given the number of sets. Candidates are verified on the whole sets, so the result is exact (up to equal 64-bit hashes of unequal shingles).

Cases: null, empty or blank texts have the empty set and link with nothing; texts with fewer words than a shingle have one shingle, the whole sequence; equal sets always link;
repeated rows and repeated ids each get a row; a null id links with nothing on its own account but gets the component of its equals, or null; other columns, whatever their names, are ignored unless asked for in `carry`.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _words as W
from ._linking import link
from ._shared import Scope, cut, discard, release, text_slices

_U = np.uint64
#: Sizes of one band lie within this ratio.
BAND_RATIO = 1.4
#: The chance that the cost model gives two unrelated sets to agree on an element.
CHANCE = 0.05
PARITY_SALT = _U(0x8BB84B93962EACC9)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, words: int) -> list[np.ndarray]:
    """For each text the sorted distinct hashes of its shingles of so many words."""
    low = W.LOWER[data]
    starts, ends, first = W.spans(low, offsets)
    h = W.hashes(low, starts, ends)
    rolled = h.copy()
    for k in range(1, words):
        rolled[: len(h) - k] = W.mix(rolled[: len(h) - k] * _U(0x9FB21C651E98DF25) + h[k:]) if len(h) > k else rolled[: len(h) - k]
    out = []
    for i in range(len(offsets) - 1):
        a, b = first[i], first[i + 1]
        if b - a >= words:
            out.append(np.unique(rolled[a : b - words + 1]))
        elif b > a:
            x = h[a : a + 1].copy()
            for k in range(1, b - a):
                x = W.mix(x * _U(0x9FB21C651E98DF25) + h[a + k])
            out.append(x ^ _U(b - a))
        else:
            out.append(h[:0])
    return out


def bands(n: int, threshold: int) -> list[tuple[int, int]]:
    """The size bands, as (lowest, highest) size, in which a set of n elements is indexed: its own, and the next if a larger partner may lie there."""
    lo = _band_of(n)
    own = (lo, max(lo, math.ceil(lo * BAND_RATIO) - 1))
    after = own[1] + 1
    return [own] if 100 * n < threshold * after else [own, (after, max(after, math.ceil(after * BAND_RATIO) - 1))]


@lru_cache(None)
def _starts() -> np.ndarray:
    out, lo = [], 1
    while lo < 2**40:
        out.append(lo)
        lo = max(lo, math.ceil(lo * BAND_RATIO) - 1) + 1
    return np.array(out)


def _band_of(n: int) -> int:
    s = _starts()
    return int(s[np.searchsorted(s, n, side="right") - 1])


@lru_cache(None)
def plan(hi: int, threshold: int, sets: int) -> tuple[int, int, int]:
    """(exact, near, spare) segments for sets of at most hi elements, the cheapest of those with exact + 2 * near > H + spare.

    Cost of a set: its keys, and the chance meetings expected if unrelated sets of the band share each element of a segment with chance CHANCE, in units of a key."""
    most = (100 - threshold) * 2 * hi // (100 + threshold)
    best = None
    for near in sorted({0, 1, 2, 3, (most + 2) // 2, *((most + 2) * k // 16 for k in range(1, 8))}):
        bare = max(0, most + 1 - 2 * near)
        spare = 1 + bare // 12 if bare > 1 else 0  # about the empty segments of a set at the low end of its band
        exact = bare + spare
        if near > (most + 2) // 2 or exact + near == 0:
            continue
        per = hi / (exact + near)
        meet = sets * CHANCE**per
        cost = exact * (1 + meet) + near * (1 + per) * (1 + meet / CHANCE)
        if best is None or cost < best[0]:
            best = (cost, exact, near, spare)
    return best[1:]


def keys(elements: np.ndarray, threshold: int, sets: int) -> np.ndarray:
    """The index keys of a set, as 64-bit values."""
    n, out = len(elements), []
    if not n:
        return elements
    mixed = W.mix(elements)
    place = mixed >> _U(32)
    for lo, hi in bands(n, threshold):
        exact, near, spare = plan(hi, threshold, sets)
        m = exact + near
        segment = ((place * _U(m)) >> _U(32)).astype(np.int64)
        value = W.mix(elements + _U(0x5851F42D4C957F2D))
        subset = np.zeros(m, dtype=np.uint64)
        np.add.at(subset, segment, value)  # the sum of spread hashes stands for the subset
        salt = W.mix(np.arange(m, dtype=np.uint64) + _U(lo * 0x632BE59BD9B4E019 % 2**64))
        empty = np.bincount(segment, minlength=m) == 0
        empty[exact:] = False
        use = ~empty if empty.sum() <= spare else slice(None)
        out.append(W.mix(subset ^ salt)[use])
        if near:
            last = segment >= exact
            out.append(W.mix((subset[segment[last]] - value[last]) ^ salt[segment[last]]))
    return np.unique(np.concatenate(out))


def index(docs: DataFrame, words: int, threshold: int, sets: int) -> DataFrame:
    """(doc_id, n, f1, f2, keys): size, fingerprint and index keys of each document's set."""

    def run(batches):
        for batch in batches:
            for part, data, offsets in text_slices(batch, "text"):
                found = shingle_sets(data, offsets, words)
                sums = [(int(x.sum()) if len(x) else 0, int(W.mix(x ^ _U(0xA0761D6478BD642F)).sum()) if len(x) else 0) for x in found]
                k = [keys(x, threshold, sets) for x in found]
                ends = np.concatenate([[0], np.cumsum([len(x) for x in k])]).astype(np.int32)
                flat = np.concatenate(k).view(np.int64) if k else np.zeros(0, np.int64)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0).cast(pa.int64()),
                        pa.array([len(x) for x in found], pa.int64()),
                        pa.array(np.array([s[0] for s in sums], dtype=np.uint64).view(np.int64)),
                        pa.array(np.array([s[1] for s in sums], dtype=np.uint64).view(np.int64)),
                        pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.int64())),
                    ],
                    ["doc_id", "n", "f1", "f2", "keys"],
                )

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n long, f1 long, f2 long, keys array<long>")


def parity(elements: np.ndarray) -> bytes:
    """A bit for each place of a power of two of places, two to four times the set's size: whether an odd number of elements lies there. Two sets differ in at least as many elements as
    their parities do in bits, and a parity folds to half its length by xor."""
    size = 64
    while size < 2 * len(elements):
        size *= 2
    return np.packbits(np.bincount((W.mix(elements ^ PARITY_SALT) & _U(size - 1)).astype(np.int64), minlength=size) & 1).tobytes()


def apart(one: bytes, two: bytes) -> int:
    """A lower bound on the elements in which two sets differ, from their parities."""
    x, y = np.frombuffer(one, np.uint8), np.frombuffer(two, np.uint8)
    while len(x) > len(y):
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    while len(y) > len(x):
        y = y[: len(y) // 2] ^ y[len(y) // 2 :]
    return int(np.bitwise_count(x ^ y).sum())


def sets_of(docs: DataFrame, words: int) -> DataFrame:
    """(doc_id, n, parity, elements): the sets themselves, for verification."""

    def run(batches):
        for batch in batches:
            for part, data, offsets in text_slices(batch, "text"):
                found = shingle_sets(data, offsets, words)
                ends = np.concatenate([[0], np.cumsum([len(x) for x in found])]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(found).view(np.int64), pa.int64()))
                yield pa.RecordBatch.from_arrays([part.column(0).cast(pa.int64()), pa.array(np.diff(ends).astype(np.int64)), pa.array([parity(x) for x in found], pa.binary()), lists], ["doc_id", "n", "parity", "elements"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n long, parity binary, elements array<long>")


def _may_link(threshold: int):
    """Leaves pairs(a, b, na, nb, one, two) whose parities do not rule the threshold out."""

    def run(batches):
        for batch in batches:
            a, b, na, nb, one, two = (c.to_pylist() for c in batch.columns)
            keep = [(100 + threshold) * apart(x, y) <= (100 - threshold) * (n + m) for n, m, x, y in zip(na, nb, one, two, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def _shared(batches):
    for batch in batches:
        one, two = batch.column(2), batch.column(3)
        inter = [len(np.intersect1d(one[i].values.to_numpy(), two[i].values.to_numpy(), assume_unique=True)) for i in range(batch.num_rows)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([len(x.values) for x in one], pa.int64()), pa.array([len(x.values) for x in two], pa.int64()), pa.array(inter, pa.int64())], ["a", "b", "na", "nb", "shared"])


def jaccard_components(docs: DataFrame, words: int = 5, threshold: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id) for each row of docs(doc_id, text): documents link when 100 * shared >= threshold * united.

    Equal sets are one class with its smallest id as representative before anything is joined, so copies meet no bucket."""
    with Scope(docs.sparkSession) as scope:
        return scope.keep(_components(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), words, threshold))


def _components(docs: DataFrame, words: int, threshold: int) -> DataFrame:
    total = max(1, docs.count())
    indexed = cut(index(docs, words, threshold, total), "jaccard-index")
    rows = cut(indexed.drop("keys"), "jaccard-rows")
    whole = indexed.where("n > 0 and doc_id is not null")
    classes = cut(whole.groupBy("f1", "f2", "n").agg(F.min(F.struct("doc_id", "keys")).alias("least")).select("f1", "f2", "n", F.col("least.doc_id").alias("id"), "least.keys"), "jaccard-classes")
    discard(indexed)
    release(docs.sparkSession)
    members = classes.select(F.explode("keys").alias("key"), "id")
    slim = cut(classes.drop("keys"), "jaccard-slim")

    sets: list[DataFrame] = []

    def ready(ids: DataFrame) -> None:
        discard(classes)  # the buckets are written
        sets.append(cut(sets_of(docs.join(ids.select(F.col("id").alias("doc_id")), "doc_id", "left_semi"), words).withColumnRenamed("doc_id", "id"), "jaccard-sets"))

    def verify(pairs: DataFrame) -> DataFrame:
        side = lambda mark, *columns: sets[0].select(F.col("id").alias(mark), *[F.col(c).alias(x) for c, x in columns])
        both = pairs.join(side("a", ("n", "na"), ("parity", "one")), "a").join(side("b", ("n", "nb"), ("parity", "two")), "b")
        pairs = cut(both.select("a", "b", "na", "nb", "one", "two").mapInArrow(_may_link(threshold), "a long, b long"), "jaccard-pairs")
        both = pairs.join(side("a", ("elements", "one")), "a").join(side("b", ("elements", "two")), "b")
        held = both.select("a", "b", "one", "two").mapInArrow(_shared, "a long, b long, na long, nb long, shared long")
        return held.where(f"100 * shared >= {threshold} * (na + nb - shared)").select("a", "b").distinct()

    def rest(left: DataFrame) -> DataFrame:
        # Sets of two components that link share at least `least` elements, so, with all elements in one order, one of the first n - least + 1 of each. The order is by the number of sets that
        # hold an element, those that no other component holds first; so the sets of a large family of copies that are too far apart do not meet.
        homes = sets[0].join(left, "id")
        across = homes.select("c", F.explode("elements").alias("e")).groupBy("e").agg(F.min("c").alias("lo"), F.max("c").alias("hi"), F.count("*").alias("df")).where("lo < hi").select("e", "df")
        across = cut(across, "jaccard-across")
        release(docs.sparkSession)
        near = homes.select("id", F.explode("elements").alias("e")).join(across, "e").groupBy("id").agg(F.array_sort(F.collect_list(F.struct("df", "e"))).alias("s"))  # at most a set's own elements
        near = near.join(homes.select("id", "c", F.col("n").cast("int").alias("n")), "id").withColumn("u", F.col("n") - F.size("s"))
        near = near.withColumn("k", F.expr(f"cast(floor((100 - {threshold}) * n / 100) as int) + 1 - u")).where("k > 0")
        first = cut(near.select("id", "c", "n", "u", F.posexplode(F.slice("s", 1, F.col("k"))).alias("at", "x")).select("id", "c", "n", F.col("x.e").alias("e"), (F.col("u") + F.col("at")).alias("at")), "jaccard-prefixes")
        release(docs.sparkSession)
        x, y = (first.select("e", *[F.col(c).alias(mark + c) for c in ("id", "c", "n", "at")]) for mark in ("x_", "y_"))
        least = f"cast(ceil({threshold} * (x_n + y_n) / {100 + threshold}) as int)"
        met = x.join(y, "e").where(f"x_id < y_id and x_c <> y_c and 100 * least(x_n, y_n) >= {threshold} * greatest(x_n, y_n) and x_at <= x_n - {least} and y_at <= y_n - {least}")
        return met.select(F.col("x_id").alias("a"), F.col("y_id").alias("b")).distinct()

    keep = f"100 * least(x_n, y_n) >= {threshold} * greatest(x_n, y_n)"
    _, found = link(members, slim.select("id", "n"), verify, "jaccard", keep=keep, ready=ready, rest=rest)
    named = slim.join(found.withColumnRenamed("node", "id"), "id", "left").select("f1", "f2", "n", F.coalesce("component", "id").alias("component"))
    # empty sets, which may be very many, are no key of a join; other equal sets that are many are split by Spark where they skew it
    out = rows.where("n > 0").join(named, ["f1", "f2", "n"], "left").select("doc_id", "n", "component").unionByName(rows.where("n = 0").select("doc_id", "n", F.lit(None).cast("long").alias("component")))
    return cut(out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id")), "jaccard-components")
