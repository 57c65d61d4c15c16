"""Toxicity by maximum-scoring segments.

Tokens are words and their first 6, 7 and 8 bytes. Each has a log-odds between toxic and other documents under an informative Dirichlet prior (its share in both), from the number of distinct
texts that hold it; a word scores as its most significant token, and a word without any costs DRIFT.
A linear-time scan over the words of a document finds all maximal segments of positive sum. Karlin-Altschul statistics turn a segment's sum S into an E-value
K * n * exp(-lambda * S), with lambda the root of E[exp(lambda * s)] = 1 over the words of non-toxic documents; segments with an E-value below SIGNIFICANT are toxic passages. A document's evidence
is the sum of -ln(E-value) of its significant segments, and a logistic curve over the logarithm of one more than it and over its strongest segment, fitted on the training rows, gives the score. K is the
maximum-likelihood one, given lambda, of the largest sums in the non-toxic training rows with their words shuffled.

Training rows are bounded: about `sample` labelled rows, chosen by a hash of the id, at most twice as many; the word table holds all words of these rows that count.

Cases: a null or empty text has no segment and the lowest score; whole texts are read, however long; a document labelled twice counts each time; without labels of both kinds every score is 0; repeated rows get equal results; a null id is in no fold and not held out; `score` and `segments` of the result replace columns of these names.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _words as W
from ._shared import Scope, crc_fold, cut, text_slices

#: What a word without significant lean adds to a sum.
DRIFT = -0.03
SIGNIFICANT = 1.0
#: Lengths in bytes of the word beginnings that count as tokens.
STEMS = (6, 7, 8)
#: What separates words: all ASCII but letters.
APART = np.ones(256, dtype=bool)
APART[65:91] = APART[97:123] = APART[128:] = False


@dataclass
class Model:
    words: np.ndarray  # sorted hashes
    odds: np.ndarray
    ranks: np.ndarray  # absolute z-scores
    rate: float  # lambda
    factor: float  # K
    curve: tuple[float, float, float]  # intercept, slope of the evidence, slope of the strongest segment


def words_of(data: np.ndarray, offsets: np.ndarray) -> tuple[list[np.ndarray], np.ndarray, np.ndarray, np.ndarray]:
    low = W.LOWER[data]
    starts, ends, first = W.spans(low, offsets, APART)
    return tokens(low, starts, ends), first, starts, ends


def maximal_segments(places: list[int], scores: list[float], between: float) -> list[tuple[int, int, float]]:
    """All maximal segments (first place, last place, sum) of a sequence that has `scores` at `places` and `between` (negative) elsewhere, in time linear in the places."""
    found: list[list[float]] = []  # left sum, right sum, first, last
    total, at = 0.0, 0
    for place, score in zip(places, scores, strict=True):
        total += (place - at) * between
        at = place + 1
        if score <= 0:
            total += score
            continue
        item = [total, total + score, place, place]
        total += score
        while True:
            j = len(found) - 1
            while j >= 0 and found[j][0] >= item[0]:
                j = int(found[j][4])
            if j < 0 or found[j][1] >= item[1]:
                found.append([*item, j])
                break
            item = [found[j][0], item[1], found[j][2], item[3]]
            del found[j:]
    return [(int(a), int(b), right - left) for left, right, a, b, _ in found]


def tokens(low: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> list[np.ndarray]:
    """The hashes of whole words, then of their beginnings (0 where a word is no longer than that)."""
    out = [W.hashes(low, starts, ends)]
    for n in STEMS:
        longer = ends - starts > n
        h = W.hashes(low, starts, np.minimum(ends, starts + n))
        out.append(np.where(longer, W.mix(h + np.uint64(n)), np.uint64(0)))
    return out


def _look_up(model: Model, all_tokens: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Places of the words that hold a token which the model knows, and the odds of the most significant one."""
    n = len(all_tokens[0])
    if not len(model.words) or not n:
        return np.zeros(0, np.int64), np.zeros(0)
    filter_ = model.__dict__.get("filter_")
    if filter_ is None:
        filter_ = model.__dict__["filter_"] = np.zeros(1 << 20, dtype=bool)
        filter_[model.words >> np.uint64(44)] = True
    best, odds = np.zeros(n), np.zeros(n)
    for h in all_tokens:
        maybe = np.flatnonzero(filter_[h >> np.uint64(44)])
        at = np.minimum(np.searchsorted(model.words, h[maybe]), len(model.words) - 1)
        hit = model.words[at] == h[maybe]
        maybe, at = maybe[hit], at[hit]
        better = model.ranks[at] > best[maybe]
        best[maybe[better]], odds[maybe[better]] = model.ranks[at[better]], model.odds[at[better]]
    places = np.flatnonzero(best)
    return places, odds[places]


def segments(model: Model, data: np.ndarray, offsets: np.ndarray) -> tuple[list[list[tuple[int, int, float, float]]], list[int]]:
    """For each text its significant segments: byte offsets of start and end, sum, E-value; and its number of words."""
    h, first, starts, ends = words_of(data, offsets)
    places, odds = _look_up(model, h)
    cuts = np.searchsorted(places, first)
    out: list[list[tuple[int, int, float, float]]] = []
    for i in range(len(offsets) - 1):
        a, b = cuts[i], cuts[i + 1]
        rows = []
        if a < b:
            n = int(first[i + 1] - first[i])
            for x, y, s in maximal_segments((places[a:b] - first[i]).tolist(), odds[a:b].tolist(), DRIFT):
                e = model.factor * n * np.exp(-model.rate * s)
                if e < SIGNIFICANT:
                    rows.append((int(starts[first[i] + x] - offsets[i]), int(ends[first[i] + y] - offsets[i]), float(s), float(e)))
        out.append(rows)
    return out, np.diff(first).tolist()


def evidence(model: Model, rows: list[tuple[int, int, float, float]], words: int) -> tuple[float, float]:
    """ln(1 + the sum of -ln(E-value)) over the significant segments of a text of so many words, and the largest sum."""
    total = sum(max(0.0, np.log(SIGNIFICANT) - np.log(model.factor * words) + model.rate * r[2]) for r in rows)
    return float(np.log1p(total)), max((r[2] for r in rows), default=0.0)


def fit(docs: DataFrame, labels: DataFrame, sample: int = 20_000, prior: float = 0.05) -> Model:
    """A model of docs(doc_id, text) and labels(doc_id, toxic): about `sample` labelled rows are learnt from."""
    with Scope(docs.sparkSession):
        return _fit(docs, labels, sample, prior)


def _fit(docs: DataFrame, labels: DataFrame, sample: int, prior: float) -> Model:
    known = labels.where("toxic in (0, 1) and doc_id is not null").select("doc_id", "toxic")
    total = known.count()
    place = (F.xxhash64(F.col("doc_id").cast("string"), F.lit("toxicity sample")) % 1_000_000 + 1_000_000) % 1_000_000
    # at most 2 * sample rows of two numbers: small enough to broadcast
    few = known.withColumn("place", place).where(F.col("place") < int(min(1.0, sample / max(1, total)) * 1_000_000)).orderBy("place", "doc_id", "toxic").limit(2 * sample).drop("place")
    rows = docs.select("doc_id", "text").join(F.broadcast(few), "doc_id").where("text is not null")
    rows = cut(rows.dropDuplicates(["text", "toxic"]), "toxicity-sample")

    def count(batches):
        for batch in batches:
            for part, data, offsets in text_slices(batch, "text"):
                found, first, _, _ = words_of(data, offsets)
                for i, toxic in enumerate(part.column(2).to_pylist()):
                    w = np.unique(np.concatenate([h[first[i] : first[i + 1]] for h in found]))
                    w = w[w != 0]
                    yield pa.RecordBatch.from_arrays([pa.array(w.view(np.int64)), pa.array(np.full(len(w), toxic, np.int32))], ["word", "toxic"])

    counts = rows.select("doc_id", "text", "toxic").mapInArrow(count, "word long, toxic int")
    table = cut(counts.groupBy("word").agg(F.sum("toxic").alias("t"), F.sum(1 - F.col("toxic")).alias("c")), "toxicity-words")
    nt, nc = (int(x or 0) for x in table.agg(F.sum("t"), F.sum("c")).first())
    none = Model(np.zeros(0, np.uint64), np.zeros(0), np.zeros(0), 1.0, 1.0, (-40.0, 0.0, 0.0))
    if not nt or not nc:
        return none
    mass = prior * (nt + nc)
    share = (F.col("t") + F.col("c")) * prior
    odds = F.log((F.col("t") + share) / (nt + mass - F.col("t") - share)) - F.log((F.col("c") + share) / (nc + mass - F.col("c") - share))
    z = odds / F.sqrt(1 / (F.col("t") + share) + 1 / (F.col("c") + share))
    strong = table.select("word", odds.alias("odds"), z.alias("z"), "t", "c").where("z > 3.5 and t >= 3 or z < -6").orderBy("word").collect()  # bounded by the rows learnt from
    if not any(r["odds"] > 0 for r in strong):
        return none
    order = np.argsort(np.array([r["word"] for r in strong], dtype=np.int64).view(np.uint64))
    words = np.array([r["word"] for r in strong], dtype=np.int64).view(np.uint64)[order]
    scores, ranks = (np.array([abs(r[k]) if k == "z" else r[k] for r in strong])[order] for k in ("odds", "z"))
    # lambda over the words of non-toxic documents, of which those in no table have DRIFT
    freq = np.array([r["c"] for r in strong])[order] / nc
    freq = np.maximum(freq, 0.5 / nc)
    values, chance = np.append(scores, DRIFT), np.append(freq, max(0.0, 1 - freq.sum()))
    lo, hi = 1e-6, 20.0
    for _ in range(80):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if (chance * np.exp(np.minimum(mid * values, 600))).sum() < 1 else (lo, mid)
    rate = lo
    spark = docs.sparkSession
    plain = spark.sparkContext.broadcast(Model(words, scores, ranks, rate, 1.0, (0.0, 0.0, 0.0)))

    def largest(batches):
        """Words times exp(-lambda * largest sum) of non-toxic rows, their words shuffled."""
        model = plain.value
        for batch in batches:
            for part, data, offsets in text_slices(batch, "text"):
                found, first, _, _ = words_of(data, offsets)
                places, odds = _look_up(model, found)
                at = np.searchsorted(places, first)
                out = []
                for i, toxic in enumerate(part.column(2).to_pylist()):
                    n, mine = int(first[i + 1] - first[i]), odds[at[i] : at[i + 1]]
                    if toxic or not n:
                        continue
                    rng = np.random.default_rng(zlib.crc32(data[offsets[i] : offsets[i + 1]].tobytes()))  # of the text alone, whatever the tasks
                    where = np.sort(rng.choice(n, len(mine), replace=False))
                    sums = [s for _, _, s in maximal_segments(where.tolist(), rng.permutation(mine).tolist(), DRIFT)]
                    out.append(n * float(np.exp(-model.rate * max(sums, default=0.0))))
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.float64())], ["x"])

    # summed in a fixed order, so that a repeated run gets the same model
    clean = np.sort(np.array([r["x"] for r in rows.select("doc_id", "text", "toxic").mapInArrow(largest, "x double").collect()]))  # a number for each row learnt from
    factor = len(clean) / float(clean.sum()) if len(clean) else 1.0
    shared = spark.sparkContext.broadcast(Model(words, scores, ranks, rate, factor, (0.0, 0.0, 0.0)))

    def weigh(batches):
        model = shared.value
        for batch in batches:
            for part, data, offsets in text_slices(batch, "text"):
                found, counts = segments(model, data, offsets)
                pairs = [evidence(model, x, n) for x, n in zip(found, counts, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(2), pa.array([round(x[0], 2) for x in pairs], pa.float64()), pa.array([round(x[1], 1) for x in pairs], pa.float64())], ["toxic", "e", "s"])

    grouped = rows.select("doc_id", "text", "toxic").mapInArrow(weigh, "toxic int, e double, s double").groupBy("toxic", "e", "s").count().orderBy("toxic", "e", "s").collect()  # no more than the rows learnt from
    x = np.array([[1.0, r["e"], r["s"]] for r in grouped])
    y, n = np.array([r["toxic"] for r in grouped], dtype=float), np.array([r["count"] for r in grouped], dtype=float)
    w = np.zeros(3)
    for _ in range(60):  # Newton's method with a small ridge
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (n * p * (1 - p))[:, None]).T @ x + 1e-2 * np.eye(3), x.T @ (n * (y - p)) - 1e-2 * w)
        w = w + np.clip(step, -2, 2)
    return Model(words, scores, ranks, rate, factor, tuple(w))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """docs with `segments`, the significant toxic passages, and `score` beside; only the text is looked at."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the rows learnt from
    docs = docs.drop("segments", "score")
    names = docs.columns
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("sum", pa.float64()), ("e_value", pa.float64())]))

    def run(batches):
        model = shared.value
        for batch in batches:
            for part, data, offsets in text_slices(batch, "text"):
                found, counts = segments(model, data, offsets)
                e = np.array([evidence(model, x, n) for x, n in zip(found, counts, strict=True)])
                p = 1 / (1 + np.exp(-np.clip(model.curve[0] + e[:, 0] * model.curve[1] + e[:, 1] * model.curve[2], -30, 30)))
                rows = [[dict(zip(("start", "end", "sum", "e_value"), r, strict=True)) for r in x] for x in found]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(rows, kind), pa.array(np.where(model.curve[0] <= -40, 0.0, p), pa.float64())], [*names, "segments", "score"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.mapInArrow(run, f"{fields}, segments array<struct<start: long, end: long, sum: double, e_value: double>>, score double")


def rate_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted, segments): learnt from the labels outside fold 0, scored for all."""
    model = fit(docs, labels.where(crc_fold() != 0))
    rows = docs.select("doc_id", F.coalesce(crc_fold() == 0, F.lit(False)).alias("held_out"), "text")
    return score(rows, model).select("doc_id", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "segments")
