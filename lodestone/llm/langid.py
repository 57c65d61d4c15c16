"""Language identification by a string kernel.

Kernel: two texts share so many of their blended-spectrum n-grams (presence of 1- to 3-grams of lower-case letters, all else one blank), over the root of the product of both counts. N-grams are hashed to
GRAMS places. Nyström: m landmark texts give the map K_mm^(-1/2) k_m(x); one-versus-rest ridge regression on that map is kernel ridge regression with the approximated
kernel. Scoring multiplies a batch's presence matrix with the landmarks' and the result with the weights.

Training rows are bounded: about `per_lang` rows of each language, and about `total` in all, chosen by a hash of the id; only bit sets of GRAMS bits reach the driver, which holds them packed and adds up the normal
equations block by block.

Whether a text is in its predicted language at all is told by its `known` share: that of its n-grams that HOLDERS rows of the language hold. A language's least share is FITS of the quantile LOW of the shares of its other
training rows, so it follows how varied the language's texts are, and neither changes with the number of languages. A language with one different training text has no least share.

Cases: a null text, or one without a letter, is `und` with score 0; whole texts are read, however long; repeated rows get equal results; without any training row every text with a letter is `und`; a null id is in no fold and not held out; other columns are left out by identify, and pass in predict but for those of the result's names, which are replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import crc_fold, text_slices
from .pretokens import LETTER, classes

GRAMS = 1 << 14
#: Rows of one presence matrix.
BATCH = 128
#: Landmarks of a language at least.
LEAST_MARKS = 4
#: Rows of a language whose n-grams count as known, at most half of its different rows.
HOLDERS = 32
#: A text fits its language if its known share is at least FITS times the quantile LOW of held-out rows of that language.
LOW, FITS = 0.01, 0.55
_MULTIPLY = [np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0xD6E8FEB86659FD93)]


def presence(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The 0/1 matrix of the texts' n-grams, and whether each has a letter."""
    texts = [t.lower() for t in texts]
    codes = np.frombuffer("".join(texts).encode("utf-32-le"), dtype=np.uint32)
    owner = np.repeat(np.arange(len(texts), dtype=np.int32), [len(t) for t in texts])
    letter = classes()[codes] == LETTER
    keep = letter.copy()
    keep[1:] |= letter[:-1] & (owner[1:] == owner[:-1])  # the first sign after a letter stands for all up to the next
    x = np.where(letter, codes, 32)[keep].astype(np.uint64)
    owner = owner[keep]
    out = np.zeros((len(texts), GRAMS), dtype=np.float32)
    gram = np.zeros(len(x), dtype=np.uint64)
    for n in range(1, 4):
        if len(x) < n:
            break
        gram = (gram[: len(x) - n + 1] << np.uint64(21)) | x[n - 1 :]
        inside = owner[n - 1 :] == owner[: len(x) - n + 1]
        place = ((gram * _MULTIPLY[n - 1]) >> np.uint64(50)).astype(np.int64)
        out[owner[: len(x) - n + 1][inside], place[inside]] = 1
    return out, np.bincount(owner, minlength=len(texts)) > 0


@dataclass
class Model:
    langs: list[str]
    landmarks: np.ndarray  # GRAMS x m, float32, columns over the roots of their counts
    weights: np.ndarray  # (m + 1) x langs
    held: np.ndarray  # GRAMS x langs, bool: whether a row of the language's holders has the n-gram
    least: np.ndarray  # the least known share of each language

    def scores(self, matrix: np.ndarray) -> np.ndarray:
        """For each row a probability for each language."""
        norm = np.sqrt(np.maximum(matrix.sum(axis=1, keepdims=True), 1))
        k = (matrix @ self.landmarks) / norm
        f = np.hstack([k, np.ones((len(k), 1), np.float32)]) @ self.weights
        e = np.exp(8.0 * (f - f.max(axis=1, keepdims=True)))
        return e / e.sum(axis=1, keepdims=True)


def _spread(bits: np.ndarray) -> np.ndarray:
    return np.unpackbits(bits, axis=1).astype(np.float32)


def _holders(bits: np.ndarray) -> tuple[np.ndarray, float]:
    """The n-grams that a language's first rows hold, and the least known share that its other rows ask for."""
    distinct = np.frombuffer(b"".join(dict.fromkeys(b.tobytes() for b in bits)), dtype=np.uint8).reshape(-1, bits.shape[1])
    first = min(HOLDERS, (len(distinct) + 1) // 2)
    held = np.bitwise_or.reduce(distinct[:first], axis=0)
    others = distinct[first:]
    if not len(others):
        return np.unpackbits(held).astype(bool), 0.0
    shares = np.bitwise_count(others & held).sum(axis=1) / np.bitwise_count(others).sum(axis=1)
    return np.unpackbits(held).astype(bool), FITS * float(np.quantile(shares, LOW))


def _empty() -> Model:
    return Model([], np.zeros((GRAMS, 0), np.float32), np.zeros((1, 0), np.float32), np.zeros((GRAMS, 0), bool), np.zeros(0))


def fit(docs: DataFrame, per_lang: int = 600, landmarks: int = 128, ridge: float = 1e-2, total: int = 24_000) -> Model:
    """A model of docs(doc_id, text, lang): about per_lang rows of each language are learnt from, and about `total` in all, at most twice as many."""
    labelled = docs.where("lang is not null and text is not null")
    counts = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    langs = sorted(counts)
    if not langs:
        return _empty()
    per_lang = max(1, min(per_lang, total // len(langs)))
    share = F.create_map(*[c for x in langs for c in (F.lit(x), F.lit(min(1.0, per_lang / counts[x])))])[F.col("lang")]
    place = (F.xxhash64(F.col("doc_id").cast("string"), F.lit("language sample")) % 1_000_000 + 1_000_000) % 1_000_000
    sample = labelled.where(place < share * 1_000_000).select(place.alias("place"), "lang", "text")

    def run(batches):
        for batch in batches:
            for part, _, _ in text_slices(batch, "text"):
                texts = part.column(2).to_pylist()
                for i in range(0, len(texts), BATCH):
                    bits = np.packbits(presence(texts[i : i + BATCH])[0].astype(np.uint8), axis=1)
                    yield pa.RecordBatch.from_arrays([part.column(0).slice(i, BATCH), part.column(1).slice(i, BATCH), pa.array([b.tobytes() for b in bits], pa.binary())], ["place", "lang", "bits"])

    rows = sample.mapInArrow(run, "place long, lang string, bits binary").orderBy("place", "lang", "bits").limit(2 * per_lang * len(langs)).collect()
    number = {x: k for k, x in enumerate(langs)}
    bits = np.frombuffer(b"".join(r["bits"] for r in rows), dtype=np.uint8).reshape(-1, GRAMS // 8)
    y = np.array([number[r["lang"]] for r in rows], dtype=np.int64)
    bits, y = bits[bits.any(axis=1)], y[bits.any(axis=1)]
    if not len(bits):
        return _empty()
    langs, y = [langs[k] for k in np.unique(y)], np.unique(y, return_inverse=True)[1]  # a language none of whose rows has a letter is not learnt
    each = max(LEAST_MARKS, landmarks // len(langs))
    chosen = np.concatenate([np.flatnonzero(y == k)[:each] for k in range(len(langs))])
    scale = np.sqrt(np.bitwise_count(bits).sum(axis=1).astype(np.float32))
    marks = (_spread(bits[chosen]) / scale[chosen, None]).T
    values, vectors = np.linalg.eigh(((_spread(bits[chosen]) @ marks) / scale[chosen, None]).astype(np.float64))
    good = values > 1e-6 * values.max()
    whiten = vectors[:, good] / np.sqrt(values[good])
    weight = (1.0 / np.bincount(y, minlength=len(langs)))[y] * len(y) / len(langs)
    left = np.zeros((good.sum() + 1, good.sum() + 1))
    right = np.zeros((good.sum() + 1, len(langs)))
    for i in range(0, len(bits), 1024):
        block = slice(i, i + 1024)
        f = np.hstack([((_spread(bits[block]) @ marks) / scale[block, None]) @ whiten, np.ones((len(bits[block]), 1))])
        left += f.T @ (f * weight[block, None])
        right += f.T @ (np.eye(len(langs))[y[block]] * weight[block, None])
    penalty = ridge * len(y) * np.diag(np.append(np.ones(good.sum()), 0)) / 100
    solved = np.linalg.solve(left + penalty + 1e-9 * np.eye(len(left)), right)
    held = [_holders(bits[y == k]) for k in range(len(langs))]
    return Model(langs, marks.astype(np.float32), np.vstack([whiten @ solved[:-1], solved[-1:]]).astype(np.float32), np.stack([h for h, _ in held], axis=1), np.array([x for _, x in held]))


def predict(docs: DataFrame, model: Model, lang: str = "lang_pred", score: str = "score", known: str = "known", fits: str = "fits") -> DataFrame:
    """docs with the predicted language, its score, the share of the text's n-grams that the language's holders hold, and whether that is the language's least share beside, under those names (columns that had them are
    replaced); only the text is looked at, and only it leaves the JVM. The score weighs the learnt languages against each other, however many; `fits` tells whether the text is in that language at all (never for und)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # GRAMS x (m + langs), whatever the data
    found = "lodestone language"  # a name that columns of docs do not have

    @F.arrow_udf("lang string, score double, known double, fits boolean")
    def label(texts: pa.Array) -> pa.Array:
        model = shared.value
        langs, scores, shares, fitting = [], [], [], []
        for part, _, _ in text_slices(pa.RecordBatch.from_arrays([texts], ["text"]), "text"):
            rows = [t or "" for t in part.column(0).to_pylist()]
            for i in range(0, len(rows), BATCH):
                matrix, has = presence(rows[i : i + BATCH])
                if not model.langs:
                    has[:] = False
                p = model.scores(matrix) if model.langs else np.zeros((len(has), 1))
                langs += [model.langs[k] if h else "und" for k, h in zip(p.argmax(axis=1), has, strict=True)]
                scores += np.where(has, p.max(axis=1), 0).astype(np.float64).tolist()
                if model.langs:
                    best = p.argmax(axis=1)
                    share = np.where(has, (matrix * model.held[:, best].T).sum(axis=1) / np.maximum(matrix.sum(axis=1), 1), 0).astype(np.float64)
                    shares += share.tolist()
                    fitting += (has & (share >= model.least[best])).tolist()
                else:
                    shares += [0.0] * len(has)
                    fitting += [False] * len(has)
        return pa.StructArray.from_arrays([pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(shares, pa.float64()), pa.array(fitting, pa.bool_())], ["lang", "score", "known", "fits"])

    rest = [F.col(f"`{c}`") for c in docs.columns if c not in (lang, score, known, fits)]
    results = [F.col(f"`{found}`.{c}").alias(name) for c, name in (("lang", lang), ("score", score), ("known", known), ("fits", fits))]
    return docs.withColumn(found, label("text")).select(*rest, *results)


def identify(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, lang_pred, score): learnt from the rows outside fold 0, predicted for all."""
    model = fit(docs.select("doc_id", "text", "lang").where(crc_fold() != 0))
    rows = docs.select("doc_id", F.coalesce(crc_fold() == 0, F.lit(False)).alias("held_out"), "text")
    return predict(rows, model).select("doc_id", "held_out", "lang_pred", "score")
