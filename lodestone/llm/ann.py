"""Approximate nearest neighbours by score-aware quantisation.

Vectors are scaled to length 1, so the largest cosine is the maximum inner product. They are turned by a fixed random rotation, so no dimension holds more than its share, and each is told by its nearest of at most CENTERS centres and the rest,
whose length is kept and whose direction is coded: what all rows, or all of a group, have in common costs no code. Each pair of dimensions has 16 codewords. Codewords and codes minimise the anisotropic loss
|r|^2 + (eta - 1) <r, x>^2 of the residual r, which weighs the part of r along x, the one that spoils high scores, eta times; eta = (d - 1) T^2 / (1 - T^2) for scores above T. Codes are found by coordinate
descent over the subspaces, codewords by least squares, both from a bounded sample of `sample` vectors; every row is encoded.

A search scans the four-bit codes of each task's rows by tables, a query at a time; the `shortlist` best of each block of rows, and all that tie with the last, are scored exactly in double precision on the
original vectors, and so is every row whose estimate is less than DEVIATIONS of its error below the k-th best exact score yet: an estimate errs by the product of the row's coding error and the query, whose distance
from the row's centre bounds it, and a random direction shares 1 / d of its square with it. So a shortlist that is too short for the data costs time and no neighbour, but for rare large errors. Each task hands on its k best for each query. Queries are taken in blocks of at most QUERY_BLOCK vectors, each against all rows.

Cases: vectors that are null, of another length than most, zero, or hold null or non-finite components take no part; nor do null ids. Ties go to the smaller id. Rows of one id are one vector for the
query's own row, and of a query id's rows the least vector asks. Fewer candidates than k give all; an empty table gives no row. Other columns are left out.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._shared import Scope, cut

QUERY_BLOCK = 8192
#: Rows that one table scan covers.
SCAN_ROWS = 8192
#: Centres at most, and standard deviations of its error by which a row's estimate may be too low.
CENTERS, DEVIATIONS = 64, 4.0


@dataclass
class Codebook:
    words: np.ndarray  # subspaces x 16 x 2
    eta: float
    size: int


def _pad(x: np.ndarray) -> np.ndarray:
    return np.pad(x, ((0, 0), (0, x.shape[1] % 2 + (2 if (x.shape[1] + x.shape[1] % 2) % 4 else 0))))


def _codes(book: Codebook, x: np.ndarray, rounds: int = 3) -> np.ndarray:
    """The codes of padded unit vectors, rows x subspaces."""
    m = len(book.words)
    parts = x.reshape(len(x), m, 2)
    codes = np.zeros((len(x), m), dtype=np.uint8)
    error = np.zeros((len(x), m))  # <r_m, x_m>
    for turn in range(rounds):
        for j in range(m):
            r = parts[:, j, None, :] - book.words[j][None, :, :]
            plain = (r**2).sum(axis=2)
            along = (r * parts[:, j, None, :]).sum(axis=2)
            rest = (error.sum(axis=1) - error[:, j])[:, None] if turn else 0.0
            best = (plain + (book.eta - 1) * (rest + along) ** 2).argmin(axis=1)
            codes[:, j] = best
            error[:, j] = along[np.arange(len(x)), best]
    return codes


def train(x: np.ndarray, threshold: float = 0.2, rounds: int = 8) -> Codebook:
    """Codewords for unit vectors."""
    rng = np.random.default_rng(20240503)
    size, x = x.shape[1], _pad(x)
    m = x.shape[1] // 2
    parts = x.reshape(len(x), m, 2)
    start = np.stack([rng.choice(len(x), size=16, replace=len(x) < 16) for _ in range(m)])
    words = np.stack([parts[start[j], j] for j in range(m)]) + rng.normal(0, 1e-6, (m, 16, 2))
    book = Codebook(words, max(1.0, (size - 1) * threshold**2 / (1 - threshold**2)), size)
    for turn in range(rounds):
        codes = _codes(book, x, 1 if turn < 3 else 2)
        picked = book.words[np.arange(m)[None, :], codes]
        error = ((parts - picked) * parts).sum(axis=2)
        total = error.sum(axis=1)
        for j in range(m):
            p, rest = parts[:, j], total - error[:, j]
            w = book.eta - 1
            for c in range(16):
                mine = codes[:, j] == c
                if not mine.any():
                    continue
                q = p[mine]
                left = mine.sum() * np.eye(2) + w * q.T @ q
                right = q.sum(axis=0) + w * ((rest[mine] + (q**2).sum(axis=1))[:, None] * q).sum(axis=0)
                book.words[j, c] = np.linalg.solve(left, right)
    return book


@dataclass
class Frame:
    """Where vectors lie: turned, and seen from the nearest of some centres."""

    turn: np.ndarray  # d x d, orthogonal
    centers: np.ndarray  # centres x d

    @classmethod
    def of(cls, x: np.ndarray) -> Frame:
        """The frame of a sample of unit vectors: centres by k-means, begun with vectors that are far from those before."""
        rng = np.random.default_rng(20240504)
        x = _pad(x)
        turn = np.linalg.qr(rng.normal(size=(x.shape[1], x.shape[1])))[0]
        x = x @ turn
        centers = x.mean(axis=0, keepdims=True)
        far = ((x - centers) ** 2).sum(axis=1)
        while len(centers) < min(CENTERS, len(x) // 32) and far.sum() > 0:
            centers = np.vstack([centers, x[rng.choice(len(x), p=far / far.sum())]])
            far = np.minimum(far, ((x - centers[-1]) ** 2).sum(axis=1))
        for _ in range(6):
            near = cls(turn, centers).nearest(x)
            count = np.bincount(near, minlength=len(centers))
            total = np.zeros_like(centers)
            np.add.at(total, near, x)
            centers = np.where(count[:, None] > 0, total / np.maximum(count, 1)[:, None], centers)
        return cls(turn, centers)

    def nearest(self, turned: np.ndarray) -> np.ndarray:
        return ((self.centers**2).sum(axis=1) - 2 * np.einsum("nd,cd->nc", turned, self.centers)).argmin(axis=1)

    def turned(self, x: np.ndarray) -> np.ndarray:
        return np.einsum("nd,de->ne", _pad(x), self.turn)

    def split(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of unit vectors: turned, their centres, and the lengths and directions of what is left."""
        turned = self.turned(x)
        center = self.nearest(turned)
        left = turned - self.centers[center]
        scale = np.linalg.norm(left, axis=1)
        return turned, center, scale, left / np.where(scale > 0, scale, 1.0)[:, None]


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _matrix(column: pa.Array, size: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, size)


def valid(rows: DataFrame, vector: str = "embedding", id_column: str = "vec_id") -> tuple[DataFrame, int]:
    """(vec_id, embedding array<double>) of the rows that take part, and the vectors' length, that of most."""
    v = F.col("embedding")
    ok = F.forall(v, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) != float("inf"))) & F.exists(v, lambda e: e != 0)
    rows = rows.select(F.col(id_column).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("embedding")).where("vec_id is not null and embedding is not null").where(ok)
    most = rows.groupBy(F.size("embedding").alias("size")).count().orderBy(F.desc("count"), "size").first()
    return rows.where(F.size("embedding") == (most["size"] if most else 0)), most["size"] if most else 0


def build(rows: DataFrame, size: int, sample: int = 10_000) -> tuple[DataFrame, tuple[Frame, Codebook]]:
    """The index: (vec_id, embedding, code binary, center, shift, scale, error) of all valid rows, and its frame and codebook, trained on at most `sample` vectors with the least hashes of their ids.

    An estimate is shift + <query, centre> + scale * <query, coded direction>: it is exact but for <query - centre, coding error>."""
    few = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).select("vec_id", "embedding").collect()
    x = _unit(np.array([r["embedding"] for r in few]))
    frame = Frame.of(x)
    _, _, scale, left = frame.split(x)
    book = train(left[scale > 0] if (scale > 0).any() else left)
    shared = rows.sparkSession.sparkContext.broadcast((frame, book))

    def run(batches):
        frame, book = shared.value
        for batch in batches:
            for k in range(0, batch.num_rows, SCAN_ROWS):
                part = batch.slice(k, SCAN_ROWS)
                turned, center, scale, left = frame.split(_unit(_matrix(part.column(1), size)))
                codes = _codes(book, left)
                packed = codes[:, 0::2] << 4 | codes[:, 1::2]
                coded = book.words[np.arange(len(book.words))[None, :], codes].reshape(len(left), -1)
                mid = frame.centers[center]
                shift = (mid * turned).sum(axis=1) - (mid**2).sum(axis=1) - scale * (mid * coded).sum(axis=1)
                error = scale * np.linalg.norm(left - coded, axis=1)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array([p.tobytes() for p in packed], pa.binary()), pa.array(center.astype(np.int32)), pa.array(shift), pa.array(scale), pa.array(error)], ["vec_id", "embedding", "code", "center", "shift", "scale", "error"])

    return cut(rows.mapInArrow(run, "vec_id long, embedding array<double>, code binary, center int, shift double, scale double, error double"), "ann-index"), (frame, book)


def _tables(book: Codebook, q: np.ndarray) -> np.ndarray:
    """For each query and code byte the summed score of its two codewords: queries x bytes x 256."""
    parts = _pad(q).reshape(len(q), len(book.words), 2)
    one = np.einsum("qmd,mcd->qmc", parts, book.words)
    return (one[:, 0::2, :, None] + one[:, 1::2, None, :]).reshape(len(q), -1, 256).astype(np.float32)


def search(index: DataFrame, made: tuple[Frame, Codebook], queries: DataFrame, k: int = 5, shortlist: int = 48) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of each query among all rows but those of its own id."""
    spark, (frame, book) = index.sparkSession, made
    queries = cut(queries.groupBy("vec_id").agg(F.min("embedding").alias("embedding")), "ann-queries")
    total = queries.count()
    blocks = max(1, -(-total // QUERY_BLOCK))
    found = None
    for b in range(blocks):
        rows = (queries.where(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == b) if blocks > 1 else queries).orderBy("vec_id").collect()  # about QUERY_BLOCK rows
        if not rows:
            continue
        asked = spark.sparkContext.broadcast((np.array([r["vec_id"] for r in rows]), _unit(np.array([r["embedding"] for r in rows]))))

        def run(batches, asked=asked):
            ids, q = asked.value
            turned = frame.turned(q)
            to_center = np.einsum("nd,cd->nc", turned, frame.centers)
            # a query's distance from each centre, in steps of the error that a random direction makes
            away = np.stack([np.linalg.norm(turned - c, axis=1) for c in frame.centers], axis=1) * (DEVIATIONS / np.sqrt(turned.shape[1]))
            best: list[list[tuple[float, int]]] = [[] for _ in ids]

            def scan(vec_ids, vectors, codes, center, shift, scale, error):
                order = np.argsort(vec_ids, kind="stable")
                vec_ids, unit, codes, center, shift, scale, error = vec_ids[order], _unit(vectors[order]), codes[order], center[order], shift[order], scale[order], error[order]
                columns = np.ascontiguousarray(codes.T)
                for start in range(0, len(ids), 512):
                    tables = _tables(book, turned[start : start + 512])
                    for i, table in enumerate(tables, start):
                        coded = table[0][columns[0]]
                        for j in range(1, len(columns)):
                            coded += table[j][columns[j]]
                        approx = shift + to_center[i][center] + scale * coded
                        if len(approx) > shortlist + 1:
                            edge = np.partition(approx, len(approx) - shortlist - 1)[len(approx) - shortlist - 1]
                            listed = approx >= edge
                        else:
                            listed = np.ones(len(approx), bool)
                        for short in (listed, None):
                            if short is None:  # what may be as near as the k-th best yet
                                if listed.all():
                                    break
                                least = -best[i][k - 1][0] if len(best[i]) == k else -np.inf
                                short = ~listed & (approx + error * away[i][center] + 1e-9 * scale >= least)
                            short = np.flatnonzero(short)
                            short = short[vec_ids[short] != ids[i]]
                            if not len(short):
                                continue
                            exact = np.minimum(np.einsum("nd,d->n", unit[short], q[i]), 1.0)
                            top = np.lexsort((vec_ids[short], -exact))[:k]
                            best[i] = sorted(best[i] + list(zip((-exact[top]).tolist(), vec_ids[short[top]].tolist(), strict=True)))[:k]

            held: list = []
            count = 0
            for batch in batches:
                width = len(book.words) // 2
                codes = np.frombuffer(b"".join(batch.column(2).to_pylist()), dtype=np.uint8).reshape(-1, width)
                held.append((batch.column(0).to_numpy(), _matrix(batch.column(1), q.shape[1]), codes, *(batch.column(c).to_numpy() for c in ("center", "shift", "scale", "error"))))
                count += batch.num_rows
                if count >= SCAN_ROWS:
                    scan(*(np.concatenate(x) for x in zip(*held, strict=True)))
                    held, count = [], 0
            if held:
                scan(*(np.concatenate(x) for x in zip(*held, strict=True)))
            flat = [(int(i), v, -s) for i, b in zip(ids, best, strict=True) for s, v in b]
            if flat:
                yield pa.RecordBatch.from_arrays([pa.array([f[0] for f in flat], pa.int64()), pa.array([f[1] for f in flat], pa.int64()), pa.array([f[2] for f in flat], pa.float64())], ["query_id", "vec_id", "score"])

        part = index.select("vec_id", "embedding", "code", "center", "shift", "scale", "error").mapInArrow(run, "query_id long, vec_id long, score double")
        part = cut(part, "ann-found") if blocks > 1 else part
        found = part if found is None else found.unionByName(part)
    if found is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def nearest(rows: DataFrame, every: int, k: int = 5) -> DataFrame:
    """search() of the rows whose vec_id is divisible by `every`, against all rows."""
    rows, size = valid(rows)
    if not size:
        return rows.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    with Scope(rows.sparkSession) as scope:
        index, book = build(rows, size)
        return scope.keep(cut(search(index, book, index.where(F.col("vec_id") % every == 0).select("vec_id", "embedding"), k), "ann-nearest"))
