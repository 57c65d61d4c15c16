"""Tables that the engine keeps: written once in a folder that driver and executors share, found again by the files they were made of, and read with filters that reach the files."""

from __future__ import annotations

import hashlib
import os
import tempfile
import uuid
from collections.abc import Callable
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Keys that are pushed to a scan as literals, so that it skips the files and row groups without them; more keys are a semi-join.
MOST_LITERALS = 1000


def prepare(spark: SparkSession) -> None:
    """Lets long key lists reach the row groups, bounds Arrow batches, and lets Python workers import this package from its folder; on a cluster submit it with --py-files."""
    spark.conf.set("spark.sql.parquet.pushdown.inFilterThreshold", str(MOST_LITERALS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(4 << 20))
    root, env = str(Path(__file__).resolve().parents[2]), spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in paths:
        env["PYTHONPATH"] = os.pathsep.join([root, *paths])


def _file_system(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or, where that is unset in a single process as in tests, a local one that goes with the session; on a cluster it must be set."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/") + "/lodestone"
    base = spark.conf.get("spark.lodestone.kept", None)
    if not base:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="lodestone-kept-")
        spark.conf.set("spark.lodestone.kept", base)
        at, fs = _file_system(spark, base)
        fs.deleteOnExit(at)
    return base


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, removed when the driver's JVM ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    at, fs = _file_system(spark, path)
    fs.deleteOnExit(at)
    return path


def exists(spark: SparkSession, path: str) -> bool:
    at, fs = _file_system(spark, path)
    return bool(fs.exists(at))


def listed(spark: SparkSession, path: str) -> list[str]:
    """The names in a folder; none if there is no such folder."""
    at, fs = _file_system(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(at)) if fs.exists(at) else []


def mark(spark: SparkSession, path: str) -> None:
    """An empty file, which appears at once or not at all."""
    at, fs = _file_system(spark, path)
    fs.create(at, True).close()


def signature(rows: DataFrame) -> str:
    """What tells the files that rows are read from apart from others: their paths, sizes and times, folder by folder."""
    spark = rows.sparkSession
    parts = []
    for folder in sorted({f.rpartition("/")[0] for f in rows.inputFiles()}):
        at, fs = _file_system(spark, folder)
        parts += [f"{s.getPath()} {s.getLen()} {s.getModificationTime()}" for s in fs.listStatus(at) if s.isFile()]
    return hashlib.sha256("\n".join(parts).encode()).hexdigest()[:32]


def kept(spark: SparkSession, name: str, made_of: DataFrame, build: Callable[[str], None]) -> str:
    """The path of what build(path) once wrote of made_of's files. It is built under another name and moved, so a failed build leaves nothing that looks whole, and of two builders the first one's stays."""
    path = f"{shared_dir(spark)}/{name}-{signature(made_of)}"
    if not exists(spark, path):
        building = fresh_path(spark, name)
        build(building)
        moved(spark, building, path)
        if spark.conf.get("spark.lodestone.kept", None):
            to, fs = _file_system(spark, path)
            fs.deleteOnExit(to)
    return path


def moved(spark: SparkSession, building: str, path: str) -> None:
    """Moves what was built to its name; where another builder was first, that one's stays."""
    at, fs = _file_system(spark, building)
    to, _ = _file_system(spark, path)
    if not fs.exists(to):
        fs.rename(at, to)


def settled(rows: DataFrame) -> DataFrame:
    """rows worked out once: few of them as a local table whose rows later steps know, more as a written one."""
    spark = rows.sparkSession
    some = rows.limit(MOST_LITERALS + 1).toArrow()
    if len(some) > MOST_LITERALS:
        path = fresh_path(spark, "settled")
        rows.write.parquet(path)
        return spark.read.schema(rows.schema).parquet(path)
    out = spark.createDataFrame(some, rows.schema)
    out.known_rows = some.to_pylist()
    return out


def written(rows: DataFrame, name: str) -> DataFrame:
    """rows worked out once, as a table in the shared folder, where several steps read them."""
    path = fresh_path(rows.sparkSession, name)
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def narrowed(rows: DataFrame, column: str, keys: DataFrame, key: str) -> DataFrame:
    """rows whose column is among keys[key]: few keys as literals that the scan is filtered by, others by a semi-join."""
    some = getattr(keys, "known_rows", None)
    if some is None:
        some = keys.select(key).distinct().limit(MOST_LITERALS + 1).collect()
    if len(some) > MOST_LITERALS:
        return rows.join(keys.select(F.col(key).alias(column)).distinct(), column, "left_semi")
    values = sorted({r[key] for r in some if r[key] is not None})
    return rows.where(F.col(column).isin(values)) if values else rows.where("false")


def whole_groups(batches, most: int):
    """Rows that are sorted by their first column, in tables of whole groups of it, each table as soon as it holds `most` rows."""
    held, size = [], 0
    for batch in batches:
        g = batch.column(0).to_numpy()
        if not len(g):
            continue
        last = int(np.flatnonzero(g != g[-1])[-1]) + 1 if g[0] != g[-1] else 0  # the batch's last group may go on
        if size >= most and (last or held[-1].column(0)[-1].as_py() != g[0]):
            # what is held ends where its last group does
            end = int(np.searchsorted(g != held[-1].column(0)[-1].as_py(), True))
            yield pa.Table.from_batches([*held, batch.slice(0, end)]).combine_chunks().to_batches()[0]
            held, size, batch = [], 0, batch.slice(end)
        held.append(batch)
        size += batch.num_rows
    if size:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
