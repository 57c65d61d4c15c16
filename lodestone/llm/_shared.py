"""What the operators of this package share: session settings, cut lineage, Arrow batches."""

from __future__ import annotations

import ctypes
import gc
import os
import tempfile
import uuid
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one numpy pass handles; a longer text is a pass of its own.
PASS_BYTES = 400_000
_libc = ctypes.CDLL(None)


def prepare(spark: SparkSession) -> None:
    """Bounds Arrow batches, has shuffle files removed when the query that wrote them ends, and lets Python workers import this package from its folder.

    On a cluster whose executors do not share that folder, submit the package with --py-files."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4096")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(4 << 20))
    spark.conf.set("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")
    root = str(Path(__file__).resolve().parents[2])
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in paths:
        env["PYTHONPATH"] = os.pathsep.join([root, *paths])


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or, where that is unset in a single process as in tests, a local one; on a cluster it must be set."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        base = spark.conf.get("spark.lodestone.scratch", None)
        if not base:
            master = spark.sparkContext.master
            if master != "local" and not master.startswith("local["):
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            base = "file://" + tempfile.mkdtemp(prefix="lodestone-")
            spark.conf.set("spark.lodestone.scratch", base)
    return base.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, removed when the driver's JVM ends."""
    path = f"{shared_dir(spark)}/lodestone/{name}-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    jpath = jvm.org.apache.hadoop.fs.Path(path)
    jpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(jpath)
    return path


def cut(df: DataFrame, name: str) -> DataFrame:
    """Writes df as Parquet in the shared folder and reads it back: the lineage ends here, and a lost executor costs no rework."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_at = path
    if _scopes:
        _scopes[-1].tables.append(out)
    return out


class Scope:
    """What cut() writes inside a with block goes at its end, but for what keep() was told of, so an operator leaves behind no more than its result reads."""

    def __init__(self, spark: SparkSession):
        self.spark, self.tables, self.kept = spark, [], []

    def __enter__(self) -> Scope:
        _scopes.append(self)
        return self

    def keep(self, df: DataFrame) -> DataFrame:
        self.kept.append(df)
        return df

    def __exit__(self, *failure) -> None:
        _scopes.remove(self)
        paths = {df.written_at for df in self.kept}
        for df in self.tables:
            if df.written_at not in paths:
                discard(df)
        if _scopes:
            _scopes[-1].tables += self.kept
        self.tables, self.kept = [], []
        release(self.spark)


_scopes: list[Scope] = []


def discard(df: DataFrame) -> None:
    """Deletes a table that cut() wrote and that nothing reads any more."""
    jvm, spark = df.sparkSession.sparkContext._jvm, df.sparkSession
    path = jvm.org.apache.hadoop.fs.Path(df.written_at)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def release(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of lineage that cut() has ended; they go once the driver's garbage is collected."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def documents(spark: SparkSession, sf_dir: str, table: str = "documents") -> DataFrame:
    prepare(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def crc_fold(column: str = "doc_id"):
    """crc32 of the id as text, mod 5."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % 5


def text_slices(batch: pa.RecordBatch, column: str, most: int = PASS_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Parts of a batch of at most `most` bytes of text (or one row), each with its UTF-8 bytes and row offsets. Nulls count as empty."""
    index = batch.schema.get_field_index(column)
    text = batch.column(index)
    text = (text.cast(pa.large_string()) if not pa.types.is_large_string(text.type) else text).fill_null("")
    offsets = np.frombuffer(text.buffers()[1], dtype=np.int64)[text.offset : text.offset + len(text) + 1]
    data = np.frombuffer(text.buffers()[2], dtype=np.uint8) if text.buffers()[2] is not None else np.zeros(0, np.uint8)
    i = 0
    while i < len(text):
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, side="right")) - 1)
        yield batch.slice(i, j - i), data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        i = j
    give_back()


def give_back() -> None:
    """Returns freed memory of a Python worker to the system, where the C library can; workers live long and share their executor's memory."""
    pa.default_memory_pool().release_unused()
    trim = getattr(_libc, "malloc_trim", None)
    if trim:
        trim(0)
