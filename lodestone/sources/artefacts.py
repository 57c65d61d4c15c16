"""Trees of text files on any file system that Spark writes to.

Files are first written by Spark's own text writer, a partition a file, under its commit protocol, so a failed task leaves nothing and a repeated one writes once. They are then moved to their names in a new tree, and the new tree takes
the old one's place at the end: whoever reads sees one or the other, and a failure before that leaves the old tree. Moves are the only work of the driver, one for each file.

A text file ends with a line end: a content without one gets it, one with it stays as it is; binary content always gets one. Names must be distinct relative paths.
"""

from __future__ import annotations

import hashlib
import uuid
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .kept import _file_system

MOVERS = 16


def write_tree(artefacts: DataFrame, path: str) -> int:
    """Writes artefacts(rel, content), a file for each row at its path below `path`; what was there before goes. Returns the number of files."""
    spark = artefacts.sparkSession
    path = path.rstrip("/")
    wrong = artefacts.where(F.col("rel").isNull() | F.col("rel").rlike(r"^$|^/|/$|//|(^|/)\.\.?(/|$)")).select("rel").limit(3).collect()
    twice = artefacts.groupBy("rel").count().where("count > 1").select("rel").limit(3).collect()
    if wrong or twice:
        raise ValueError(f"not distinct relative paths: {[r[0] for r in [*wrong, *twice]]}")
    staging = f"{path}.{uuid.uuid4().hex}"
    at, fs = _file_system(spark, staging)
    Path = spark._jvm.org.apache.hadoop.fs.Path
    try:
        raw = artefacts.schema["content"].dataType.simpleString() == "binary"
        value = F.coalesce("content", F.lit(b"")).cast("string") if raw else F.regexp_replace(F.coalesce("content", F.lit("")), r"\n\z", "")
        rows = artefacts.select(F.sha2(F.col("rel").cast("binary"), 256).alias("name"), value.alias("value"))
        rows.write.partitionBy("name").text(f"{staging}/parts")
        made: set[str] = set()

        def move(rel: str) -> None:
            name = hashlib.sha256(rel.encode()).hexdigest()
            to = Path(f"{staging}/tree/{rel}")
            folder = rel.rpartition("/")[0]
            if folder not in made:
                fs.mkdirs(to.getParent())
                made.add(folder)
            (part,) = [s.getPath() for s in fs.listStatus(Path(f"{staging}/parts/name={name}"))]
            if not fs.rename(part, to):
                raise OSError(f"{rel} could not be moved")

        count = 0
        fs.mkdirs(Path(f"{staging}/tree"))
        with ThreadPoolExecutor(MOVERS) as pool:
            for _ in pool.map(move, (r[0] for r in artefacts.select("rel").toLocalIterator())):
                count += 1
        target, old = Path(path), Path(f"{staging}/old")
        if fs.exists(target):
            fs.rename(target, old)
        fs.mkdirs(target.getParent())
        if not fs.rename(Path(f"{staging}/tree"), target):
            fs.rename(old, target)
            raise OSError(f"{path} could not be replaced")
        return count
    finally:
        fs.delete(at, True)
