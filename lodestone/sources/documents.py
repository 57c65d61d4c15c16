"""Readers and writers of document collections: JSON, Markdown with front matter, text lines and lossy text."""

from __future__ import annotations

import json as _json
import os as _os
from pathlib import Path as _Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def strict_json(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """One JSON document a file; anything that does not fit the schema fails the read."""
    return spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path)


def tolerant_json(spark: SparkSession, path: str, schema: str, defaults: dict[str, Column] | None = None) -> DataFrame:
    """One JSON document a file; unreadable ones come as defaults, with the text in _corrupt_record."""
    rows = spark.read.schema(f"{schema}, _corrupt_record string").option("multiLine", True).option("mode", "PERMISSIVE").json(path)
    for name, value in (defaults or {}).items():
        rows = rows.withColumn(name, F.coalesce(F.col(name), value))
    return rows


def unwrapped(text: Column, field: str, kind: str) -> Column:
    """A value of that type, whether it stands alone or under a field."""
    return F.coalesce(F.from_json(text, f"struct<{field}: {kind}>")[field], F.from_json(text, kind))


def keyword_map(text: Column) -> Column:
    return F.from_json(text, "map<string, array<bigint>>")


def numbered_lines(files: DataFrame) -> DataFrame:
    """(file, line_no, text) of files(file, content), 1-based."""
    return files.select("file", F.posexplode(F.split("content", "\n")).alias("n", "text")).select("file", (F.col("n") + 1).alias("line_no"), "text")


def whole_files(spark: SparkSession, path: str, glob: str = "*.md", without: str | None = "README.md", recursive: bool = False) -> DataFrame:
    """(file, content) of a directory's files with an ending, one name left out."""
    rows = spark.read.option("pathGlobFilter", glob).text(path, wholetext=True, recursiveFileLookup=recursive).select(F.col("_metadata.file_name").alias("file"), F.col("value").alias("content"))
    return rows.where(F.col("file") != without) if without else rows


def files_below(spark: SparkSession, path: str, endings: list[str], without: str | None = None) -> DataFrame:
    """(path, content) of all files below a directory with one of several endings, one name left out."""
    rows = spark.read.option("pathGlobFilter", "*.{" + ",".join(endings) + "}").option("recursiveFileLookup", True).text(path, wholetext=True)
    rows = rows.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("content"))
    return rows.where(F.element_at(F.split("path", "/"), -1) != without) if without else rows


def lossy_files(spark: SparkSession, path: str) -> DataFrame:
    """(file, content) with a replacement character for each run of bad bytes."""
    rows = spark.read.format("binaryFile").load(path)
    return rows.select(F.element_at(F.split("path", "/"), -1).alias("file"), F.make_valid_utf8(F.col("content").cast("string")).alias("content"))


def front_matter(content: Column) -> Column:
    """The key-value lines of a block that opens at the first byte with ---, as a map; null without a block. Of equal keys the last wins (spark.sql.mapKeyDedupPolicy=LAST_WIN is not needed)."""
    block = F.regexp_extract(content, r"^---\r?\n((?s).*?)\r?\n---(?:\r?\n|$)", 1)
    lines = F.filter(F.split(block, r"\r?\n"), lambda x: x.rlike(r"^[A-Za-z0-9_-]+:"))
    pairs = F.transform(lines, lambda x: F.struct(F.regexp_extract(x, "^([A-Za-z0-9_-]+):", 1).alias("key"), F.trim(F.regexp_replace(x, "^[A-Za-z0-9_-]+:", "")).alias("value")))
    last = F.aggregate(pairs, F.array().cast("array<struct<key: string, value: string>>"), lambda a, p: F.concat(F.filter(a, lambda q: q["key"] != p["key"]), F.array(p)))
    return F.when(content.rlike(r"^---\r?\n(?s).*?\r?\n---(?:\r?\n|$)"), F.map_from_entries(last))


def front_list(value: Column) -> Column:
    """A value that opens with [ as whole numbers, else null."""
    return F.when(F.startswith(value, F.lit("[")), F.from_json(value, "array<bigint>"))


def payload_field(payload: Column, field: str) -> Column:
    """A string field of an event's JSON payload; of a payload that cannot be read, what a pattern finds."""
    found = F.regexp_extract(payload, f'"{field}"[ \\t]*:[ \\t]*"([^"]*)"', 1)
    return F.when(F.try_parse_json(payload).isNotNull(), F.get_json_object(payload, f"$.{field}")).otherwise(F.when(found != "", found))


def write_index_document(rows: DataFrame, path: str) -> None:
    """Rows as JSON lines."""
    rows.select(F.to_json(F.struct(*rows.columns)).alias("value")).write.mode("overwrite").text(path)


def write_lines(rows: DataFrame, line: Column, path: str) -> None:
    rows.select(line.alias("value")).write.mode("overwrite").text(path)


def write_artefacts(artefacts: DataFrame, path: str) -> None:
    """artefacts(rel, content): one file for each row, at its path below `path`; what was there before goes.

    The folder must be local to all executors or mounted on them; for other stores write_lines keeps rows."""
    spark = artefacts.sparkSession
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    root = _local(path)

    def put(rows) -> None:
        for r in rows:
            to = root / r["rel"]
            to.parent.mkdir(parents=True, exist_ok=True)
            part = to.with_name(to.name + f".{_os.getpid()}.part")
            part.write_text(r["content"] or "", encoding="utf-8")
            part.replace(to)  # a repeated task writes the same again

    artefacts.select("rel", "content").foreachPartition(put)


def _local(path: str) -> _Path:
    if "://" in path and not path.startswith("file://"):
        raise ValueError("artefact files need a local or mounted folder")
    return _Path(path.removeprefix("file://"))


def copy_static(spark: SparkSession, source: str, path: str) -> int:
    """Copies a directory's files as they are, by the file systems that hold them; their number."""
    jvm, conf = spark._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    one, two = (jvm.org.apache.hadoop.fs.Path(p) for p in (source, path))
    jvm.org.apache.hadoop.fs.FileUtil.copy(one.getFileSystem(conf), one, two.getFileSystem(conf), two, False, True, conf)
    return int(two.getFileSystem(conf).getContentSummary(two).getFileCount())


def version_stamp(spark: SparkSession, text: str) -> DataFrame:
    """A flat JSON object as one row of strings."""
    flat = {k: None if v is None else str(v) for k, v in _json.loads(text).items()}
    return spark.createDataFrame([tuple(flat.values())], ", ".join(f"`{k}` string" for k in flat))
