"""As-of registries: lookup, staleness, freshness and version checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import age_band, version_parts


def contains_any(term: str, *columns: str) -> Column:
    """Any column contains the term, letters of any case; null columns do not."""
    out = F.lit(False)
    for c in columns:
        out = out | F.contains(F.lower(F.coalesce(F.col(c), F.lit(""))), F.lit(term.lower()))
    return out


def lookup(term: str, **sources: tuple[DataFrame, list[str]]) -> DataFrame:
    """(kind, id, name): rows of each named source(id, name, …) that hold the term in one of its columns."""
    out = None
    for kind, (rows, columns) in sources.items():
        part = rows.where(contains_any(term, *columns)).select(F.lit(kind).alias("kind"), F.col("id").cast("long").alias("id"), "name")
        out = part if out is None else out.unionByName(part)
    return out


def stale(records: DataFrame, baseline: DataFrame, ordered: bool = False) -> DataFrame:
    """records(…, as_of) whose as_of is not the one of baseline(baseline), a row; a missing as_of is stale. With `ordered` only older versions are."""
    both = records.crossJoin(F.broadcast(baseline.limit(1)))  # one row
    if ordered:
        return both.where(F.col("as_of").isNull() | (version_parts(F.col("as_of")) < version_parts(F.col("baseline"))))
    return both.where(~F.col("as_of").eqNullSafe(F.col("baseline")))


def freshness(records: DataFrame, day: str, today: Column) -> DataFrame:
    """records with age_days and band."""
    return records.withColumn("age_days", F.datediff(today, F.col(day)).cast("long")).withColumn("band", age_band(F.col(day), today))


def version_mismatch(observed: DataFrame, pinned: str) -> DataFrame:
    """observed(…, version) that differ from the pinned version; unknown versions are silent."""
    return observed.where(F.col("version").isNotNull() & (F.col("version") != pinned))
