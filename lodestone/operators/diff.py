"""Keyed snapshot differences and pattern extraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def last_wins(rows: DataFrame, keys: list[str], value: str, order: str) -> DataFrame:
    """(keys, value): of rows with equal keys the last one's value."""
    return rows.groupBy(*keys).agg(F.max(F.struct(order, value)).alias("_m")).select(*keys, F.col(f"_m.{value}").alias(value))


def map_diff(old: DataFrame, new: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys, old_value, new_value, status): added, removed, changed or unchanged, from one full join."""
    a = old.select(*keys, F.col(value).alias("old_value"), F.lit(1).alias("_o"))
    b = new.select(*keys, F.col(value).alias("new_value"), F.lit(1).alias("_n"))
    status = F.when(F.col("_o").isNull(), "added").when(F.col("_n").isNull(), "removed").when(F.col("old_value").eqNullSafe(F.col("new_value")), "unchanged").otherwise("changed")
    return a.join(b, keys, "full").select(*keys, "old_value", "new_value", status.alias("status"))


def set_diff(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, status) of two sets."""
    a, b = old.select(*keys).distinct().withColumn("value", F.lit(0)), new.select(*keys).distinct().withColumn("value", F.lit(0))
    return map_diff(a, b, keys, "value").select(*keys, "status")


def summary(diff: DataFrame) -> DataFrame:
    return diff.groupBy("status").agg(F.count("*").alias("n"))


def unconfirmed(added: DataFrame, confirmed: DataFrame, keys: list[str]) -> DataFrame:
    """What was added without a confirming record."""
    return added.join(confirmed, keys, "left_anti")


def identifiers(rows: DataFrame, id_column: str, text: str, families: dict[str, str]) -> DataFrame:
    """(id, family, value): the distinct matches of each family of patterns."""
    def named(family: str, pattern: str):
        return F.transform(F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(0)), lambda v: F.struct(F.lit(family).alias("family"), v.alias("value")))

    parts = [named(n, p) for n, p in families.items()]
    return rows.select(id_column, F.explode(F.array_distinct(F.concat(*parts))).alias("m")).select(id_column, "m.family", "m.value")
