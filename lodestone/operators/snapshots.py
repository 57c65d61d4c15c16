"""Snapshots that are kept in buckets with digests, so that two nearly equal ones are compared without reading what they share.

A row's bucket is the hash of its key. A bucket's digest does not depend on the order of its rows: their number, the exclusive or of one hash of each row and the sum of another's low half. Digests are kept for buckets and, one level up, for
groups of buckets; a comparison reads the few group digests, then the bucket digests of groups that differ, then only the files of buckets that differ, and joins those. Two different buckets pass as equal only if number, both hashes and sums agree.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .diff import map_diff

#: Buckets of a snapshot, and buckets of a group, as powers of two. The number of buckets bounds what a comparison keeps on the driver.
BUCKET_BITS, GROUP_BITS = 8, 4


class Snapshot:
    """rows(keys, value) below a path, one row a key; BUCKET_BITS must be the same for snapshots that are compared, and is kept with them."""

    def __init__(self, spark: SparkSession, path: str, keys: list[str], value: str):
        self.spark, self.path, self.keys, self.value = spark, path, keys, value
        self.groups, self.digests = spark.read.parquet(f"{path}/groups"), spark.read.parquet(f"{path}/digests")

    @classmethod
    def write(cls, rows: DataFrame, keys: list[str], value: str, path: str, bits: int | None = None) -> Snapshot:
        spark, bits = rows.sparkSession, BUCKET_BITS if bits is None else bits
        bucket = F.pmod(F.xxhash64(*keys), F.lit(1 << bits)).cast("int")
        dealt = rows.select(*keys, value, bucket.alias("bucket")).repartition("bucket")
        dealt.write.partitionBy("bucket").parquet(f"{path}/rows")
        spark.createDataFrame([(dealt.schema.json(),)], "value string").coalesce(1).write.text(f"{path}/schema")
        kept = spark.read.schema(dealt.schema).parquet(f"{path}/rows")
        row = [*keys, value]
        low = F.xxhash64(F.lit("second"), *row).bitwiseAND(F.lit(0xFFFFFFFF))
        digests = kept.groupBy("bucket").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64(*row, F.isnull(value))).alias("mixed"), F.sum(low).alias("summed"))
        digests = digests.withColumn("part", F.shiftright("bucket", GROUP_BITS)).withColumn("bits", F.lit(bits))
        digests.coalesce(1).sortWithinPartitions("bucket").write.parquet(f"{path}/digests")
        digests = spark.read.parquet(f"{path}/digests")
        groups = digests.groupBy("part", "bits").agg(F.sum("n").alias("n"), F.bit_xor(F.xxhash64("bucket", "mixed")).alias("mixed"), F.sum("summed").alias("summed"))
        groups.coalesce(1).write.parquet(f"{path}/groups")
        return cls(spark, path, keys, value)

    def rows(self, buckets: list[int] | None = None) -> DataFrame:
        """The rows, or those of some buckets, of which alone the files are read."""
        schema = StructType.fromJson(json.loads(self.spark.read.text(f"{self.path}/schema").first()[0]))
        every = self.spark.read.schema(schema).parquet(f"{self.path}/rows")
        return (every if buckets is None else every.where(F.col("bucket").isin(buckets)) if buckets else every.where("false")).select(*self.keys, self.value)

    def changed_buckets(self, new: Snapshot) -> list[int]:
        """The buckets whose digests differ, or that one side lacks."""
        own, other = ({r["bits"] for r in s.groups.select("bits").distinct().collect()} for s in (self, new))
        if len(own | other) > 1:
            raise ValueError("the snapshots have different numbers of buckets")
        parts = _differing(self.groups, new.groups, "part")
        if not parts:
            return []
        inside = F.col("part").isin(parts)
        return _differing(self.digests.where(inside), new.digests.where(inside), "bucket")

    def diff(self, new: Snapshot) -> DataFrame:
        """(keys, old_value, new_value, status) of what was added, removed or changed."""
        buckets = self.changed_buckets(new)
        return map_diff(self.rows(buckets), new.rows(buckets), self.keys, self.value).where("status <> 'unchanged'")

    def unchanged(self, new: Snapshot) -> int:
        """How many rows both have alike, without reading those of equal buckets."""
        buckets = self.changed_buckets(new)
        alike = self.digests.where(~F.col("bucket").isin(buckets)) if buckets else self.digests
        return int(alike.agg(F.sum("n")).first()[0] or 0) + map_diff(self.rows(buckets), new.rows(buckets), self.keys, self.value).where("status = 'unchanged'").count()


def _differing(one: DataFrame, two: DataFrame, key: str) -> list[int]:
    """The keys of digest rows that are not the same on both sides; as many as there are buckets at most."""
    row = ["n", "mixed", "summed"]
    a, b = (d.select(key, F.struct(*row).alias(n)) for d, n in ((one, "a"), (two, "b")))
    return sorted(r[0] for r in a.join(b, key, "full").where("not (a <=> b)").select(key).collect())
