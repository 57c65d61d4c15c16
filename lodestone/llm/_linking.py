"""Connected components, and exact links within buckets of candidates, without all pairs of a bucket where one link class fills it."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import cut, release

#: Shares of the bucket keys that are shuffled one after the other.
KEY_PASSES = 3


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(node, component): the smallest node that each node of edges(a, b) can reach.

    Large-star and small-star rounds: each moves links towards the smallest neighbour until nothing changes. Links stay distributed; each round ends in a written table."""
    edges = edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    edges = cut(edges, name)
    sign = lambda e: tuple(e.agg(F.count("*"), F.sum(F.hash("a", "b").cast("long")), F.sum((F.xxhash64("a", "b") % 1000003).cast("long"))).first())
    before = sign(edges)
    while before[0]:
        both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("m").alias("a"), "b").where("a <> b").distinct()
        # each larger node b of a small-star holds its smallest neighbour; its other smaller neighbours join that one
        least = large.groupBy("b").agg(F.min("a").alias("m"))
        small = large.join(least, "b").select(F.explode(F.array(F.struct(F.col("m").alias("a"), F.col("a").alias("b")), F.struct(F.col("m").alias("a"), F.col("b").alias("b")))).alias("e")).select("e.a", "e.b")
        edges = cut(small.where("a <> b").distinct(), name)
        after = sign(edges)
        if after == before:
            break
        before = after
    stars = edges.groupBy("b").agg(F.min("a").alias("a"))
    return stars.select(F.col("b").alias("node"), F.col("a").alias("component")).unionByName(stars.select(F.col("a").alias("node"), F.col("a").alias("component"))).distinct()


def link(
    members: DataFrame, attributes: DataFrame, verify: Callable[[DataFrame], DataFrame], name: str, keep: str = "true", close: str | None = None, ready: Callable[[DataFrame], None] | None = None, rest: Callable[[DataFrame], DataFrame] | None = None
) -> tuple[DataFrame, DataFrame]:
    """Links and components of what shares a bucket: members(key, id) to links(a, b) and components(node, component).

    First each member is verified against the bucket's smallest member, a number of pairs that is linear in the members. Then only pairs of a bucket
    whose two sides are not yet in one component are left, and all of these are verified, so no link between components is lost. `keep` is a filter over
    x_* and y_* (the columns of attributes(id, ...) of both sides) that pairs must pass, such as a bound on sizes; verify(pairs(a, b)) returns the pairs that hold.
    close is a filter over v and w, the values v of both sides in members(key, id, v), that is checked where they meet.
    ready(ids(id)) is told once which ids can be asked for. rest(left(id, c)), for the second step, may give the pairs(a, b) in place of the buckets: all
    that may link two of these ids in different components c."""

    def filtered(pairs: DataFrame) -> DataFrame:
        if keep == "true":
            return pairs
        for side, mark in (("a", "x_"), ("b", "y_")):
            pairs = pairs.join(attributes.select(F.col("id").alias(side), *[F.col(c).alias(mark + c) for c in attributes.columns if c != "id"]), side)
        return pairs.where(keep).select("a", "b")

    extra = ["v"] if close else []
    parts = []
    for k in range(KEY_PASSES):  # a share of the keys at a time, as most keys have one member and only pass through the shuffle
        share = members.where(F.pmod("key", F.lit(KEY_PASSES)) == k)
        leaders = share.groupBy("key").agg(F.min("id").alias("leader"), F.max("id").alias("top"), *[F.min_by(c, "id").alias("w") for c in extra]).where("leader < top").drop("top")
        parts.append(cut(share.join(leaders, "key"), name + "-buckets"))
        release(members.sparkSession)
    shared = reduce(DataFrame.unionByName, parts)
    if ready:
        ready(shared.select("id").distinct())
        release(members.sparkSession)
    first = cut(filtered(shared.where("id <> leader").where(close or "true").select(F.col("leader").alias("a"), F.col("id").alias("b")).distinct()), name + "-first")
    links = cut(verify(first), name + "-links")
    release(members.sparkSession)
    found = cut(components(links, name), name + "-found")
    labelled = cut(shared.select("key", "id", *extra).join(found.withColumnRenamed("node", "id"), "id", "left").select("key", "id", F.coalesce("component", "id").alias("c"), *extra), name + "-labelled")
    mixed = labelled.groupBy("key").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo < hi").select("key")
    left = cut(labelled.join(mixed, "key"), name + "-left")
    if left.isEmpty():
        return links, found
    if rest:
        pairs = rest(left.select("id", "c").distinct())
    else:
        one, two = left.select("key", F.col("id").alias("a"), F.col("c").alias("c1"), *extra), left.select("key", F.col("id").alias("b"), F.col("c").alias("c2"), *[F.col(c).alias("w") for c in extra])
        pairs = filtered(one.join(two, "key").where("c1 <> c2 and a < b").where(close or "true").select("a", "b").distinct())
    release(members.sparkSession)
    more = cut(verify(pairs.join(first, ["a", "b"], "left_anti")), name + "-more")
    if more.isEmpty():
        return links, found
    links = links.unionByName(more)
    return links, cut(components(links, name), name + "-all")
