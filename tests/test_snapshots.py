"""Bucketed snapshots against the full join, and what patterns find with its places."""

import random
import re

import pytest
from pyspark.sql import functions as F

from lodestone.operators import diff, extract, snapshots


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def _pair(spark, tmp_path, changed):
    rng = random.Random(changed)
    old = {(f"k{i}", i % 7): rng.choice([None, "", f"v{i}"]) for i in range(500)}
    new = dict(old)
    for k in rng.sample(sorted(old), changed):
        if rng.random() < 0.4:
            del new[k]
        else:
            new[k] = rng.choice(["other", None])
    new |= {("new", i): "x" for i in range(changed // 3)}
    tables = [spark.createDataFrame([(*k, v) for k, v in d.items()], "name string, n long, value string") for d in (old, new)]
    return tables, [snapshots.Snapshot.write(t, ["name", "n"], "value", f"{tmp_path}/{i}", bits=6) for i, t in enumerate(tables)]


@pytest.mark.parametrize("changed", [0, 4, 60])
def test_equal_to_the_full_join(spark, tmp_path, changed):
    (one, two), (old, new) = _pair(spark, tmp_path, changed)
    whole = diff.map_diff(one, two, ["name", "n"], "value")
    assert rows(old.diff(new)) == rows(whole.where("status <> 'unchanged'"))
    assert old.unchanged(new) == whole.where("status = 'unchanged'").count()
    assert rows(old.rows()) == rows(one)


def test_reads_changed_buckets_alone(spark, tmp_path):
    _, (old, new) = _pair(spark, tmp_path, 3)
    buckets = old.changed_buckets(new)
    assert 0 < len(buckets) <= 4
    files = {f.rpartition("/")[0].rpartition("=")[2] for f in old.rows(buckets).select(F.input_file_name().alias("f")).distinct().toPandas()["f"]}
    assert files <= {str(b) for b in buckets}
    found = old.diff(new)
    found.collect()
    scans = []

    def scanned(plan):
        text = plan.toString()
        scans.append(text.count("PartitionFilters: [bucket"))

    scanned(found._jdf.queryExecution().executedPlan())
    assert scans[0] >= 2


def test_equal_digests_of_equal_rows_only(spark, tmp_path):
    """A null is not an empty text, an order is no difference, a swap of values is one."""
    make = lambda name, data: snapshots.Snapshot.write(spark.createDataFrame(data, "k long, value string"), ["k"], "value", f"{tmp_path}/{name}", bits=1)
    one = make("one", [(1, "a"), (2, "b"), (3, None)])
    assert one.changed_buckets(make("same", [(3, None), (2, "b"), (1, "a")])) == []
    assert rows(one.diff(make("swap", [(1, "b"), (2, "a"), (3, None)]))) == [(1, "a", "b", "changed"), (2, "b", "a", "changed")]
    assert rows(one.diff(make("null", [(1, "a"), (2, "b"), (3, "")]))) == [(3, None, "", "changed")]
    assert len(one.diff(make("empty", [])).collect()) == 3 and len(make("none", []).diff(one).collect()) == 3
    with pytest.raises(ValueError):
        one.diff(snapshots.Snapshot.write(spark.createDataFrame([(1, "a")], "k long, value string"), ["k"], "value", f"{tmp_path}/bits", bits=3))


def test_matches_and_definitions(spark, monkeypatch):
    monkeypatch.setattr(extract, "OUT_ROWS", 2)
    text = 'é name:"one" description:"first" name:"two" get description(){x} name:"three" name:"one" description:"later" 12 345'
    texts = spark.createDataFrame([(1, text), (2, None), (3, "")], "id long, text string")
    found = extract.matches(texts, {"number": "[0-9]+", "name": 'name:"([a-z]+)"'})
    want = [(1, "number", m[0], m.start()) for m in re.finditer("[0-9]+", text)] + [(1, "name", m[1], m.start()) for m in re.finditer('name:"([a-z]+)"', text)]
    assert rows(found) == sorted(want, key=str)
    details = [('description:"([^"]+)"', None), (r"get description\(\)", "(dynamic)")]
    made = extract.definitions(texts, 'name:"([a-z]+)"', details, 34)
    assert [(r["name"], r["value"]) for r in made.orderBy("at").collect()] == [("one", "first"), ("two", "(dynamic)"), ("one", "later")]
    last = diff.last_wins(made.withColumn("place", F.col("at")), ["id", "name"], "value", "place")
    assert rows(last) == [(1, "one", "later"), (1, "two", "(dynamic)")]
