"""Trees of files: whole or not at all, and sitemaps that are split by their limit."""

import os

import pytest
from pyspark.sql import functions as F

from lodestone.operators import publish
from lodestone.sources.artefacts import write_tree


def _tree(path):
    return {os.path.relpath(os.path.join(d, f), path): open(os.path.join(d, f), encoding="utf-8").read() for d, _, names in os.walk(path) for f in names if not f.endswith(".crc")}


def test_tree(spark, tmp_path):
    target = f"{tmp_path}/site"
    files = {"a.md": "one\ntwo\n", "x/y/z.html": "é 日本", "x/empty.txt": "", "x/none.txt": None, "odd name=1%2F.json": "\n\n", "long/" + "d" * 200 + ".md": "x" * 100_000}
    assert write_tree(spark.createDataFrame(list(files.items()), "rel string, content string").repartition(3), target) == len(files)
    want = {k: (v or "") if (v or "").endswith("\n") else (v or "") + "\n" for k, v in files.items()}
    assert _tree(target) == want and os.listdir(tmp_path) == ["site"]
    assert write_tree(spark.createDataFrame([("b.md", "new")], "rel string, content string"), target + "/") == 1
    assert _tree(target) == {"b.md": "new\n"}
    assert write_tree(spark.createDataFrame([], "rel string, content string"), target) == 0 and _tree(target) == {}


def test_failures_leave_the_old_tree(spark, tmp_path):
    target = f"{tmp_path}/site"
    write_tree(spark.createDataFrame([("a.md", "old")], "rel string, content string"), target)
    broken = spark.range(40).repartition(4).select(F.concat(F.lit("n"), F.col("id").cast("string")).alias("rel"), F.when(F.col("id") == 39, F.raise_error(F.lit("broken"))).otherwise("x").cast("string").alias("content"))
    with pytest.raises(Exception, match="broken"):
        write_tree(broken, target)
    for bad in (["a", "a"], ["../a"], ["/a"], [""], [None], ["a//b"], ["a/./b"], ["a/"]):
        with pytest.raises(ValueError):
            write_tree(spark.createDataFrame([(b, "x") for b in bad], "rel string, content string"), target)
    assert _tree(target) == {"a.md": "old\n"} and os.listdir(tmp_path) == ["site"]


def test_sitemaps_split(spark):
    pages = spark.createDataFrame([(i * 7, f"https://x.example/{i}?a&b") for i in range(25)], "ord long, url string").repartition(3)
    files = {r["rel"]: r["content"] for r in publish.sitemap_files(pages, F.lit("2024-05-01").cast("date"), "https://x.example", 10).collect()}
    assert sorted(files) == ["sitemap-1.xml", "sitemap-2.xml", "sitemap-3.xml", "sitemap.xml"]
    assert files["sitemap-1.xml"].count("<url>") == 10 and files["sitemap-3.xml"].count("<url>") == 5 and "/20?a&amp;b<" in files["sitemap-3.xml"]
    assert files["sitemap.xml"].count("<sitemap>") == 3 and files["sitemap.xml"].startswith("<?xml")
    for most in (25, 50_000):
        (only,) = publish.sitemap_files(pages, F.lit("2024-05-01").cast("date"), "https://x.example", most).collect()
        assert only["rel"] == "sitemap.xml" and only["content"].count("<url>") == 25
    assert publish.sitemap_files(pages.limit(0), F.lit("2024-05-01").cast("date"), "https://x.example").collect() == []
