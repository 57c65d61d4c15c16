"""The test tables as the engine's datasets. Reads keep to the columns a query needs; Catalyst prunes and pushes the rest."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, ord, title, file, text): documents, titled by their first line, in files by source."""
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("id"), F.col("doc_id").alias("ord"), F.element_at(F.split("text", "\n"), 1).alias("title"), F.col("source").alias("file"), "text"
    )


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(fact_id, page, rule, durability, tier, total, day): orders as facts of their customer's page."""
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("fact_id"),
        F.col("o_custkey").alias("page"),
        F.concat(F.lit("order "), F.col("o_orderkey").cast("string")).alias("rule"),
        F.when(F.col("o_orderstatus") == "P", "volatile").otherwise("durable").alias("durability"),
        F.col("o_orderpriority").alias("tier"),
        F.col("o_totalprice").alias("total"),
        F.to_date("o_orderdate").alias("day"),
    )


def site(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(page_id, page, host, url, html): pages with their file name on their site."""
    path = F.regexp_replace(F.regexp_replace("url", "^[a-z]+://[^/]*/?", ""), "[?#].*$", "")
    name = F.when((path == "") | F.endswith(path, F.lit("/")), F.concat(path, F.lit("index.html"))).when(~F.element_at(F.split(path, "/"), -1).contains("."), F.concat(path, F.lit("/index.html"))).otherwise(path)
    return table(spark, sf_dir, "pages").select("page_id", name.alias("page"), F.regexp_extract("url", "^[a-z]+://([^/?#]*)", 1).alias("host"), "url", "html")
