"""An index kept up to date by a stream: each micro-batch adds its document frequencies.

An extension beside the reference's operators. A batch writes its counts under its own number, so one that runs again replaces what it wrote."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.text import tokens


def start_index(documents: DataFrame, store: str, checkpoint: str) -> StreamingQuery:
    """Starts the stream over documents(id, text); it ends when all that is there has been read."""

    def add(batch: DataFrame, number: int) -> None:
        terms = batch.select(F.explode(F.array_distinct(tokens(F.col("text")))).alias("term"))
        terms.groupBy("term").agg(F.count("*").alias("df")).write.mode("overwrite").parquet(f"{store}/batch={number}")

    return documents.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def term_totals(spark: SparkSession, store: str) -> DataFrame:
    """(term, df) over all batches."""
    return spark.read.parquet(store).groupBy("term").agg(F.sum("df").alias("df"))
