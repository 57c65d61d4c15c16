"""Words by their parts: an index of the runs of three letters that words hold, so that what contains a token is found without looking at all words.

A word that contains a token contains all of its runs of three; the run that fewest words have leads to the candidates, which lie there with their words, and `contains` decides. A token of one or two letters is itself a key
of an exact side table. All steps are equi-joins, for any number of tokens at once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.kept import narrowed, settled

SIZE = 3


def _runs(word: Column, size: int) -> Column:
    at = F.when(F.length(word) >= size, F.sequence(F.lit(1), F.length(word) - size + 1)).otherwise(F.array().cast("array<int>"))
    return F.array_distinct(F.transform(at, lambda i: F.substring(word, i, F.lit(size))))


class GramIndex:
    """grams(gram, word) in order of gram, with sizes(gram, words); of words(word), which are distinct."""

    def __init__(self, grams: DataFrame, sizes: DataFrame):
        self.grams, self.sizes = grams, sizes

    @staticmethod
    def write(words: DataFrame, path: str, shortest: int = 1) -> None:
        """Tokens of fewer than `shortest` letters can't be asked for."""
        every = F.concat(*[_runs(F.col("word"), k) for k in range(min(shortest, SIZE), SIZE + 1)])
        rows = words.select("word", F.explode(every).alias("gram"))
        rows.select("gram", "word").repartitionByRange("gram", "word").sortWithinPartitions("gram", "word").write.parquet(f"{path}/grams")
        grams = words.sparkSession.read.parquet(f"{path}/grams")
        grams.groupBy("gram").agg(F.count("*").alias("words")).repartitionByRange("gram").sortWithinPartitions("gram").write.parquet(f"{path}/sizes")

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> GramIndex:
        return cls(spark.read.parquet(f"{path}/grams"), spark.read.parquet(f"{path}/sizes"))

    def containing(self, asked: DataFrame) -> DataFrame:
        """(token, word) of asked(token): each word that contains a token. An empty token is in none."""
        wanted = F.when(F.length("token") >= SIZE, _runs(F.col("token"), SIZE)).otherwise(F.array("token"))
        asked = asked.select("token").distinct().where("token <> ''").withColumn("_runs", wanted)
        runs = settled(asked.select("token", F.size("_runs").alias("of"), F.explode("_runs").alias("gram")))
        sized = runs.join(narrowed(self.sizes, "gram", runs, "gram"), "gram")
        # a token one of whose runs no word has is in no word
        rarest = sized.groupBy("token").agg(F.count("*").alias("found"), F.first("of").alias("of"), F.min_by("gram", F.struct("words", "gram")).alias("gram")).where("found = of")
        rarest = settled(rarest.select("token", "gram"))
        return narrowed(self.grams, "gram", rarest, "gram").join(rarest, "gram").where(F.contains("word", F.col("token"))).select("token", "word")
