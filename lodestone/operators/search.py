"""Retrieval: keyword postings, TF-IDF cosine, query expansion and reciprocal rank fusion, all as joins and aggregations.

A section is (id, ord, title, text); ord is the load order that breaks ties. A query's tokens are a handful of literals; everything about the corpus stays distributed, and only what a query
matches is ranked, so no window runs over the whole corpus.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import STOP_WORDS, tokens
from .postings import PostingIndex

# The least score of a hit, the constant of rank fusion, the idf of a term that the index does not know.
MIN_SCORE, RRF_K, UNKNOWN_IDF = 0.03, 60, math.log(50)


def query_tokens(query: str, stop: list[str] | None = None) -> list[str]:
    """The tokens of a query, on the driver."""
    stop = STOP_WORDS if stop is None else stop
    return list(dict.fromkeys(t for t in re.split("[^a-z0-9]+", query.lower()) if len(t) > 1 and t not in stop))


def postings(sections: DataFrame, least: int = 4) -> DataFrame:
    """(keyword, id): the distinct longer tokens of titles."""
    return sections.select("id", F.explode(F.array_distinct(tokens(F.col("title")))).alias("keyword")).where(F.length("keyword") >= least)


def keyword_hits(posting: DataFrame, words: list[str], raw: bool = False) -> DataFrame:
    """(id, hits): tokens that some keyword of the section contains, each once; raw counts all (token, keyword) matches."""
    if not words:
        return posting.select("id", F.lit(0).cast("long").alias("hits")).where("false")
    matched = F.filter(F.array(*[F.lit(w) for w in words]), lambda w: F.contains(F.lower("keyword"), w))
    hit = posting.select("id", F.explode(matched).alias("token"))
    count = F.count("*") if raw else F.countDistinct("token")
    return hit.groupBy("id").agg(count.cast("long").alias("hits"))


def ranked(rows: DataFrame, *order: Column) -> DataFrame:
    """rows with their 1-based rank; only for what a query matched."""
    return rows.withColumn("rank", F.row_number().over(Window.orderBy(*order)))


#: Ids, and steps of a score, that one part of a ranking spans.
RANK_IDS, RANK_STEPS = 1 << 16, 1_000_000


def ranked_by_count(rows: DataFrame, count: str, by: tuple[str, ...] = ()) -> DataFrame:
    """rows(id, count) with their rank by count, then id, within what `by` names. No task sees all rows: each part holds one count and a range of ids, and only the parts' sizes are added up in one place."""
    parts = rows.withColumn("_part", F.floor(F.col("id") / RANK_IDS))
    return _ranked_parts(parts, [F.desc(count), F.asc("_part")], [count, "_part"], [F.asc("id")], by)


def ranked_by_score(rows: DataFrame, score: str, *then: str, by: tuple[str, ...] = ()) -> DataFrame:
    """rows(score, then) with their rank by the score, then columns that break ties; each part holds a small range of scores."""
    return _ranked_parts(rows.withColumn("_part", F.floor(F.col(score) * RANK_STEPS)), [F.desc("_part")], ["_part"], [F.desc(score), *[F.asc(t) for t in then]], by)


def _ranked_parts(rows: DataFrame, order: list[Column], key: list[str], inner: list[Column], by: tuple[str, ...]) -> DataFrame:
    key = [*by, *key]
    sizes = rows.groupBy(*key).agg(F.count("*").alias("_n"))
    upto = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    before = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(upto), F.lit(0))).drop("_n")
    ranks = rows.withColumn("_at", F.row_number().over(Window.partitionBy(*key).orderBy(*inner))).join(before, key)
    return ranks.withColumn("rank", (F.col("_at") + F.col("_before")).cast("int")).drop("_at", "_before", "_part")


def composed(sections: DataFrame, keywords: DataFrame, related: DataFrame) -> DataFrame:
    """sections(id, ord, title, description) with `text` of title, keywords(id, keyword), description and the topics of related(id, topic), as an index reads it; what is missing is left out."""
    words = keywords.groupBy("id").agg(F.array_join(F.array_sort(F.collect_set("keyword")), " ").alias("_words"))
    topics = related.groupBy("id").agg(F.array_join(F.array_sort(F.collect_set("topic")), " ").alias("_topics"))
    both = sections.join(words, "id", "left").join(topics, "id", "left")
    return both.withColumn("text", F.concat_ws(" ", "title", "_words", "description", "_topics")).drop("_words", "_topics")


def term_counts(sections: DataFrame) -> DataFrame:
    """(id, term, tf). Words are exploded before short and stop words go, so that the tests are compiled and no array is built twice."""
    words = sections.select("id", F.explode(F.split(F.regexp_replace(F.lower("text"), "[^a-z0-9]+", " "), " ")).alias("term"))
    return words.where((F.length("term") > 1) & ~F.col("term").isin(STOP_WORDS)).groupBy("id", "term").agg(F.count("*").alias("tf"))


def idf_table(counts: DataFrame, total: int) -> DataFrame:
    """(term, df, idf) with idf = ln(N / df)."""
    return counts.groupBy("term").agg(F.count("*").alias("df")).withColumn("idf", F.log(F.lit(float(total)) / F.col("df")))


def weights(counts: DataFrame, idf: DataFrame) -> DataFrame:
    """(id, term, weight) with the augmented term frequency 0.5 + 0.5 tf / max tf, times idf."""
    most = counts.groupBy("id").agg(F.greatest(F.max("tf"), F.lit(1)).alias("most"))
    return counts.join(most, "id").join(idf, "term").select("id", "term", ((0.5 + 0.5 * F.col("tf") / F.col("most")) * F.col("idf")).alias("weight"))


def norms(weight: DataFrame) -> DataFrame:
    """(id, terms, norm)."""
    return weight.groupBy("id").agg(F.count("*").alias("terms"), F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias("norm"))


def expand(words: list[str], vocabulary: DataFrame, spark: SparkSession) -> DataFrame:
    """(term) of a query and, for words of four or more characters that the vocabulary lacks, its near relatives: words they begin, words that begin them, words around them."""
    asked = spark.createDataFrame([(w,) for w in words], "term string")
    if not words:
        return asked
    # the vocabulary is first filtered by literals, so only near words meet the few that are missing
    missing = asked.where(F.length("term") >= 4).join(vocabulary.select("term"), "term", "left_anti")
    near = vocabulary.select("term").where(
        F.exists(
            F.array(*[F.lit(w) for w in words if len(w) >= 4]).cast("array<string>"),
            lambda w: F.startswith("term", w) & (F.length(w) >= 0.6 * F.length("term")) | F.startswith(w, F.col("term")) & (F.length("term") >= 4) | F.contains("term", w) & (F.length(w) >= 5),
        )
    )
    rule = F.startswith("v", F.col("w")) & (F.length("w") >= 0.6 * F.length("v")) | F.startswith("w", F.col("v")) & (F.length("v") >= 4) | F.contains("v", F.col("w")) & (F.length("w") >= 5)
    found = near.select(F.col("term").alias("v")).join(F.broadcast(missing.select(F.col("term").alias("w"))), rule).select(F.col("v").alias("term"))
    return asked.union(found).distinct()


def query_vector(terms: DataFrame, idf: DataFrame, unknown: float = UNKNOWN_IDF) -> DataFrame:
    """(term, q): after expansion each term occurs once, so its augmented frequency is 1 and its weight is its idf."""
    return terms.join(idf, "term", "left").select("term", F.coalesce("idf", F.lit(unknown)).alias("q"))


def cosine(weight: DataFrame, norm: DataFrame, vector: DataFrame, least: float = MIN_SCORE) -> DataFrame:
    """(id, score) of the sections that reach `least`."""
    length = vector.agg(F.sqrt(F.sum(F.col("q") * F.col("q"))).alias("qnorm"))
    # expansion follows the vocabulary, so whether the vector is broadcast is left to Spark, which checks its size
    dot = weight.join(vector, "term").groupBy("id").agg(F.sum(F.col("weight") * F.col("q")).alias("dot"))
    score = F.when(F.col("norm") * F.col("qnorm") == 0, 0.0).otherwise(F.col("dot") / (F.col("norm") * F.col("qnorm")))
    return dot.join(norm, "id").crossJoin(F.broadcast(length)).select("id", score.alias("score")).where(F.col("score") >= least)


def score_band(score: Column) -> Column:
    return F.when(score >= 0.20, "HIGH").when(score >= 0.10, "MEDIUM").when(score >= MIN_SCORE, "LOW")


def rank_confidence(one: Column, two: Column) -> Column:
    """HIGH if both ranks are among the first three, MEDIUM if one is."""
    a, b = F.coalesce(one <= 3, F.lit(False)), F.coalesce(two <= 3, F.lit(False))
    return F.when(a & b, "HIGH").when(a | b, "MEDIUM").otherwise("LOW")


def layer(one: Column, two: Column) -> Column:
    return F.when(one.isNotNull() & two.isNotNull(), "both layers").when(one.isNotNull(), "keyword only").otherwise("tfidf only")


def asked(spark: SparkSession, queries: dict[str, list[str]]) -> DataFrame:
    """(query, term) of the tokens of some queries by name."""
    return spark.createDataFrame([(q, t) for q, terms in queries.items() for t in dict.fromkeys(terms)], "query string, term string")


def top_of(value: str | None, default: int = 3) -> int:
    """How many results an option asks for: the whole number that it begins with; where there is none, or it is 0, the default."""
    found = re.match(r"\s*([+-]?[0-9]+)", value or "")
    return int(found[1]) or default if found else default


def rendered(rows: DataFrame, fields: list[str], order: list[Column], most: int, places: dict[str, int] | None = None) -> DataFrame:
    """(document): the first `most` rows as one JSON array of objects, some numbers with so many decimals, nulls as null."""
    values = [F.round(f, places[f]).alias(f) if places and f in places else F.col(f) for f in fields]
    best = rows.withColumn("_n", F.row_number().over(Window.orderBy(*order))).where(F.col("_n") <= most)
    every = F.transform(F.array_sort(F.collect_list(F.struct("_n", F.struct(*values).alias("r")))), lambda x: x["r"])
    return best.agg(F.to_json(every, {"ignoreNullFields": "false"}).alias("document"))


class Index:
    """A TF-IDF index of sections(id, ord, title, text), kept as tables below a path: built once, opened again, and added to. Queries may have a stop list of their own."""

    def __init__(self, postings: PostingIndex):
        self.postings, self.idf, self.sections = postings, postings.terms, postings.docs

    @property
    def norm(self) -> DataFrame:
        return self.postings.norms

    @classmethod
    def build(cls, sections: DataFrame, path: str | None = None, stop: list[str] | None = None) -> Index:
        return cls(PostingIndex.build(sections, path, stop))

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> Index:
        return cls(PostingIndex(spark, path))

    def added(self, sections: DataFrame) -> Index:
        return Index(self.postings.added(sections))

    def _asked(self, query: str, stop: list[str] | None, strict: bool = False) -> DataFrame:
        words = query_tokens(query, stop)
        if strict and not words:
            raise ValueError("the query has stop words only")
        return asked(self.postings.spark, {query: words})

    def semantic(self, query: str, strict: bool = False, stop: list[str] | None = None) -> DataFrame:
        """(id, score) of all sections that reach the least score. A query of stop words alone finds nothing, or with `strict` is an error."""
        return self.postings.search(self._asked(query, stop, strict), MIN_SCORE, UNKNOWN_IDF).select("id", "score")

    def best(self, query: str, top: int = 3, stop: list[str] | None = None) -> DataFrame:
        """(id, score, rank) of the best sections that reach the least score, without scoring those that can't be among them."""
        return self.postings.top(self._asked(query, stop), top, MIN_SCORE, UNKNOWN_IDF).select("id", "score", "rank")

    def keyword(self, query: str, stop: list[str] | None = None) -> DataFrame:
        return self.postings.keyword_hits(self._asked(query, stop)).select("id", "hits")

    def hybrid(self, query: str, top: int = 5) -> DataFrame:
        """The fused ranking: limit first, then titles, so a missing section shortens the result."""
        if top < 1:
            raise ValueError("top must be at least 1")
        kw = ranked_by_count(self.keyword(query), "hits").select("id", F.col("rank").alias("keyword_rank"))
        scored = self.semantic(query).withColumn("score", F.round("score", 9)).join(self.sections.select("id", "ord"), "id")
        tf = ranked_by_score(scored, "score", "ord").select("id", F.col("rank").alias("tfidf_rank"))
        one, two = F.col("keyword_rank"), F.col("tfidf_rank")
        share = lambda r: F.coalesce(1.0 / (RRF_K + r), F.lit(0.0))
        fused = kw.join(tf, "id", "full").withColumn("rrf", share(one) + share(two))
        best = fused.orderBy(F.desc("rrf"), F.asc("id")).limit(top)
        named = best.join(self.sections.select("id", "title"), "id")
        return named.select("id", "title", "rrf", "keyword_rank", "tfidf_rank", rank_confidence(one, two).alias("confidence"), layer(one, two).alias("layer"))
