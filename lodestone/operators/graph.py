"""Weighted-link neighbours, symptom matching and section reading."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import automaton
from .search import ranked_by_count, ranked_by_score


def neighbours(seeds: DataFrame, edges: DataFrame, threshold: float = 0.78, best: bool = False) -> DataFrame:
    """(dst, relevance, via, reason) of seeds(src, seed_pos) over edges(src, pos, dst, relevance, reason), seeds left out.

    A neighbour of several seeds keeps the first seed's link, or with `best` the strongest."""
    reached = seeds.join(edges, "src").where(F.col("relevance") >= threshold).join(seeds.select(F.col("src").alias("dst")), "dst", "left_anti")
    order = [F.desc("relevance"), "seed_pos", "pos"] if best else ["seed_pos", "pos"]
    first = reached.withColumn("n", F.row_number().over(Window.partitionBy("dst").orderBy(*order))).where("n = 1")
    return first.select("dst", "relevance", F.col("src").alias("via"), "reason", "seed_pos", "pos")


def in_order(found: DataFrame) -> DataFrame:
    """neighbours() with their rank: by relevance, those of equal relevance in the order in which they were discovered."""
    return ranked_by_score(found, "relevance", "seed_pos", "pos")


def titled(rows: DataFrame, id_column: str, titles: DataFrame) -> DataFrame:
    """rows with `title`, that of titles(id, title) or, where there is none, a default that names the id."""
    named = rows.join(titles.select(F.col("id").alias(id_column), "title"), id_column, "left")
    return named.withColumn("title", F.coalesce("title", F.concat(F.lit("Section "), F.col(id_column).cast("string"))))


def symptoms(texts: DataFrame, patterns: DataFrame) -> DataFrame:
    """(id, symptom, matched array) of texts(id, text) that contain one of a symptom's patterns(symptom, pattern array), letters of any case, patterns in their order.

    One automaton finds all patterns in one pass over the texts; what it found is then joined with the symptoms by pattern. Ids of texts are unique."""
    low = texts.select("id", F.lower("text").alias("text"))
    single = patterns.select("symptom", F.posexplode("pattern").alias("pos", "pattern")).withColumn("p", F.lower("pattern"))
    found = automaton.found(low, single.select(F.col("p").alias("pattern"))).select("id", F.col("pattern").alias("p"))
    hits = found.join(single, "p")
    return hits.groupBy("id", "symptom").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "pattern"))), lambda x: x["pattern"]).alias("matched"))


def diagnoses(found: DataFrame, lessons: DataFrame, titles: DataFrame) -> DataFrame:
    """(id, symptom, matched, hint, lesson, title): symptoms() with the hint and each of the lessons(symptom, hint, lesson array) that help, with their titles or defaults."""
    rows = found.join(lessons, "symptom").select("id", "symptom", "matched", "hint", F.explode("lesson").alias("lesson"))
    return titled(rows, "lesson", titles)


def fetch(sections: DataFrame) -> DataFrame:
    """sections(…, text, start_line, end_line) with `body`, those lines: from 1 if start is missing, to the end if end is."""
    lines = F.split("text", "\n")
    start = F.greatest(F.coalesce("start_line", F.lit(1)), F.lit(1))
    stop = F.least(F.coalesce("end_line", F.size(lines)), F.size(lines))
    return sections.withColumn("body", F.array_join(F.slice(lines, start, F.greatest(stop - start + 1, F.lit(0))), "\n"))


def by_id(sections: DataFrame) -> DataFrame:
    """sections(file, id, ...) with their rank by id within their file."""
    return ranked_by_count(sections.withColumn("_all", F.lit(0)), "_all", by=("file",)).drop("_all")


def listing(sections: DataFrame) -> DataFrame:
    """(file, first_ord, sections, ...): sections by file, with the order of first appearance."""
    return sections.groupBy("file").agg(F.min("ord").alias("first_ord"), F.count("*").alias("sections"), F.min("id").alias("first_id"), F.max("id").alias("last_id"), F.sum("line_count").alias("lines"))


#: Items of one row of a nested listing.
PAGE_ITEMS = 10_000


def nested(sections: DataFrame, group: str, *fields: str, most: int = PAGE_ITEMS) -> DataFrame:
    """(group, first_ord, page, items): a group's rows in order, `most` to a row, so a large group is several rows of pages 0, 1, ... and no row is larger; groups are told in order by first appearance. ord tells rows of a group apart."""
    placed = ranked_by_count(sections.select(group, "ord", *fields).withColumns({"_all": F.lit(0), "id": F.col("ord"), **{f"_{f}": F.col(f) for f in fields}}), "_all", by=(group,))
    items = F.transform(F.array_sort(F.collect_list(F.struct("ord", *[F.col(f"_{f}").alias(f) for f in fields]))), lambda x: F.struct(*[x[f].alias(f) for f in fields]))
    pages = placed.groupBy(group, F.floor((F.col("rank") - 1) / most).alias("page")).agg(items.alias("items"))
    return pages.join(sections.groupBy(group).agg(F.min("ord").alias("first_ord")), group).select(group, "first_ord", "page", "items")


def merged(first: DataFrame, second: DataFrame, key: str) -> DataFrame:
    """The union of two sources, one row for each key, the first source's where both have it."""
    rows = first.withColumn("_p", F.lit(0)).unionByName(second.withColumn("_p", F.lit(1)))
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy("_p", "ord"))).where("_n = 1").drop("_p", "_n")
