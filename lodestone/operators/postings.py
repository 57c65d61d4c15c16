"""A kept TF-IDF index of sections(id, ord, title, text), searched without reading what cannot score.

Documents get numbers in the order in which they lie, and BUCKET neighbouring numbers are a bucket. Words are counted where a document lies, without a shuffle, and kept as a segment of raw postings, one row for each term and bucket with the documents and their shares. From all segments a state is made:
terms with their idf, norms, and blocks, one for each term and bucket, with the ids, their impacts (weight over norm, so a score is a sum of impacts) and the largest of them. What a state holds beside its terms is made when a query first asks for it. Blocks lie in files by ranges of terms, so a
query reads the row groups of its terms alone. As all terms' blocks of a bucket hold the same documents, the largest impacts of a query's terms add up to a bound on every score in the bucket: buckets
that can't reach the least score, or the k-th best score found so far, are never opened. New documents are a new segment; the next state reads the kept postings, not the texts, and equals a rebuild, as idf and norms change with every document.
A state counts once its mark is there, so a merge that fails leaves the one before in use.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import STOP_WORDS, tokens
from ..sources.kept import exists, fresh_path, listed, mark, moved, narrowed, prepare, settled, whole_groups
from .grams import GramIndex

#: Goes up with every change of what is written, so no index of another form is opened.
FORMAT = 2
#: Documents of one bucket, as a power of two.
BUCKET_BITS = 10
#: Buckets whose documents are scored first to learn what the k-th best score is at least.
FIRST = 8
#: Scores are compared after rounding to nine places, so a bound counts as reached if it is this close.
NEAR = 1e-9


def _counted(batches: Iterator[pa.RecordBatch], stop: frozenset[str]) -> Iterator[pa.RecordBatch]:
    """Of (docno, id, words array), in order of docno: (bucket, term, docs, ids, shares), a row for each bucket and term, with the places in the bucket, the ids and the augmented term frequencies 0.5 + 0.5 tf / max tf of its documents."""
    import pyarrow.compute as pc

    def block(held: list) -> pa.RecordBatch:
        part = pa.Table.from_batches(held).combine_chunks()
        coded = pc.dictionary_encode(part.column("term")).combine_chunks()
        order = np.argsort(coded.indices.to_numpy(), kind="stable")
        code = coded.indices.to_numpy()[order]
        first = np.flatnonzero(np.diff(code, prepend=-1))
        ends, docno = pa.array(np.append(first, len(code)).astype(np.int32)), part.column("docno").to_numpy()
        lists = lambda values: pa.ListArray.from_arrays(ends, values)
        docs, ids, shares = pa.array((docno[order] & (1 << BUCKET_BITS) - 1).astype(np.int32)), part.column("id").combine_chunks().take(pa.array(order)), pa.array(part.column("share").to_numpy()[order])
        return pa.RecordBatch.from_arrays([pa.array(docno[order][first] >> BUCKET_BITS), coded.dictionary.take(pa.array(code[first])), lists(docs), lists(ids), lists(shares)], ["bucket", "term", "docs", "ids", "shares"])

    held: list[pa.RecordBatch] = []
    for batch in batches:
        lists = batch.column(2)
        sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy().astype(np.int64)
        coded = pc.dictionary_encode(lists.flatten())
        known = coded.dictionary.to_pylist()
        if not known:
            continue
        keep = np.array([len(w) > 1 and w not in stop for w in known], dtype=bool)
        codes, row = coded.indices.to_numpy(), np.repeat(np.arange(len(sizes)), sizes)
        kept = keep[codes]
        both, tf = np.unique(row[kept] * len(known) + codes[kept], return_counts=True)
        if not len(both):
            continue
        row, code = both // len(known), both % len(known)
        first = np.flatnonzero(np.diff(row, prepend=-1))
        most = np.repeat(np.maximum.reduceat(tf, first), np.diff(np.append(first, len(row))))
        docno = batch.column(0).take(row)
        found = pa.RecordBatch.from_arrays([docno, batch.column(1).take(row), coded.dictionary.take(code), pa.array(0.5 + 0.5 * tf / most)], ["docno", "id", "term", "share"])
        bucket = docno.to_numpy() >> BUCKET_BITS
        edges = [0, *(np.flatnonzero(np.diff(bucket)) + 1).tolist(), len(bucket)]
        for i, j in zip(edges, edges[1:]):
            if held and held[-1].column(0)[0].as_py() >> BUCKET_BITS != bucket[i]:
                yield block(held)
                held = []
            held.append(found.slice(i, j - i))
    if held:
        yield block(held)


def _weighed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of (bucket, term, idf, docs, ids, shares), sorted by bucket: (term, bucket, best, ids, impacts, terms), a block for each row that weighs anything, and for each bucket a row without a term, with the ids, norms and numbers of terms of its documents."""
    for part in whole_groups(batches, 1):
        ends = part.column("docs").offsets.to_numpy()
        whole = slice(ends[0], ends[-1])
        starts = ends[:-1] - ends[0]
        docs, shares = (part.column(c).values.to_numpy()[whole] for c in ("docs", "shares"))
        ids = part.column("ids").values.slice(ends[0], ends[-1] - ends[0])
        # a table may hold several buckets: their documents are told apart
        which, bucket = np.unique(part.column("bucket").to_numpy(), return_inverse=True)
        sizes = np.diff(ends)
        place = (np.repeat(bucket, sizes) << BUCKET_BITS) + docs
        weight = shares * np.repeat(part.column("idf").to_numpy(), sizes)
        most = len(which) << BUCKET_BITS
        norm, terms = np.sqrt(np.bincount(place, weight * weight, minlength=most)), np.bincount(place, minlength=most)
        impact = np.divide(weight, norm[place], out=np.zeros(len(weight)), where=norm[place] > 0)
        best = np.maximum.reduceat(impact, starts)
        found, first = np.unique(place, return_index=True)
        cut = np.searchsorted(found, np.arange(len(which) + 1) << BUCKET_BITS).astype(np.int32)
        lists = lambda at, values: pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), values)
        names = ["term", "bucket", "best", "ids", "impacts", "terms"]
        kind = part.column("term").type
        yield pa.RecordBatch.from_arrays([pa.nulls(len(which), kind), pa.array(which), pa.nulls(len(which), pa.float64()), lists(cut, ids.take(pa.array(first))), lists(cut, pa.array(norm[found])), lists(cut, pa.array(terms[found]))], names)
        at = np.append(starts, len(impact))
        blocks = pa.RecordBatch.from_arrays([part.column("term"), part.column("bucket"), pa.array(best), lists(at, ids), lists(at, pa.array(impact)), pa.nulls(len(best), pa.list_(pa.int64()))], names)
        yield blocks.filter(pa.array(best > 0))  # a term of every document weighs nothing


class PostingIndex:
    """The index below a path. docs(id, ord, title), terms(term, df, idf), norms(id, terms, norm), blocks(term, bucket, best, ids, impacts), keywords(keyword, id), and the grams of keywords and of terms."""

    def __init__(self, spark: SparkSession, path: str):
        states = [s for s in listed(spark, path) if s.startswith("state-") and exists(spark, f"{path}/{s}/done")]
        if not states:
            raise FileNotFoundError(f"no whole index at {path}")
        self.spark, self.path, self.state = spark, path, f"{path}/{states[-1]}"
        prepare(spark)
        self.terms = spark.read.parquet(f"{self.state}/terms")
        self.segments = spark.read.text(f"{self.state}/segments").first()[0].split(" ")
        self.docs = self._segments("docs", self.segments)

    def _part(self, name: str, write: Callable[[str], None]) -> str:
        """The path of a part of the state that write(path) makes, where no query has asked for it before: under another name first, so what is there is whole."""
        path = f"{self.state}/{name}"
        if not exists(self.spark, path):
            building = fresh_path(self.spark, "index-part")
            write(building)
            moved(self.spark, building, path)
        return path

    @cached_property
    def _weighed(self) -> DataFrame:
        return self.spark.read.parquet(self._part("weighed", self._write_weighed))

    @cached_property
    def norms(self) -> DataFrame:
        each = F.explode(F.arrays_zip("ids", "terms", "impacts")).alias("d")
        return self._weighed.where("term is null").select(each).select(F.col("d.ids").alias("id"), F.col("d.terms").alias("terms"), F.col("d.impacts").alias("norm"))

    @cached_property
    def blocks(self) -> DataFrame:
        rows = lambda: self._weighed.where("term is not null").drop("terms")
        return self.spark.read.parquet(self._part("blocks", lambda path: _sorted(rows(), "term", "bucket").write.parquet(path)))

    @cached_property
    def keywords(self) -> DataFrame:
        return self.spark.read.parquet(self._part("keywords", self._write_keywords))

    @cached_property
    def prefixes(self) -> DataFrame:
        return self.spark.read.parquet(self._part("prefixes", self._write_prefixes))

    @cached_property
    def term_grams(self) -> GramIndex:
        return GramIndex.open(self.spark, self._part("term-grams", lambda path: GramIndex.write(self.terms.select(F.col("term").alias("word")), path, shortest=3)))

    @cached_property
    def keyword_grams(self) -> GramIndex:
        return GramIndex.open(self.spark, self._part("keyword-grams", lambda path: GramIndex.write(self.keywords.select(F.col("keyword").alias("word")).distinct(), path)))

    def _write_weighed(self, path: str) -> None:
        rows = self._segments("counts", self.segments).join(self.terms.select("term", "idf"), "term").select("bucket", "term", "idf", "docs", "ids", "shares")
        kind = rows.schema["ids"].dataType.simpleString()
        dealt = rows.repartition("bucket").sortWithinPartitions("bucket")  # a bucket's documents are weighed in one place
        dealt.mapInArrow(_weighed, f"term string, bucket long, best double, ids {kind}, impacts array<double>, terms array<long>").write.parquet(path)

    def _write_keywords(self, path: str) -> None:
        keywords = self.docs.select("id", F.explode(F.array_distinct(tokens(F.col("title")))).alias("keyword")).where(F.length("keyword") >= 4)
        _sorted(keywords.select("keyword", "id"), "keyword", "id").write.parquet(path)

    def _write_prefixes(self, path: str) -> None:
        # a word's beginnings of four or more characters that make up 0.6 of it
        shortest = F.greatest(F.lit(4), F.ceil(F.length("term") * 0.6).cast("int"))
        heads = F.when(F.length("term") >= 4, F.transform(F.sequence(shortest, F.length("term")), lambda n: F.substring(F.col("term"), F.lit(1), n)))
        prefixes = self.terms.select("term", F.explode(heads).alias("prefix")).where(F.length("prefix") >= 0.6 * F.length("term"))
        _sorted(prefixes.select("prefix", "term"), "prefix", "term").write.parquet(path)

    def _segments(self, name: str, segments: list[str]) -> DataFrame:
        return self.spark.read.parquet(*[f"{self.path}/{name}/{s}" for s in segments])

    @classmethod
    def build(cls, sections: DataFrame, path: str | None = None, stop: list[str] | None = None) -> PostingIndex:
        spark = sections.sparkSession
        path = path or fresh_path(spark, "index")
        prepare(spark)
        _write_segment(sections, path, 0, STOP_WORDS if stop is None else stop)
        _write_state(spark, path, ["segment-000000"], 0)
        return cls(spark, path)

    def added(self, sections: DataFrame, stop: list[str] | None = None) -> PostingIndex:
        """The index with more sections, whose ids are new: their segment, and a state of all segments."""
        taken = [int(s[8:]) for s in listed(self.spark, f"{self.path}/docs")]
        number = max(taken) + 1
        _write_segment(sections, self.path, number, STOP_WORDS if stop is None else stop)
        _write_state(self.spark, self.path, [*self.segments, f"segment-{number:06d}"], int(self.state[-6:]) + 1)
        return PostingIndex(self.spark, self.path)

    def weights(self) -> DataFrame:
        """(id, term, weight): the raw weights, from the kept segments."""
        blocks = self._segments("counts", self.segments).join(self.terms.select("term", "idf"), "term")
        each = blocks.select("term", "idf", F.explode(F.arrays_zip("ids", "shares")).alias("p"))
        return each.select(F.col("p.ids").alias("id"), "term", (F.col("p.shares") * F.col("idf")).alias("weight"))

    def expanded(self, asked: DataFrame) -> DataFrame:
        """(query, term) of asked(query, term): the terms and, for those of four or more characters that the vocabulary lacks, its near relatives: words they begin and make up most of, words of four or more that begin them, and, from five characters on, words around them."""
        asked = settled(asked.select("query", "term").distinct())
        known = narrowed(self.terms, "term", asked, "term").select("term")
        missing = settled(asked.where(F.length("term") >= 4).join(known, "term", "left_anti").select("term").distinct())
        begun = narrowed(self.prefixes, "prefix", missing, "term").select(F.col("prefix").alias("term"), F.col("term").alias("near"))
        heads = settled(missing.select("term", F.explode(F.transform(F.sequence(F.lit(4), F.length("term")), lambda n: F.substring(F.col("term"), F.lit(1), n))).alias("near")))
        heads = narrowed(self.terms, "term", heads, "near").select(F.col("term").alias("near")).join(heads, "near").select("term", "near")
        around = self.term_grams.containing(missing.where(F.length("term") >= 5).select(F.col("term").alias("token"))).select(F.col("token").alias("term"), F.col("word").alias("near"))
        near = begun.unionByName(heads).unionByName(around)
        return asked.unionByName(asked.join(near, "term").select("query", F.col("near").alias("term"))).distinct()

    def vectors(self, asked: DataFrame, unknown: float) -> DataFrame:
        """(query, term, q) of asked(query, term): after expansion each term occurs once, so its augmented frequency is 1, and q is its idf over the length of the query's vector."""
        every = settled(self.expanded(asked))
        idf = narrowed(self.terms, "term", every, "term").select("term", "idf")
        raw = every.join(idf, "term", "left").select("query", "term", F.coalesce("idf", F.lit(unknown)).alias("q"))
        length = raw.groupBy("query").agg(F.sqrt(F.sum(F.col("q") * F.col("q"))).alias("length")).where("length > 0")
        return raw.join(length, "query").select("query", "term", (F.col("q") / F.col("length")).alias("q"))

    def hits(self, vectors: DataFrame) -> DataFrame:
        """The blocks of the terms of vectors(query, term, q), with q."""
        return narrowed(self.blocks, "term", vectors, "term").join(vectors, "term")

    @staticmethod
    def bounds(hits: DataFrame) -> DataFrame:
        """(query, bucket, bound): no document of the bucket scores more. Reads the blocks' largest impacts, not the blocks."""
        return hits.groupBy("query", "bucket").agg(F.sum(F.col("q") * F.col("best")).alias("bound"))

    @staticmethod
    def scores(hits: DataFrame, buckets: DataFrame) -> DataFrame:
        """(query, id, score) of the documents in buckets(query, bucket)."""
        each = hits.join(buckets.select("query", "bucket"), ["query", "bucket"]).select("query", "q", F.explode(F.arrays_zip("ids", "impacts")).alias("p"))
        return each.groupBy("query", F.col("p.ids").alias("id")).agg(F.sum(F.col("q") * F.col("p.impacts")).alias("score"))

    def search(self, asked: DataFrame, least: float, unknown: float) -> DataFrame:
        """(query, id, score) of every section that reaches `least` for the queries asked(query, term), whose rows are their distinct tokens."""
        hits = self.hits(settled(self.vectors(asked, unknown)))
        return self.scores(hits, self.bounds(hits).where(F.col("bound") >= least - NEAR)).where(F.col("score") >= least)

    def top(self, asked: DataFrame, k: int, least: float, unknown: float) -> DataFrame:
        """(query, id, score, rank) of the k best sections for each query, those of equal score (to nine places) by id."""
        hits = self.hits(settled(self.vectors(asked, unknown)))
        bounds = settled(self.bounds(hits).where(F.col("bound") >= least - NEAR))
        first = _ranked(bounds, FIRST, F.desc("bound"), F.asc("bucket")).select("query", "bucket")
        found = settled(self.scores(hits, first).where(F.col("score") >= least))
        rest = self.scores(hits, self.open_after(bounds, first, found, k)).where(F.col("score") >= least)
        return _best(found.unionByName(rest), k)

    @staticmethod
    def open_after(bounds: DataFrame, first: DataFrame, found: DataFrame, k: int) -> DataFrame:
        """The buckets beyond the first that may hold one of the k best, by the k-th best score found in those."""
        reached = _best(found, k).where(F.col("rank") == k).select("query", (F.col("score") - 2 * NEAR).alias("floor"))
        return bounds.join(first, ["query", "bucket"], "left_anti").join(reached, "query", "left").where((F.col("bound") >= F.col("floor")) | F.col("floor").isNull())

    def keyword_hits(self, asked: DataFrame) -> DataFrame:
        """(query, id, hits, matches) of asked(query, term): tokens that some keyword of the section contains, and all (token, keyword) matches."""
        words = self.keyword_grams.containing(asked.select(F.col("term").alias("token"))).select(F.col("token").alias("term"), F.col("word").alias("keyword"))
        words = settled(words)
        held = narrowed(self.keywords, "keyword", words, "keyword").join(words, "keyword")
        # what a section holds is counted before queries come in, and stays where the section is
        each = held.select("id", "term").repartition("id").groupBy("id", "term").agg(F.count("*").alias("n"))
        each = each.join(asked.select("query", "term").distinct(), "term")
        return each.groupBy("id", "query").agg(F.count("*").alias("hits"), F.sum("n").alias("matches")).select("query", "id", "hits", "matches")


def _ranked(rows: DataFrame, k: int, *order) -> DataFrame:
    """The first k rows of each query. Spark keeps k rows of a query in each task before they meet."""
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(*order))).where(F.col("rank") <= k)


def _best(scores: DataFrame, k: int) -> DataFrame:
    return _ranked(scores, k, F.desc(F.round("score", 9)), F.asc("id"))


def _write_segment(sections: DataFrame, path: str, number: int, stop: list[str]) -> None:
    name = f"segment-{number:06d}"
    base = number << 56  # a number holds the segment, the partition and the place in it
    numbered = sections.select("id", "text", (F.monotonically_increasing_id() + F.lit(base)).alias("docno"))
    words = F.split(F.regexp_replace(F.lower("text"), "[^a-z0-9]+", " "), " ")
    kind = sections.schema["id"].dataType.simpleString()
    left_out = frozenset(stop)
    numbered.select("docno", "id", words.alias("words")).mapInArrow(lambda b: _counted(b, left_out), f"bucket long, term string, docs array<int>, ids array<{kind}>, shares array<double>").write.parquet(f"{path}/counts/{name}")
    sections.select("id", "ord", "title").write.parquet(f"{path}/docs/{name}")


def _sorted(rows: DataFrame, *by: str) -> DataFrame:
    return rows.repartitionByRange(*by).sortWithinPartitions(*by)


def _write_state(spark: SparkSession, path: str, segments: list[str], number: int) -> None:
    state = f"{path}/state-{number:06d}"
    read = lambda name: spark.read.parquet(*[f"{path}/{name}/{s}" for s in segments])
    counts, total = read("counts"), float(read("docs").count())
    terms = counts.groupBy("term").agg(F.sum(F.size("ids")).alias("df")).withColumn("idf", F.log(F.lit(total) / F.col("df")))
    _sorted(terms, "term").write.parquet(f"{state}/terms")
    spark.createDataFrame([(" ".join(segments),)], "value string").coalesce(1).write.text(f"{state}/segments")
    mark(spark, f"{state}/done")
