"""Spelling variant grouping by a symmetric-delete join.

Words are counted over all texts; each emits a key for itself and one for each of its distinct single deletions, and an equi-join of equal keys finds the candidates. A key is a 64-bit sum of mixed (place, code point) pairs, so all
keys of a word take time and space in proportion to its length; with a deletion goes the range of places whose deletion gives that string, and two deletions of one key are candidates only where their ranges meet,
which is where one code point is replaced. Every candidate is then verified on the words themselves, so equal hashes do no harm, and every pair at distance one meets at exactly one key.
A key is shared by its own word and the words that insert one code point: at most 90 code points at each place, whatever the size of the corpus, so no key can hold a share of all rows.

A word's form is its near word of the largest count, if that is `ratio` times its own at least; equal counts go to the smaller word. Counts grow along forms, so following them ends; roots are joined by pointer doubling, each round a written table.

Cases: null and empty texts have no words; a run of any length is one word; a null doc_id counts as empty in the hash that drops letters; repeated rows count each; an empty table has no rows; other columns are left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import _words as W
from ._shared import cut

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
RUNS = "[A-Za-zÀ-ÿ]+"
_U = np.uint64
_KEYS = pa.schema([("key", pa.int64()), ("id", pa.int64()), ("n", pa.int64()), ("first", pa.int32()), ("last", pa.int32())])


def word_counts(docs: DataFrame, least_length: int = 6, least: int = 5, every: int = 199) -> DataFrame:
    """(word, n): lower-cased runs of letters of all texts; where `every` divides the crc32 of <doc_id>:<run>, the run's code point crc32 % length is left out."""
    low = F.translate("text", UPPER, UPPER.lower())
    runs = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("doc_id"), F.explode(F.regexp_extract_all(low, F.lit(RUNS), F.lit(0))).alias("run"))
    runs = runs.where(F.length("run") >= least_length)  # leaving out a code point makes no word longer
    sign = F.crc32(F.concat("doc_id", F.lit(":"), "run").cast("binary"))
    place = (sign % F.length("run")).cast("int")
    word = F.when(sign % every == 0, F.concat(F.substring("run", F.lit(1), place), F.substring("run", place + 2, F.length("run")))).otherwise(F.col("run"))
    counted = runs.select(word.alias("word")).where(F.length("word") >= least_length).groupBy("word").agg(F.count("*").alias("n"))
    return counted.where(F.col("n") >= least)


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of (id, word, n): a row for the word itself (first and last -1) and one for each distinct deletion, with the places that give it."""
    for batch in batches:
        words = batch.column(1).to_pylist()
        i = 0
        while i < len(words):
            j, size = i, 0
            while j < len(words) and (j == i or size + len(words[j]) <= 200_000):
                size += len(words[j])
                j += 1
            yield _keys_of(words[i:j], np.asarray(batch.column(0))[i:j], np.asarray(batch.column(2))[i:j])
            i = j


def _keys_of(words: list[str], ids: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
    codes = np.frombuffer("".join(words).encode("utf-32-le"), dtype=np.uint32).astype(np.uint64)
    length = np.array([len(w) for w in words], dtype=np.int64)
    ends = np.cumsum(length)
    begins = ends - length
    word = np.repeat(np.arange(len(words)), length)
    place = np.arange(len(codes)) - begins[word]
    here = np.concatenate([[_U(0)], np.cumsum(W.mix(codes << _U(40) ^ place.astype(np.uint64)), dtype=np.uint64)])
    moved = np.concatenate([[_U(0)], np.cumsum(W.mix(codes << _U(40) ^ (place - 1).astype(np.uint64)), dtype=np.uint64)])  # each code point a place further left
    done = lambda total, size: W.mix(total ^ W.mix(size.astype(np.uint64) + _U(1))).view(np.int64)
    whole = done(here[ends] - here[begins], length)
    edge = np.ones(len(codes) + 1, dtype=bool)  # between unequal neighbours
    edge[1:-1] = (codes[1:] != codes[:-1]) | (word[1:] != word[:-1])
    first, last = np.flatnonzero(edge[:-1]), np.flatnonzero(edge[1:])  # of runs of one code point
    of = word[first]
    less = done((here[first] - here[begins[of]]) + (moved[ends[of]] - moved[first + 1]), length[of] - 1)
    none = np.full(len(words), -1)
    columns = [np.concatenate(x) for x in ((whole, less), (ids, ids[of]), (counts, counts[of]), (none, place[first]), (none, place[last]))]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _KEYS, strict=True)], schema=_KEYS)


def _one_apart(a: Column, b: Column, place: Column, a_less: Column, b_less: Column) -> Column:
    """Whether words a and b are equal but for the code point at place, which a or b or both have."""
    rest = lambda w, less: F.substring(w, place + F.when(less, 2).otherwise(1), F.length(w))
    return (F.substring(a, F.lit(1), place) == F.substring(b, F.lit(1), place)) & (rest(a, a_less) == rest(b, b_less)) & (a != b)


def near_words(words: DataFrame) -> DataFrame:
    """(a, b) of words(id, word, n): the ids of all pairs of words that differ by exactly one inserted, deleted or replaced code point, each once."""
    keys = cut(words.select("id", "word", "n").mapInArrow(_keys, "key long, id long, n long, first int, last int"), "spelling-keys")
    x = keys.select("key", F.col("id").alias("a"), F.col("first").alias("a_first"), F.col("last").alias("a_last"))
    y = keys.select("key", F.col("id").alias("b"), F.col("first").alias("b_first"), F.col("last").alias("b_last"))
    inserted = (F.col("a_first") < 0) != (F.col("b_first") < 0)
    replaced = (F.col("a_first") >= 0) & (F.col("b_first") >= 0) & (F.col("a_first") <= F.col("b_last")) & (F.col("b_first") <= F.col("a_last"))
    met = x.join(y, "key").where((F.col("a") < F.col("b")) & (inserted | replaced))
    met = met.select("a", "b", F.greatest("a_first", "b_first").alias("place"), (F.col("a_first") >= 0).alias("a_less"), (F.col("b_first") >= 0).alias("b_less"))
    for side in "ab":
        met = met.join(words.select(F.col("id").alias(side), F.col("word").alias(f"{side}_word")), side)
    return met.where(_one_apart(F.col("a_word"), F.col("b_word"), F.col("place"), F.col("a_less"), F.col("b_less"))).select("a", "b")


def roots(forms: DataFrame) -> DataFrame:
    """(id, root) of forms(id, form): the last word that forms lead to, for words that have one. Forms must not run in circles."""
    reach = cut(forms.select("id", F.col("form").alias("root")), "spelling-roots")
    while True:
        further = reach.select(F.col("id").alias("root"), F.col("root").alias("beyond"))
        longer = cut(reach.join(further, "root", "left").select("id", F.coalesce("beyond", "root").alias("root"), F.col("beyond").isNotNull().alias("moved")), "spelling-roots")
        if longer.where("moved").isEmpty():
            return reach
        reach = longer.select("id", "root")


def variants(counted: DataFrame, ratio: int = 5) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of counted(word, n)."""
    words = cut(counted.select(F.monotonically_increasing_id().alias("id"), "word", "n"), "spelling-words")
    near = cut(near_words(words), "spelling-near")
    other = words.select(F.col("id").alias("form"), F.col("word").alias("form_word"), F.col("n").alias("form_n"))
    both = near.select(F.col("a").alias("id"), F.col("b").alias("form")).unionByName(near.select(F.col("b").alias("id"), F.col("a").alias("form")))
    best = both.join(other, "form").groupBy("id").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("form_n")).alias("order"), "form_word", "form", "form_n")).alias("best"))
    known = cut(words.join(best, "id", "left").select("*", F.when(F.col("best.form_n") >= ratio * F.col("n"), F.col("best")).alias("up")), "spelling-forms")
    ends = roots(known.where("up is not null").select("id", F.col("up.form").alias("form")))
    named = ends.join(words.select(F.col("id").alias("root"), F.col("word").alias("root_word")), "root").select("id", "root_word")
    found = known.join(named, "id", "left")
    return found.select("word", F.col("up.form_word").alias("form"), F.coalesce("root_word", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.col("up.form_n").alias("form_n"))
