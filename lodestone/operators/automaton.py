"""Many patterns at once: Aho-Corasick automata over Arrow batches of texts, so a text is read once however many patterns there are.

Patterns come as rows. Their sizes are added up first; they are dealt by hash into blocks of about BLOCK_CHARS characters, and only one block at a time passes through the driver and is broadcast, each for one pass over the texts. A worker builds a block's automaton once.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.kept import prepare

#: Characters of the patterns of one automaton, about.
BLOCK_CHARS = 1 << 20
#: Rows of one Arrow batch of results.
OUT_ROWS = 20_000
_built: dict[tuple, object] = {}


def _automaton(key: str, words: list[str], fold: bool = False):
    """This worker's automaton of some words; those of other keys go, as blocks come one after the other."""
    if (key, fold) not in _built:
        import ahocorasick

        for other in [k for k in _built if k[0] != key]:
            del _built[other]
        made = ahocorasick.Automaton()
        for i, w in enumerate(words):
            made.add_word(w, i)
        made.make_automaton()
        _built[key, fold] = made
    return _built[key, fold]


def _batches(rows: Iterator[tuple], names: list[str], kinds: list[pa.DataType]) -> Iterator[pa.RecordBatch]:
    out: list[tuple] = []
    for r in rows:
        out.append(r)
        if len(out) >= OUT_ROWS:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names)
            out = []
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names)


def found(texts: DataFrame, patterns: DataFrame) -> DataFrame:
    """(id, pattern, at) of texts(id, text) and patterns(pattern): each pattern that a text contains, once, with the first place where it begins, in code points from 0. A null text contains nothing, the empty pattern is in every other."""
    spark = texts.sparkSession
    prepare(spark)
    patterns = patterns.select("pattern").where("pattern is not null").distinct()
    blocks = max(1, -(-(patterns.agg(F.sum(F.length("pattern") + 1)).first()[0] or 0) // BLOCK_CHARS))
    kind = texts.schema["id"].dataType.simpleString()
    parts = []
    for block in range(blocks):
        words = [r[0] for r in patterns.where(F.pmod(F.xxhash64("pattern"), F.lit(blocks)) == block).collect()]
        if words:
            parts.append(texts.select("id", "text").mapInArrow(_first_places(spark.sparkContext.broadcast(words)), f"id {kind}, pattern string, at long"))
    return reduce(DataFrame.unionByName, parts) if parts else texts.select("id", F.col("text").alias("pattern"), F.lit(0).cast("long").alias("at")).where("false")


def _first_places(shared) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    key = uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: list[str] = shared.value
        everywhere = "" in words
        solid = [w for w in words if w]
        sizes = [len(w) for w in solid]
        for batch in batches:
            ids = batch.column(0)

            def hits(batch=batch):
                for row, text in enumerate(batch.column(1)):
                    text = text.as_py()
                    if text is None:
                        continue
                    first: dict[int, int] = {}
                    if solid:
                        for end, i in _automaton(key, solid).iter(text):
                            first.setdefault(i, end + 1 - sizes[i])
                    if everywhere:
                        yield row, "", 0
                    for i, at in first.items():
                        yield row, solid[i], at

            for part in _batches(hits(), ["row", "pattern", "at"], [pa.int64(), pa.string(), pa.int64()]):
                yield pa.RecordBatch.from_arrays([ids.take(part.column(0)), part.column(1), part.column(2)], ["id", "pattern", "at"])

    return run


@dataclass(frozen=True)
class Listed:
    """A rule of listed words. `fold` takes ASCII letters of any case; `left` and `right` want no ASCII letter, digit or _ beside the word; `before` is a text that must follow and is no part of the hit; `once` tells of each word once a text and knows no allowance."""

    name: str
    words: tuple[str, ...]
    fold: bool = False
    left: bool = True
    right: bool = True
    before: str = ""
    once: bool = False


_WORD = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789_")


def _folded(text: str) -> str:
    return text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")  # bytes fold ASCII letters alone


def _hits(rule: Listed, spans: list[tuple[int, int, int]], text: str) -> Iterator[str]:
    """The rule's hits among spans(start, word number, end) of its words: from the left, of words that begin at one place the first of the list that fits, none over another."""
    if rule.once:
        yield from (rule.words[i] for i in sorted({i for _, i, _ in spans}))
        return
    upto = 0
    for start, _, end in sorted(spans):
        if start < upto or rule.left and start and text[start - 1] in _WORD or rule.right and text[end : end + 1] in _WORD and end < len(text) or rule.before and not text.startswith(rule.before, end):
            continue
        upto = end
        yield text[start:end]


def listed(texts: DataFrame, rules: list[Listed], allow: list[str]) -> DataFrame:
    """(id, rule, hit) of texts(id, text): the hits of all rules from one pass over each text (two, where some rules fold)."""
    prepare(texts.sparkSession)
    kind = texts.schema["id"].dataType.simpleString()
    allowed, key = frozenset(allow), uuid.uuid4().hex
    plans = []
    for fold in (False, True):
        words: dict[str, list[tuple[int, int]]] = {}
        for k, rule in enumerate(rules):
            for i, w in enumerate(rule.words):
                if w and rule.fold == fold:
                    words.setdefault(_folded(w) if fold else w, []).append((k, i))
        if words:
            plans.append((fold, list(words), list(words.values())))
    shared = texts.sparkSession.sparkContext.broadcast(plans)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)

            def hits(batch=batch):
                for row, text in enumerate(batch.column(1)):
                    text = text.as_py()
                    spans: dict[int, list] = {}
                    for fold, words, owners in shared.value if text else ():
                        for end, n in _automaton(key, words, fold).iter(_folded(text) if fold else text):
                            for k, i in owners[n]:
                                spans.setdefault(k, []).append((end + 1 - len(words[n]), i, end + 1))
                    for k in sorted(spans):
                        for hit in _hits(rules[k], spans[k], text):
                            if rules[k].once or hit not in allowed:
                                yield row, rules[k].name, hit

            for part in _batches(hits(), ["row", "rule", "hit"], [pa.int64(), pa.string(), pa.string()]):
                yield pa.RecordBatch.from_arrays([ids.take(part.column(0)), part.column(1), part.column(2)], ["id", "rule", "hit"])

    return texts.select("id", "text").mapInArrow(run, f"id {kind}, rule string, hit string")

