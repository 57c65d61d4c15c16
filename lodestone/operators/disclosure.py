"""A text scanner for what must not be published: shape rules, a never list, an allow list and quote budgets.

The rules are neutral and are parameters. Boundaries are ASCII, spelt out, as Java's know all letters."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import LEFT, RIGHT, html_to_prose
from ..sources.json_walk import readable_text
from .automaton import Listed, listed

# Shapes by rule, each as (rule, pattern, least length of a hit); the most words of a quoted span and of all spans of a text; what a quoted span is.
RULES = [
    ("digit-run", LEFT + "[0-9]{8,}" + RIGHT, 0),
    ("camel-case", LEFT + "[a-z]+(?:[A-Z][a-z0-9]+){2,}" + RIGHT, 12),
    ("snake-case", LEFT + "[a-z]+(?:_[a-z0-9]+){2,}" + RIGHT, 0),
    # from the begin of a run, or where the hit before ended, so that a long run is looked at once
    ("e-mail", "(?:\\G|(?<![A-Za-z0-9._+-]))[A-Za-z0-9._+-]+@[A-Za-z0-9-]+(?:[.][A-Za-z0-9-]+)+", 0),
    ("ipv4", LEFT + "[0-9]{1,3}(?:[.][0-9]{1,3}){3}" + RIGHT, 0),
    ("hex-key", LEFT + "[0-9a-f]{32,}" + RIGHT, 0),
]
NEVER = ["BEGIN PRIVATE KEY", "password ="]
ALLOW = ["127.0.0.1", "0.0.0.0"]
SPAN_WORDS, TEXT_WORDS = 15, 40
QUOTE = "[“\"]([^”\"]{2,})[”\"]"


def _any_of(names: list[str]) -> str:
    return "(?:" + "|".join(re.escape(n) for n in names) + ")"


def prefixed(prefixes: list[str]) -> tuple[str, str, int]:
    """Identifiers that begin with one of these prefixes and go on in lower-case letters, digits and _."""
    return "prefixed", LEFT + _any_of(prefixes) + "[a-z0-9_]+" + RIGHT, 0


def namespaced(spaces: list[str] | None = None) -> tuple[str, str, int]:
    """Identifiers a__b, of these namespaces or of any."""
    return "namespaced", LEFT + (_any_of(spaces) if spaces else "[a-z][a-z0-9]*") + "__[a-z][a-z0-9_]*" + RIGHT, 0


def called(symbols: list[str]) -> Listed:
    """Curated symbols before an opening bracket, which is no part of the hit."""
    return Listed("called", tuple(symbols), right=False, before="(")


def worded(words: list[str]) -> Listed:
    """Curated words, letters of any case."""
    return Listed("worded", tuple(words), fold=True)


#: A sign that every hit of a shape has, so that texts without it are not searched for the shape.
NEEDS = {"snake-case": "_", "e-mail": "@", "namespaced": "__"}


def scan(texts: DataFrame, rules=None, never=None, allow=None) -> DataFrame:
    """(id, rule, hit) of texts(id, text): each shape's hits but those allowed, those of listed words, and the never list's entries, which no allowance covers.

    Shapes are patterns for the JVM; all lists are one automaton, whatever their length."""
    rules, never, allow = rules if rules is not None else RULES, never if never is not None else NEVER, allow if allow is not None else ALLOW

    def shaped(name: str, pattern: str, least: int):
        hits = F.filter(F.regexp_extract_all("text", F.lit(pattern), F.lit(0)), lambda h: (F.length(h) >= least) & ~h.isin(allow))
        rows = F.transform(hits, lambda h: F.struct(F.lit(name).alias("rule"), h.alias("hit")))
        return F.when(F.contains("text", F.lit(NEEDS[name])), rows).otherwise(F.array().cast("array<struct<rule: string, hit: string>>")) if name in NEEDS else rows

    shapes = [r for r in rules if not isinstance(r, Listed)]
    lists = [r for r in rules if isinstance(r, Listed)] + ([Listed("never", tuple(never), left=False, right=False, once=True)] if never else [])
    parts = [texts.select("id", F.explode(F.concat(*[shaped(*r) for r in shapes])).alias("h")).select("id", "h.rule", "h.hit")] if shapes else []
    if lists:
        parts.append(listed(texts, lists, allow))
    return reduce(DataFrame.unionByName, parts)


def quotes(texts: DataFrame, key: str = "id") -> DataFrame:
    """(key, spans, words, long_spans, over_budget): quoted words of all texts of a key; long spans and sums over the budget are flags, not failures."""
    spans = texts.select(key, F.explode_outer(F.regexp_extract_all("text", F.lit(QUOTE), F.lit(1))).alias("span"))
    words = F.when(F.col("span").isNull(), 0).otherwise(F.size(F.split(F.trim("span"), r"\s+")))
    counted = spans.select(key, "span", words.alias("words")).groupBy(key).agg(F.count("span").alias("spans"), F.sum("words").cast("long").alias("words"), F.count_if(F.col("words") > SPAN_WORDS).alias("long_spans"))
    return counted.withColumn("over_budget", F.col("words") > TEXT_WORDS)


def scope(files: DataFrame) -> DataFrame:
    """files(id, ext, content) as (id, text) to scan: prose of HTML, string values of JSON with their escapes read, all else as it is; JSON that cannot be read is scanned raw."""
    plain = files.where("ext is null or ext <> 'json'").select("id", F.when(F.col("ext") == "html", html_to_prose(F.col("content"))).otherwise(F.col("content")).alias("text"))
    return plain.unionByName(readable_text(files.where("ext = 'json'")))
