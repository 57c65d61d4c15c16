"""A declarative data-quality engine: each rule turns rows into findings, and all findings come from one union.

A finding is (rule_id, severity, entity, field, hit). Null-safe throughout: a missing value never slips through a comparison."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import conditions

COLUMNS = ["rule_id", "severity", "entity", "field", "hit"]


@dataclass(frozen=True)
class Rule:
    """A named check; find(tables) gives (entity, field, hit) rows."""

    rule_id: str
    find: Callable[[dict[str, DataFrame]], DataFrame]
    severity: str = "fail"
    needs: tuple[str, ...] = ()


def run(rules: list[Rule], tables: dict[str, DataFrame]) -> DataFrame:
    """All findings. Rules whose tables are absent are left out, so optional inputs may be missing."""
    parts = [r.find(tables).select(F.lit(r.rule_id).alias("rule_id"), F.lit(r.severity).alias("severity"), "entity", "field", "hit") for r in rules if all(t in tables for t in r.needs)]
    if not parts:
        raise ValueError("no rule has its tables")
    return reduce(DataFrame.unionByName, parts)


def gate(findings: DataFrame) -> tuple[int, int]:
    """(failures, flags), counted in one pass."""
    row = findings.agg(F.count_if(F.col("severity") == "fail"), F.count_if(F.col("severity") != "fail")).first()
    return int(row[0]), int(row[1])


def finding(rows: DataFrame, bad: Column, entity: str, field: str, hit: Column | None = None) -> DataFrame:
    value = F.col(field) if hit is None else hit
    return rows.where(F.coalesce(bad, F.lit(True))).select(F.col(entity).cast("string").alias("entity"), F.lit(field).alias("field"), value.cast("string").alias("hit"))


def required(rows: DataFrame, entity: str, fields: list[str], trimmed: bool = True) -> DataFrame:
    """Fields that are null or empty: one row each, from one pass over the rows."""
    pairs = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("value")) for f in fields])
    value = F.trim("p.value") if trimmed else F.col("p.value")
    return rows.select(F.col(entity).cast("string").alias("entity"), F.explode(pairs).alias("p")).where(F.col("p.value").isNull() | (value == "")).select("entity", "p.field", F.lit(None).cast("string").alias("hit"))


def constant(rows: DataFrame, entity: str, field: str, value) -> DataFrame:
    return finding(rows, conditions.not_constant(field, value), entity, field)


def enum(rows: DataFrame, entity: str, field: str, allowed: list) -> DataFrame:
    return finding(rows, conditions.not_among(field, allowed), entity, field)


def prefix_by_kind(rows: DataFrame, entity: str, field: str, kind: str, prefixes: dict[str, str]) -> DataFrame:
    return finding(rows, conditions.other_prefix(field, kind, prefixes), entity, field)


def conditional(rows: DataFrame, entity: str, when: Column, field: str) -> DataFrame:
    return finding(rows, conditions.missing_when(when, field), entity, field)


def unique(rows: DataFrame, entity: str, field: str, order: str) -> DataFrame:
    """The second and later rows of a value, in load order."""
    later = rows.withColumn("_n", F.row_number().over(Window.partitionBy(field).orderBy(order)))
    return finding(later, F.col("_n") > 1, entity, field)


def foreign_key(rows: DataFrame, entity: str, field: str, parents: DataFrame, key: str) -> DataFrame:
    known = parents.select(F.col(key).alias(field)).distinct()
    return finding(rows.where(F.col(field).isNotNull()).join(known, field, "left_anti"), F.lit(True), entity, field)


def childless(parents: DataFrame, key: str, children: DataFrame, field: str, exempt: list | None = None) -> DataFrame:
    left = parents.where(~F.col(key).isin(exempt)) if exempt else parents
    return finding(left.join(children.select(F.col(field).alias(key)).distinct(), key, "left_anti"), F.lit(True), key, key)


def nonempty(rows: DataFrame, entity: str, field: str) -> DataFrame:
    return finding(rows, conditions.empty(field), entity, field, F.lit(None))


def matches(rows: DataFrame, entity: str, field: str, pattern: str) -> DataFrame:
    return finding(rows, conditions.not_like(field, pattern), entity, field)


def lacks(rows: DataFrame, entity: str, field: str, pattern: str, group: int = 0) -> DataFrame:
    """Banned wording: rows whose text matches, with the first match."""
    return finding(rows, conditions.like(field, pattern), entity, field, F.regexp_extract(field, pattern, group))


def iff(rows: DataFrame, entity: str, field: str, one: Column, two: Column) -> DataFrame:
    """Two predicates that must hold together or not at all."""
    return finding(rows, conditions.not_together(one, two), entity, field)


def consistent(rows: DataFrame, entity: str, field: str, when: Column, then: Column) -> DataFrame:
    return finding(rows, conditions.broken(when, then), entity, field)


def same_as_header(rows: DataFrame, entity: str, field: str, header: DataFrame, other: str) -> DataFrame:
    """Rows whose value is not the one of a header row."""
    return finding(rows.crossJoin(F.broadcast(header.select(other).limit(1))), ~F.col(field).eqNullSafe(F.col(other)), entity, field)


def headers_equal(one: DataFrame, two: DataFrame, fields: list[str], skip_missing: bool = True) -> DataFrame:
    """Two header rows must agree on fields; a missing expected value is skipped unless told otherwise."""
    pairs = lambda df, name: df.select(F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias(name)) for f in fields])).alias("p")).select("p.*")
    both = pairs(one, "expected").join(pairs(two, "found"), "field")
    if skip_missing:
        both = both.where("expected is not null")
    return both.where(~F.col("expected").eqNullSafe(F.col("found"))).select(F.lit("header").alias("entity"), "field", F.col("found").alias("hit"))


def sorted_array(rows: DataFrame, entity: str, field: str) -> DataFrame:
    return finding(rows, conditions.unsorted(field), entity, field, F.array_join(F.col(field).cast("array<string>"), ","))


def contained(rows: DataFrame, entity: str, field: str, array: str) -> DataFrame:
    return finding(rows, conditions.not_within(field, array), entity, field)


def anchored(rows: DataFrame, entity: str, lines: DataFrame, pattern: str) -> DataFrame:
    """The line at (file, start_line) must match; files that are not there are skipped."""
    at = rows.join(lines.select("file", F.col("line_no").alias("start_line"), F.col("text").alias("_line")), ["file", "start_line"])
    return finding(at, ~F.col("_line").rlike(pattern), entity, "start_line", F.col("_line"))


def anchored_in(rows: DataFrame, entity: str, files: DataFrame, pattern: str) -> DataFrame:
    """anchored() over files(file, content): the line is cut out of its file, so no file is taken apart into all of its lines."""
    at = rows.join(files.select("file", "content"), "file").where(F.col("start_line").between(1, F.length("content") - F.length(F.replace("content", F.lit("\n"))) + 1))
    line = F.substring_index(F.expr("substring_index(content, '\n', start_line)"), "\n", -1)
    return finding(at.withColumn("_line", line), ~F.col("_line").rlike(pattern), entity, "start_line", F.col("_line"))


def only_on(rows: DataFrame, entity: str, when: Column, field: str, place) -> DataFrame:
    return finding(rows, conditions.elsewhere(when, field, place), entity, field)


def coverage(used: DataFrame, declared: list[str], field: str = "field") -> DataFrame:
    """Columns in use that no group declares."""
    return used.select(field).distinct().where(~F.col(field).isin(declared)).select(F.col(field).alias("entity"), F.lit(field).alias("field"), F.col(field).alias("hit"))


def sentences(rows: DataFrame, entity: str, field: str, least: int) -> DataFrame:
    count = conditions.sentence_count(field)
    return finding(rows, count < least, entity, field, count)


def disjoint(one: DataFrame, a: str, two: DataFrame, b: str) -> DataFrame:
    common = one.select(F.col(a).alias("v")).distinct().join(two.select(F.col(b).alias("v")).distinct(), "v", "left_semi")
    return common.select(F.col("v").cast("string").alias("entity"), F.lit(a).alias("field"), F.col("v").cast("string").alias("hit"))


def prose(rows: DataFrame, entity: str, fields: list[str], arrays: list[str] | None = None) -> DataFrame:
    """(label, text): every string that a reader sees, with its place."""
    plain = [F.struct(F.concat_ws(".", F.col(entity).cast("string"), F.lit(f)).alias("label"), F.col(f).alias("text")) for f in fields]
    def listed(f: str):
        label = lambda i: F.concat(F.col(entity).cast("string"), F.lit(f".{f}["), i.cast("string"), F.lit("]"))
        return F.transform(F.coalesce(F.col(f), F.array().cast("array<string>")), lambda x, i: F.struct(label(i).alias("label"), x.alias("text")))

    parts = [F.array(*plain), *[listed(f) for f in arrays or []]]
    return rows.select(F.explode(F.concat(*parts)).alias("p")).select("p.label", "p.text").where("text is not null")


def typed(rows: DataFrame, entity: str, field: str, kind: str) -> DataFrame:
    """JSON values of a field that are not of that kind: string, number, boolean, array or object. What cannot be read, null included, is of none."""
    return finding(rows, conditions.other_kind(field, kind), entity, field)


def derived(rows: DataFrame, entity: str, key: str, page: str, facts: DataFrame) -> DataFrame:
    """Derived rows whose fact is missing, lies on another page, or is not durable; facts(fact_id, page, durability)."""
    known = facts.select(F.col("fact_id").alias(key), F.col("page").alias("_page"), "durability")
    both = rows.join(known, key, "left")
    why = F.when(F.col("durability").isNull(), "no fact").when(~F.col(page).eqNullSafe(F.col("_page")), "other page").when(F.col("durability") != "durable", "not durable")
    return both.withColumn("_why", why).where("_why is not null").select(F.col(entity).cast("string").alias("entity"), F.lit(key).alias("field"), F.col("_why").alias("hit"))


def gates(named: list[tuple[str, DataFrame]]) -> DataFrame:
    """(gate, failures, flags, exit_code) of findings by gate: 0 where nothing failed, else 1."""
    rows = reduce(DataFrame.unionByName, [f.select("severity").withColumn("gate", F.lit(n)) for n, f in named])
    counts = rows.groupBy("gate").agg(F.count_if(F.col("severity") == "fail").alias("failures"), F.count_if(F.col("severity") != "fail").alias("flags"))
    every = rows.sparkSession.createDataFrame([(n,) for n, _ in named], "gate string").join(counts, "gate", "left").na.fill(0)
    return every.withColumn("exit_code", F.when(F.col("failures") > 0, 1).otherwise(0))


def messages(findings: DataFrame, most: int = 25) -> DataFrame:
    """The first messages that a person is shown, in order; the findings themselves stay whole."""
    text = F.concat_ws(" ", "rule_id", F.concat("entity", F.lit(":")), "field", F.coalesce("hit", F.lit("(missing)")))
    return findings.select(text.alias("message")).orderBy("message").limit(most)
