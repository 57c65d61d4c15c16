"""Many rules in one pass: all row-level rules of a table are one array of findings that is exploded once, the parents that several rules ask for are joined once, and totals are observed while the findings are written.

A gate is a name that rules share. Observed counts may count a lost task's rows again, so they can be too high where executors are lost, but never turn none into some or some into none, which is what a gate asks; the findings
themselves are written once."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

FINDING = "struct<gate: string, rule_id: string, severity: string, entity: string, field: string, hit: string>"


@dataclass(frozen=True, eq=False)
class RowRule:
    """A check of one row. Rows for which `bad` is true or null are findings; hit is the field's value unless a column says otherwise; hits, an array, makes a finding of each of its entries."""

    rule_id: str
    field: str
    bad: Column | None = None
    hit: Column | None = None
    severity: str = "fail"
    gate: str = ""
    hits: Column | None = None


class GateFailed(Exception):
    """A publish was stopped: exit_code is 1 where findings failed a gate, 2 where the gates could not be run."""

    def __init__(self, message: str, exit_code: int):
        super().__init__(message)
        self.exit_code = exit_code


def findings(rows: DataFrame, entity: str | Column, rules: list[RowRule]) -> DataFrame:
    """(gate, rule_id, severity, entity, field, hit) of all rules, from one pass over the rows."""
    name = (F.col(entity) if isinstance(entity, str) else entity).cast("string")

    def one(rule: RowRule, hit: Column) -> Column:
        parts = (("gate", F.lit(rule.gate)), ("rule_id", F.lit(rule.rule_id)), ("severity", F.lit(rule.severity)), ("entity", name), ("field", F.lit(rule.field)), ("hit", hit.cast("string")))
        return F.struct(*[c.alias(n) for n, c in parts]).cast(FINDING)

    single = [F.when(F.coalesce(r.bad, F.lit(True)), one(r, F.col(r.field) if r.hit is None else r.hit)) for r in rules if r.hits is None]
    each = lambda r: F.transform(r.hits, lambda h: one(r, h))
    many = [each(r) for r in rules if r.hits is not None]
    every = F.concat(F.array_compact(F.array(*single)) if single else F.array().cast(f"array<{FINDING}>"), *[F.coalesce(m, F.array().cast(f"array<{FINDING}>")) for m in many])
    return rows.select(F.explode(every).alias("f")).select("f.*")


def with_parent(rows: DataFrame, field: str, parents: DataFrame, key: str, name: str, *columns: str) -> DataFrame:
    """rows with `name`, the columns of the parent that the field names, or null where there is none: one join for all rules that ask. Parents of one key are one parent."""
    known = parents.groupBy(F.col(key).alias(field)).agg(*[F.min(c).alias(c) for c in columns], F.lit(True).alias("known"))
    return rows.join(known.select(field, F.struct("known", *columns).alias(name)), field, "left")


def with_first(rows: DataFrame, field: str, order: str, name: str) -> DataFrame:
    """rows with `name`, the least order of the rows that have the field's value; the order tells rows apart, so a row of a greater one is a repetition. No task needs all rows of a value."""
    least = rows.where(F.col(field).isNotNull()).groupBy(field).agg(F.min(order).alias(name))
    return rows.join(least, field, "left")


def written(rows: DataFrame, path: str, gates: list[str]) -> dict[str, tuple[int, int]]:
    """Writes the findings under path and returns (failures, flags) of each gate, counted on the way."""
    observed = Observation()
    each = [(g, s) for g in gates for s in ("fail", "flag")]
    counts = [F.count_if((F.col("gate") == g) & ((F.col("severity") == "fail") if s == "fail" else (F.col("severity") != "fail"))).alias(f"{i}") for i, (g, s) in enumerate(each)]
    rows.observe(observed, *counts).write.mode("overwrite").parquet(path)
    found = observed.get
    return {g: (int(found[str(2 * i)]), int(found[str(2 * i + 1)])) for i, g in enumerate(gates)}


def passed(totals: dict[str, tuple[int, int]]) -> None:
    """Raises GateFailed with exit code 1 if a gate has failures; flags pass."""
    failed = {g: n for g, (n, _) in totals.items() if n}
    if failed:
        raise GateFailed(", ".join(f"{g}: {n} failures" for g, n in sorted(failed.items())), 1)


def published(publish, make_findings, path: str, gates: list[str]) -> int:
    """Runs the gates, then publish(): 0 when both are done, the gates' exit code when they stop it. Nothing is published over a failed gate, and the finding table stays to be read."""
    try:
        rows = make_findings()
    except Exception as cause:
        raise GateFailed(f"the gates could not be run: {cause}", 2) from cause
    passed(written(rows, path, gates))
    publish()
    return 0
