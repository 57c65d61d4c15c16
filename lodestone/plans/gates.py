"""Registered queries that run many rules in one pass, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import conditions as c
from ..operators import fused
from ..operators.fused import RowRule
from ..sources.kept import fresh_path
from ..sources.tables import table

_PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]


_STATUS, _PRICE, _DATE = "o_orderstatus", "o_totalprice", "o_orderdate"
#: (rule, gate, severity, field, what is bad, its SQL, the hit, its SQL) over orders with `customer`, their parent, `first`, the customer's first order, and `words`, those of the priority.
ORDER_RULES = [
    ("status-enum", "shape", "fail", _STATUS, lambda: c.not_among(_STATUS, ["F", "O"]), "o_orderstatus not in ('F', 'O')", None, None),
    ("status-constant", "shape", "flag", _STATUS, lambda: c.not_constant(_STATUS, "F") & (F.month(_DATE) == 2), "o_orderstatus is distinct from 'F' and month(o_orderdate) = 2", None, None),
    ("priority-format", "shape", "fail", "o_orderpriority", lambda: c.not_like("o_orderpriority", "^[1-5]-[A-Z]+$"), "not regexp_matches(o_orderpriority, '^[1-5]-[A-Z]+$')", None, None),
    ("priority-banned", "shape", "flag", "o_orderpriority", lambda: c.like("o_orderpriority", "URG"), "regexp_matches(o_orderpriority, 'URG')", lambda: F.regexp_extract("o_orderpriority", "U[A-Z]*", 0), "regexp_extract(o_orderpriority, 'U[A-Z]*', 0)"),
    ("priority-by-status", "shape", "fail", "o_orderpriority", lambda: c.other_prefix("o_orderpriority", _STATUS, {"F": "1", "O": "2"}) & (F.day(_DATE) == 1), "not starts_with(o_orderpriority, case o_orderstatus when 'F' then '1' when 'O' then '2' end) and day(o_orderdate) = 1", None, None),
    ("words-sorted", "shape", "fail", "words", lambda: c.unsorted("words"), "words <> list_sort(words)", lambda: F.array_join("words", ","), "array_to_string(words, ',')"),
    ("words-hold", "shape", "fail", _STATUS, lambda: c.not_within(_STATUS, "words") & (F.day(_DATE) == 2), "not list_contains(words, o_orderstatus) and day(o_orderdate) = 2", None, None),
    ("words-any", "shape", "fail", "words", lambda: c.empty("words"), "len(words) = 0", lambda: F.lit(None), "null"),
    ("priority-there", "shape", "fail", "o_orderpriority", lambda: c.missing("o_orderpriority"), "o_orderpriority is null or trim(o_orderpriority) = ''", lambda: F.lit(None), "null"),
    ("price-when-final", "values", "fail", _PRICE, lambda: c.broken(F.col(_STATUS) == "F", F.col(_PRICE) > 100_000), "o_orderstatus = 'F' and not coalesce(o_totalprice > 100000, false)", None, None),
    ("price-iff-open", "values", "fail", _PRICE, lambda: c.not_together(F.col(_STATUS) == "P", F.col(_PRICE) > 400_000), "(o_orderstatus = 'P') is distinct from (o_totalprice > 400000)", None, None),
    ("price-there-when-open", "values", "fail", _PRICE, lambda: c.missing_when(F.col(_STATUS) == "O", _PRICE), "o_orderstatus = 'O' and o_totalprice is null", None, None),
    ("customer-known", "parents", "fail", "o_custkey", lambda: F.col("customer").isNull(), "c_custkey is null", None, None),
    ("customer-in-debt", "parents", "flag", "o_custkey", lambda: F.coalesce(F.col("customer.c_acctbal") < 0, F.lit(False)), "coalesce(c_acctbal < 0, false)", None, None),
    ("customer-abroad", "parents", "flag", "o_custkey", lambda: F.coalesce(F.col("customer.c_nationkey") > 20, F.lit(False)), "coalesce(c_nationkey > 20, false)", lambda: F.col("customer.c_nationkey"), "c_nationkey"),
    ("customer-again", "parents", "flag", "o_custkey", lambda: F.col("o_orderkey") > F.col("first"), "o_orderkey > first", None, None),
    *[
        (f"quarantine-{p[0]}", "quarantine", "fail", "o_orderpriority", lambda p=p: c.elsewhere((F.col(_STATUS) == "P") & (F.month(_DATE) == int(p[0])), "o_orderpriority", p), f"o_orderstatus = 'P' and month(o_orderdate) = {p[0]} and o_orderpriority <> '{p}'", None, None)
        for p in _PRIORITIES
    ],
    *[
        (f"year-{y}", "dates", "flag", _DATE, lambda y=y: (F.year(_DATE) == y) & (F.dayofyear(_DATE) == 60), f"year(o_orderdate) = {y} and dayofyear(o_orderdate) = 60", lambda: F.date_format(_DATE, "yyyy-MM-dd"), "strftime(o_orderdate, '%Y-%m-%d')")
        for y in range(1992, 2001)
    ],
]


def _order_rules() -> list[RowRule]:
    return [RowRule(name, field, bad(), hit() if hit else None, severity, gate) for name, gate, severity, field, bad, _, hit, _ in ORDER_RULES]


GATES = ["shape", "values", "parents", "quarantine", "dates", "nothing"]
_ORDERS = """o as (select orders.*, first, c_custkey, c_acctbal, c_nationkey, string_split(o_orderpriority, ' ') as words from orders
left join (select o_custkey, min(o_orderkey) as first from orders group by o_custkey) f on f.o_custkey = orders.o_custkey left join (select * from customer where c_mktsegment <> 'BUILDING') c on c_custkey = orders.o_custkey)"""


def order_findings(spark, sf):
    """Thirty rules from one scan of the orders, with one join to their customers and one to the customers' first orders."""
    orders = table(spark, sf, "orders").withColumn("words", F.split("o_orderpriority", " "))
    customers = table(spark, sf, "customer").where("c_mktsegment <> 'BUILDING'")
    rows = fused.with_parent(orders, "o_custkey", customers, "c_custkey", "customer", "c_acctbal", "c_nationkey")
    rows = fused.with_first(rows, "o_custkey", "o_orderkey", "first")
    return fused.findings(rows, "o_orderkey", _order_rules())


_FOUND = f"with {_ORDERS}, f as (" + " union all ".join(
    f"select '{gate}' as gate, '{name}' as rule_id, '{severity}' as severity, o_orderkey::varchar as entity, '{field}' as field, ({sql_hit or field})::varchar as hit from o where coalesce({sql}, true)" for name, gate, severity, field, _, sql, _, sql_hit in ORDER_RULES
) + ")"


def dq_orders(spark, sf):
    """Findings with their hits; prices in whole numbers, as engines write doubles in their own ways."""
    return order_findings(spark, sf).withColumn("hit", F.when(F.col("field") == "o_totalprice", F.col("hit").cast("double").cast("long").cast("string")).otherwise(F.col("hit")))


def publish_gates(spark, sf):
    """(gate, failures, flags, exit_code), as observed while the findings were written."""
    totals = fused.written(order_findings(spark, sf), fresh_path(spark, "findings"), GATES)
    return spark.createDataFrame([(g, f, n, 1 if f else 0) for g, (f, n) in totals.items()], "gate string, failures long, flags long, exit_code int")


_SPACES, _SOURCES = {"click": True, "view": True, "error": False}, ["web", "app"]


def _observed(spark, sf):
    """Events as observations: clicks and views should carry one, errors none."""
    value = F.col("value")
    keys = F.when(F.col("user_id") % 4 == 0, F.split(F.col("event_type"), "i")).when(F.col("user_id") % 4 == 1, F.array("event_type"))
    struct = F.struct(
        F.when(value < 90, value >= 30).alias("present"),
        F.when(value % 2 < 1, F.when(F.col("user_id") % 9 == 0, "mail").when(F.col("user_id") % 2 == 0, "web").otherwise("app")).alias("source"),
        F.when(F.col("user_id") % 3 > 0, value > 50).alias("on"),
        F.when(F.col("event_id") % 7 > 0, F.date_format("ts", "yyyy-MM")).alias("at"),
        keys.alias("served_keys"),
    )
    rows = table(spark, sf, "events")
    return rows.withColumn("observed", F.when(F.col("event_id") % 5 > 0, struct))


_STAMP = "2024-01"


def dq_struct_by_namespace(spark, sf):
    """Observation structs that are required or forbidden by namespace, with all of their inner checks, a finding for each message."""
    rows = _observed(spark, sf)
    hits = c.observations("observed", "event_type", _SPACES, _SOURCES, F.lit(_STAMP))
    return fused.findings(rows, "event_id", [RowRule("V12", "observed", hits=hits)]).drop("gate")


_STRUCT_SQL = f"""with e as (select *, event_id % 5 > 0 as there, case when value < 90 then value >= 30 end as present, case when value % 2 < 1 then case when user_id % 9 = 0 then 'mail' when user_id % 2 = 0 then 'web' else 'app' end end as source,
case when user_id % 3 > 0 then value > 50 end as is_on, case when event_id % 7 > 0 then strftime(ts, '%Y-%m') end as stamped, case user_id % 4 when 0 then string_split(event_type, 'i') when 1 then [event_type] end as keys from events),
m as (select event_id, unnest([case when event_type not in ('click', 'view', 'error') then 'unknown namespace' end, case when event_type in ('click', 'view') and not there then 'observation required' end, case when event_type = 'error' and there then 'observation forbidden' end]) as hit from e
union all select event_id, unnest([case when present is null then 'present must be boolean' end, case when source not in ('web', 'app') then 'unknown source' end, case when not present and (source is not null or is_on is not null) then 'absent with source or on' end,
case when present and is_on is null then 'present without on' end, case when stamped is null then 'at missing' end, case when stamped <> '{_STAMP}' then 'at is not the stamp' end, case when keys is not null and not coalesce(present, false) then 'served keys of what is absent' end,
case when present and keys <> list_sort(keys) then 'served keys not sorted' end]) from e where there and event_type in ('click', 'view'))
select 'V12' as rule_id, 'fail' as severity, event_id::varchar as entity, 'observed' as field, hit from m where hit is not null"""


def dq_headers_equal(spark, sf):
    """Copies of a text must have the header (language and source) of its first document."""
    docs = table(spark, sf, "documents").select("doc_id", "lang", "source", F.md5("text").alias("digest"))
    first = docs.groupBy("digest").agg(F.min_by(F.struct("lang", "source"), "doc_id").alias("header"))
    rows = docs.join(first, "digest")
    rules = [RowRule("V17", f, F.col(f"header.{f}").isNotNull() & ~F.col(f).eqNullSafe(F.col(f"header.{f}"))) for f in ("lang", "source")]
    return fused.findings(rows, "doc_id", rules).drop("gate")


QUERIES = {
    "dq_orders": (dq_orders, f"{_FOUND} select gate, rule_id, severity, entity, field, case when field = 'o_totalprice' then trunc(hit::double)::bigint::varchar else hit end as hit from f"),
    "publish_gates": (
        publish_gates,
        f"""{_FOUND}, g as (select unnest({GATES}) as gate) select g.gate, count(*) filter (severity = 'fail') as failures, count(*) filter (severity = 'flag') as flags, (count(*) filter (severity = 'fail') > 0)::int as exit_code
from g left join f on f.gate = g.gate group by g.gate""",
    ),
    "dq_struct_by_namespace": (dq_struct_by_namespace, _STRUCT_SQL),
    "dq_headers_equal": (
        dq_headers_equal,
        """with d as (select *, md5(text) as digest from documents), h as (select digest, arg_min(lang, doc_id) as l, arg_min(source, doc_id) as s from d group by digest)
select 'V17' as rule_id, 'fail' as severity, doc_id::varchar as entity, 'lang' as field, lang as hit from d join h on d.digest = h.digest where l is not null and lang is distinct from l
union all select 'V17', 'fail', doc_id::varchar, 'source', source from d join h on d.digest = h.digest where s is not null and source is distinct from s""",
    ),
}
