"""Registered queries of the rule engine and the text scanner, each with its SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import disclosure, rules
from ..sources.json_walk import walk
from ..sources.tables import table


def _tables(spark, sf):
    names = ("orders", "lineitem", "customer", "supplier", "part", "nation", "documents", "labels", "events", "conversations", "pages")
    return {n: table(spark, sf, n) for n in names}


def _rule(rule_id, find, sql, severity="fail"):
    """A query of one rule: find(tables) gives findings, sql the (entity, field, hit) rows."""

    def run(spark, sf):
        return rules.run([rules.Rule(rule_id, find, severity)], _tables(spark, sf))

    return run, f"select '{rule_id}' as rule_id, '{severity}' as severity, entity, field, hit from ({sql})"


def _arrays(t):
    return t["conversations"].withColumn("words", T.tokens(F.col("text"), [])).withColumn("key", F.concat_ws("/", F.col("conv_id").cast("string"), F.col("turn").cast("string")))


_TOK = "list_filter(string_split(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g'), ' '), lambda w: length(w) > 1)"
_LINES = "l as (select source || '/' || doc_id as file, unnest(range(1, len(string_split(text, chr(10))) + 1)) as line_no, unnest(string_split(text, chr(10))) as line from documents)"


def _anchors(t):
    docs = t["documents"].select(F.concat_ws("/", "source", F.col("doc_id").cast("string")).alias("file"), F.col("text").alias("content"))
    sections = docs.select("file", F.lit(2).alias("start_line"))
    return rules.anchored_in(sections, "file", docs, "^[A-Z]")


def _kinds(t):
    rows = t["part"].select("p_partkey", "p_brand", F.when(F.col("p_size") > 25, "large").otherwise("small").alias("kind"))
    return rules.prefix_by_kind(rows, "p_partkey", "p_brand", "kind", {"large": "Brand#1", "small": "Brand#"})


def wording_positional(spark, sf):
    """Bare wording is a finding; the same words before a number are a comparison and pass."""
    pattern = "(?i)" + T.LEFT + "(of|by)" + T.RIGHT + "(?! [0-9])"
    found = rules.run([rules.Rule("V23", lambda t: rules.lacks(t["documents"], "doc_id", "text", pattern), needs=("documents",))], _tables(spark, sf))
    return found.select("rule_id", "severity", "entity", "field")


def wording_container(spark, sf):
    """Words that point at their container are a finding, unless what follows says which one is meant."""
    pattern = "(?i)" + T.LEFT + r"th(?:is|e)\s+(?:and|is)" + T.RIGHT + r"(?!\s+(?:for|of|a|by)" + T.RIGHT + ")"
    found = rules.run([rules.Rule("V24", lambda t: rules.lacks(t["documents"], "doc_id", "text", pattern), needs=("documents",))], _tables(spark, sf))
    return found.select("rule_id", "severity", "entity", "field")


_PROSE = "regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script[^>]*>.*?</script>', ' ', 'g'), '(?is)<style[^>]*>.*?</style>', ' ', 'g'), '(?s)<[^>]*>', ' ', 'g')"
# The same shapes for RE2, whose \b is the ASCII one.
_SHAPES = {
    "digit-run": (r"\b[0-9]{8,}\b", 0),
    "camel-case": (r"\b[a-z]+(?:[A-Z][a-z0-9]+){2,}\b", 12),
    "snake-case": (r"\b[a-z]+(?:_[a-z0-9]+){2,}\b", 0),
    "e-mail": (r"[A-Za-z0-9._+-]+@[A-Za-z0-9-]+(?:[.][A-Za-z0-9-]+)+", 0),
    "ipv4": (r"\b[0-9]{1,3}(?:[.][0-9]{1,3}){3}\b", 0),
    "hex-key": (r"\b[0-9a-f]{32,}\b", 0),
}


def _scan_sql(source):
    parts = [f"select id, '{n}' as rule, unnest(list_filter(regexp_extract_all(text, '{p}', 0), lambda h: length(h) >= {k} and h not in ('127.0.0.1', '0.0.0.0'))) as hit from x" for n, (p, k) in _SHAPES.items()]
    parts.append("select id, 'never' as rule, n as hit from x, (select unnest(['BEGIN PRIVATE KEY', 'password =']) as n) where contains(text, n)")
    return f"with x as ({source}) " + " union all ".join(parts)


def disclosure_documents(spark, sf):
    return disclosure.scan(table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text"))


def disclosure_pages(spark, sf):
    files = table(spark, sf, "pages").select(F.col("page_id").alias("id"), F.lit("html").alias("ext"), F.col("html").alias("content"))
    return disclosure.scan(disclosure.scope(files))


def quote_budget(spark, sf):
    return disclosure.quotes(table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text"))


def html_prose(spark, sf):
    return table(spark, sf, "pages").select("page_id", F.md5(T.html_to_prose(F.col("html"))).alias("prose"))


def json_strings(spark, sf):
    rows = table(spark, sf, "events").select("event_id", F.to_json(F.struct("event_type", F.struct(F.array("event_type", F.lit("x")).alias("list")).alias("deep"))).alias("j"))
    return walk(rows, "event_id", "j")


def prose_unpivot(spark, sf):
    return rules.prose(table(spark, sf, "part").withColumn("words", F.split("p_name", " ")), "p_partkey", ["p_name", "p_type"], ["words"])


def finding_summary(spark, sf):
    t = _tables(spark, sf)
    rows = reduce(DataFrame.unionByName, [rules.run([rules.Rule(i, f, s)], t) for i, f, s in _SUMMED])
    return rows.groupBy("rule_id", "severity").agg(F.count("*").alias("n"))


def _enum(t):
    return rules.enum(t["orders"], "o_orderkey", "o_orderstatus", ["F", "O"])


def _required(t):
    return rules.required(t["orders"].withColumn("note", F.when(F.col("o_orderpriority") == "5-LOW", "").otherwise("x")), "o_orderkey", ["o_orderpriority", "note"])


_NUMBER = "[0-9][0-9.]*[0-9]"
_TYPE_SQL = f"select 'V3' as rule_id, 'fail' as severity, doc_id::varchar as entity, 'numbers' as field, v as hit from (select doc_id, unnest(regexp_extract_all(text, '{_NUMBER}', 0)) as v from documents) where contains(v, '.')"


def dq_type(spark, sf):
    """Every number-like word of every text that is no whole number."""
    numbers = table(spark, sf, "documents").select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(_NUMBER), F.lit(0))).alias("numbers"))
    return rules.run([rules.Rule("V3", lambda t: rules.finding(numbers, ~T.whole(F.col("numbers")), "doc_id", "numbers"))], {})


_SUMMED = [("V4", _enum, "fail"), ("V2", _required, "flag")]

QUERIES = {
    "dq_constant": _rule("V1", lambda t: rules.constant(t["lineitem"], "l_orderkey", "l_linenumber", 7), "select l_orderkey::varchar as entity, 'l_linenumber' as field, l_linenumber::varchar as hit from lineitem where l_linenumber is distinct from 7"),
    "dq_required": _rule("V2", _required, "select o_orderkey::varchar as entity, 'note' as field, null::varchar as hit from orders where o_orderpriority = '5-LOW'"),
    "dq_type": (dq_type, _TYPE_SQL),
    "dq_enum": _rule("V4", _enum, "select o_orderkey::varchar as entity, 'o_orderstatus' as field, o_orderstatus as hit from orders where o_orderstatus is null or o_orderstatus not in ('F', 'O')"),
    "dq_prefix_by_kind": _rule("V5", _kinds, "select p_partkey::varchar as entity, 'p_brand' as field, p_brand as hit from part where not starts_with(p_brand, case when p_size > 25 then 'Brand#1' else 'Brand#' end)"),
    "dq_conditional": _rule("V6", lambda t: rules.conditional(t["orders"].withColumn("closed", F.when(F.col("o_totalprice") > 100000, "y")), "o_orderkey", F.col("o_orderstatus") == "F", "closed"), "select o_orderkey::varchar as entity, 'closed' as field, null::varchar as hit from orders where o_orderstatus = 'F' and not coalesce(o_totalprice > 100000, false)"),
    "dq_unique": _rule("V7", lambda t: rules.unique(t["documents"].select("doc_id", F.md5("text").alias("digest")), "doc_id", "digest", "doc_id"), "select doc_id::varchar as entity, 'digest' as field, d as hit from (select doc_id, md5(text) as d, row_number() over (partition by md5(text) order by doc_id) as n from documents) where n > 1"),
    "dq_foreign_key": _rule("V8", lambda t: rules.foreign_key(t["orders"], "o_orderkey", "o_custkey", t["customer"].where("c_mktsegment <> 'BUILDING'"), "c_custkey"), "select o_orderkey::varchar as entity, 'o_custkey' as field, o_custkey::varchar as hit from orders where o_custkey not in (select c_custkey from customer where c_mktsegment <> 'BUILDING')"),
    "dq_nonempty": _rule("V9", lambda t: rules.nonempty(t["documents"].withColumn("numbers", F.regexp_extract_all("text", F.lit("[0-9]{6,}"), F.lit(0))), "doc_id", "numbers"), "select doc_id::varchar as entity, 'numbers' as field, null::varchar as hit from documents where not regexp_matches(text, '[0-9]{6,}')"),
    "dq_format": _rule("V10", lambda t: rules.matches(t["part"], "p_partkey", "p_brand", "^Brand#[0-9]$"), "select p_partkey::varchar as entity, 'p_brand' as field, p_brand as hit from part where not regexp_matches(p_brand, '^Brand#[0-9]$')"),
    "dq_shape_iff_namespace": _rule("V11", lambda t: rules.iff(t["events"], "event_id", "event_type", F.col("event_type") == "error", F.col("value") < 50), "select event_id::varchar as entity, 'event_type' as field, event_type as hit from events where (event_type = 'error') is distinct from (value < 50)"),
    "dq_consistent": _rule("V13", lambda t: rules.consistent(t["lineitem"], "l_orderkey", "l_returnflag", F.col("l_linestatus") == "O", F.col("l_returnflag") == "N"), "select l_orderkey::varchar as entity, 'l_returnflag' as field, l_returnflag as hit from lineitem where l_linestatus = 'O' and not coalesce(l_returnflag = 'N', false)"),
    "dq_snapshot_identity": _rule("V14", lambda t: rules.same_as_header(t["orders"].withColumn("as_of", F.date_format("o_orderdate", "yyyy")), "o_orderkey", "as_of", t["orders"].agg(F.date_format(F.max("o_orderdate"), "yyyy").alias("stamp")), "stamp"), "select o_orderkey::varchar as entity, 'as_of' as field, strftime(o_orderdate, '%Y') as hit from orders where strftime(o_orderdate, '%Y') is distinct from (select strftime(max(o_orderdate), '%Y') from orders)"),
    "dq_sorted_array": _rule("V15", lambda t: rules.sorted_array(_arrays(t), "key", "words"), f"select conv_id || '/' || turn as entity, 'words' as field, array_to_string(w, ',') as hit from (select conv_id, turn, {_TOK} as w from conversations) where w <> list_sort(w)"),
    "dq_contained": _rule("V16", lambda t: rules.contained(_arrays(t).withColumn("newest", F.lit("the")), "key", "newest", "words"), f"select conv_id || '/' || turn as entity, 'newest' as field, 'the' as hit from (select conv_id, turn, {_TOK} as w from conversations) where not list_contains(w, 'the')"),
    "dq_line_anchor": _rule("V18", _anchors, f"select file as entity, 'start_line' as field, line as hit from (select * from ({'with ' + _LINES + ' select * from l'})) where line_no = 2 and not regexp_matches(line, '^[A-Z]')"),
    "dq_quarantine": _rule("V19", lambda t: rules.only_on(t["orders"], "o_orderkey", F.col("o_orderstatus") == "P", "o_orderpriority", "5-LOW"), "select o_orderkey::varchar as entity, 'o_orderpriority' as field, o_orderpriority as hit from orders where o_orderstatus = 'P' and o_orderpriority is distinct from '5-LOW'"),
    "dq_derived_rows": _rule("V20", lambda t: rules.finding(t["lineitem"].join(t["orders"].select(F.col("o_orderkey").alias("l_orderkey"), F.to_date("o_orderdate").alias("ordered")), "l_orderkey"), ~(F.to_date("l_shipdate") >= F.col("ordered")), "l_orderkey", "l_shipdate", F.date_format("l_shipdate", "yyyy-MM-dd")), "select l_orderkey::varchar as entity, 'l_shipdate' as field, strftime(l_shipdate, '%Y-%m-%d') as hit from lineitem join orders on l_orderkey = o_orderkey where l_shipdate::date < o_orderdate::date"),
    "dq_coverage": _rule("V21", lambda t: rules.coverage(t["events"].select(F.col("event_type").alias("field")), ["click", "view"]), "select distinct event_type as entity, 'field' as field, event_type as hit from events where event_type not in ('click', 'view')"),
    "dq_childless": _rule("V22", lambda t: rules.childless(t["customer"], "c_custkey", t["orders"].where("o_orderstatus = 'P'"), "o_custkey", [0]), "select c_custkey::varchar as entity, 'c_custkey' as field, c_custkey::varchar as hit from customer where c_custkey <> 0 and c_custkey not in (select o_custkey from orders where o_orderstatus = 'P')"),
    "dq_wording_positional": (
        wording_positional,  # no lookahead in RE2: all hits, less those that a number follows
        r"select 'V23' as rule_id, 'fail' as severity, doc_id::varchar as entity, 'text' as field from documents where len(regexp_extract_all(text, '(?i)\b(?:of|by)\b', 0)) > len(regexp_extract_all(text, '(?i)\b(?:of|by) [0-9]', 0))",
    ),
    "dq_wording_container": (
        wording_container,  # no lookahead in RE2: all hits, less those that an exempt word follows; none of those begins a hit
        r"select 'V24' as rule_id, 'fail' as severity, doc_id::varchar as entity, 'text' as field from documents where len(regexp_extract_all(text, '(?i)\bth(?:is|e)\s+(?:and|is)\b', 0)) > len(regexp_extract_all(text, '(?i)\bth(?:is|e)\s+(?:and|is)\s+(?:for|of|a|by)\b', 0))",
    ),
    "dq_banned_phrase": _rule("V26", lambda t: rules.lacks(t["conversations"].withColumn("key", F.concat_ws("/", F.col("conv_id").cast("string"), F.col("turn").cast("string"))), "key", "text", "(?i)(?:thing|inha) *of"), "select conv_id || '/' || turn as entity, 'text' as field, regexp_extract(text, '(?i)(?:thing|inha) *of', 0) as hit from conversations where regexp_matches(text, '(?i)(?:thing|inha) *of')", "flag"),
    "dq_trimmed": _rule("V29", lambda t: rules.required(t["events"].withColumn("note", F.when(F.col("value") > 90, "  ").otherwise("x")), "event_id", ["note"]), "select event_id::varchar as entity, 'note' as field, null::varchar as hit from events where value > 90"),
    "dq_write_paths": _rule("C14", lambda t: rules.lacks(t["pages"], "page_id", "url", "[.](?:html|htm)(?:[?#]|$)"), "select page_id::varchar as entity, 'url' as field, regexp_extract(url, '[.](?:html|htm)(?:[?#]|$)', 0) as hit from pages where regexp_matches(url, '[.](?:html|htm)(?:[?#]|$)')", "flag"),
    "dq_wording_retraction": _rule("V25", lambda t: rules.lacks(t["documents"], "doc_id", "text", "(?:Released under|licensed under|Licensed under) [A-Za-z]+"), "select doc_id::varchar as entity, 'text' as field, regexp_extract(text, '(?:Released under|licensed under|Licensed under) [A-Za-z]+', 0) as hit from documents where regexp_matches(text, '(?:Released under|licensed under|Licensed under) [A-Za-z]+')", "flag"),
    "dq_name_is_stem": _rule("V27", lambda t: rules.finding(t["nation"].withColumn("file", F.concat(F.col("n_name"), F.when(F.col("n_nationkey") % 5 == 0, "-old.md").otherwise(".md"))), F.col("n_name") != F.regexp_replace("file", r"\.md$", ""), "n_nationkey", "file"), "select n_nationkey::varchar as entity, 'file' as field, n_name || '-old.md' as hit from nation where n_nationkey % 5 = 0"),
    "dq_sentences": _rule("V31", lambda t: rules.sentences(t["documents"].withColumn("summary", F.element_at(F.split("text", "\n"), 1)), "doc_id", "summary", 2), "select doc_id::varchar as entity, 'summary' as field, n::varchar as hit from (select doc_id, len(list_filter(regexp_split_to_array(regexp_replace(string_split(text, chr(10))[1], '[.][ \\t\\r\\f]', '.' || chr(10), 'g'), '\\n'), lambda x: x <> '')) as n from documents) where n < 2"),
    "dq_disjoint": _rule("V32", lambda t: rules.disjoint(t["nation"], "n_regionkey", t["nation"].where("n_nationkey < 3"), "n_nationkey"), "select distinct n_regionkey::varchar as entity, 'n_regionkey' as field, n_regionkey::varchar as hit from nation where n_regionkey in (select n_nationkey from nation where n_nationkey < 3)"),
    "dq_summary": (finding_summary, "select 'V4' as rule_id, 'fail' as severity, count(*) as n from orders where o_orderstatus is null or o_orderstatus not in ('F', 'O') union all select 'V2', 'flag', count(*) from orders where o_orderpriority = '5-LOW'"),
    "prose_unpivot": (prose_unpivot, "select p_partkey || '.p_name' as label, p_name as text from part union all select p_partkey || '.p_type', p_type from part union all select p_partkey || '.words[' || (i - 1) || ']', string_split(p_name, ' ')[i] from (select p_partkey, p_name, unnest(range(1, len(string_split(p_name, ' ')) + 1)) as i from part)"),
    "disclosure_documents": (disclosure_documents, _scan_sql("select doc_id as id, text from documents")),
    "disclosure_pages": (disclosure_pages, _scan_sql(f"select page_id as id, {_PROSE} as text from pages")),
    "quote_budget": (
        quote_budget,
        f"with s as (select doc_id as id, regexp_extract_all(text, '{disclosure.QUOTE}', 1) as spans from documents), w as (select id, len(spans) as spans, list_transform(spans, lambda x: len(regexp_split_to_array(trim(x), '\\s+'))) as words from s) select id, spans, coalesce(list_sum(words), 0)::bigint as words, len(list_filter(words, lambda n: n > 15)) as long_spans, coalesce(list_sum(words), 0) > 40 as over_budget from w",
    ),
    "html_prose": (html_prose, f"select page_id, md5({_PROSE}) as prose from pages"),
    "json_strings": (json_strings, "select event_id, '$.event_type' as path, event_type as value from events union all select event_id, '$.deep.list[0]', event_type from events union all select event_id, '$.deep.list[1]', 'x' from events"),
}
