"""Registered queries of publishing: projections, views, navigation, facets, links and rendered artefacts, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import publish
from ..sources.tables import facts, site, table

_FACTS = "f as (select o_orderkey as fact_id, o_custkey as page, 'order ' || o_orderkey as rule, case when o_orderstatus = 'P' then 'volatile' else 'durable' end as durability, o_orderpriority as tier, o_totalprice as total, o_orderdate::date as day from orders)"
_PATH = "regexp_replace(regexp_replace(url, '^[a-z]+://[^/]*/?', ''), '[?#].*$', '')"
_SITE = f"p as (select page_id, {_PATH} as path, regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) as host, url, html from pages), q as (select *, case when path = '' or path like '%/' then path || 'index.html' when not contains(string_split(path, '/')[-1], '.') then path || '/index.html' else path end as page from p)"
_ESC = "replace(replace(replace(replace({0}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;')"
SELECTED = {"durability": ["durable"], "tier": ["1-URGENT", "2-HIGH"], "page": []}


def published_projection(spark, sf):
    return publish.published(facts(spark, sf), ["total", "durability"])


def contract_view(spark, sf):
    item = F.concat(F.lit("- "), F.col("rule"), F.lit(" ("), F.col("tier"), F.lit(")"))
    return publish.by_group(publish.durable(facts(spark, sf)), "page", "fact_id", item).withColumn("body", F.md5("body"))


def current_state_view(spark, sf):
    """Header keys and values, then the volatile rows."""
    rows = facts(spark, sf)
    header = rows.agg(F.count("*").cast("string").alias("facts"), F.date_format(F.max("day"), "yyyy-MM-dd").alias("as_of"))
    pairs = header.select(F.explode(F.array(F.struct(F.lit("facts").alias("key"), F.col("facts").alias("value")), F.struct(F.lit("as_of").alias("key"), F.col("as_of").alias("value")))).alias("p")).select("p.*")
    return pairs.unionByName(rows.where("durability = 'volatile'").select(F.col("rule").alias("key"), F.col("tier").alias("value")))


def page_rows(spark, sf):
    row = F.concat(F.lit("| "), F.col("rule"), F.lit(" | "), F.col("tier"), F.lit(" |"))
    return facts(spark, sf).select("fact_id", row.alias("md"), F.concat(F.lit('<li id="'), T.slug(F.col("rule")), F.lit('">'), T.html_escape(F.col("tier")), F.lit("</li>")).alias("html"))


def topic_counts(spark, sf):
    return publish.durable(facts(spark, sf)).groupBy("page").agg(F.count("*").alias("n"), F.min("day").alias("earliest"))


def nav_groups(spark, sf):
    return publish.navigation(site(spark, sf).withColumn("ord", F.col("page_id")), "host")


def facet_rows(spark, sf):
    rows = facts(spark, sf)
    return rows.where(publish.facet(rows, SELECTED)).select("fact_id", "tier")


def facet_counts(spark, sf):
    return publish.facet_counts(facts(spark, sf), SELECTED)


def link_integrity(spark, sf):
    """Links of the pages, with two more for each that climb: to the page's own folder by the one above it, and to a page above that is not there."""
    own = F.regexp_extract("page", "([^/]*)/[^/]*$", 1)
    climbing = F.concat("html", F.lit('<a href="../'), own, F.lit('/">x</a><a href="./../../none.html">y</a>'))
    return publish.broken_links(site(spark, sf).select("host", "page", climbing.alias("html"))).distinct()


def link_fragments(spark, sf):
    """Pages whose own fragments are looked for in themselves; the tables' pages have no ids, so each such link is a finding."""
    pages = site(spark, sf).select("host", "page", F.concat("html", F.lit('<a href="#top">x</a><a href="#end">y</a><i id="end"></i>')).alias("html"))
    return publish.broken_links(pages).where("problem = 'no fragment'").distinct()


def sitemap(spark, sf):
    return site(spark, sf).select("page_id", publish.sitemap_entry(F.col("url"), F.lit("2024-05-01").cast("date")).alias("entry"))


def sitemap_difference(spark, sf):
    """Entries against pages, in both directions: a page without content has no entry here."""
    rows = site(spark, sf)
    return publish.symmetric_difference(rows.select("url"), rows.where("page_id % 10 <> 0").select("url"))


def text_index(spark, sf):
    title = F.regexp_extract("html", "<title>([^<]*)</title>", 1)
    return site(spark, sf).select("page_id", F.concat_ws("\t", "page", title).alias("line"))


def structured_data(spark, sf):
    title = F.regexp_extract("html", "<title>([^<]*)</title>", 1)
    return site(spark, sf).select("page_id", F.md5(publish.structured_header(title, F.col("url"), F.lit("2024-05-01").cast("date"))).alias("json"))


def cross_format_parity(spark, sf):
    items = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(F.count("*").alias("n"))
    numbers = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(F.max("l_linenumber").cast("long").alias("n"))
    return publish.parity(items, numbers, "k", "n")


def facet_labels(spark, sf):
    """Rendered rows that lost their fact's tier."""
    rows = facts(spark, sf)
    shown = rows.select("fact_id", F.when(F.col("tier") == "4-NOT SPECIFIED", None).otherwise(F.col("tier")).alias("tier"))
    return publish.parity(rows, shown, "fact_id", "tier").withColumnsRenamed({"one": "expected", "two": "found"})


def first_sentences(spark, sf):
    return table(spark, sf, "documents").select("doc_id", T.first_sentence(F.col("text")).alias("sentence"), T.shortened(F.col("text"), 20).alias("short"))


def hit_windows(spark, sf):
    docs = table(spark, sf, "documents").where(F.contains("text", F.lit("License")))
    return docs.select("doc_id", T.around(F.col("text"), F.lit("License")).alias("window"))


def markdown_tables(spark, sf):
    md = F.concat(F.lit("| name | type |\n|---|---|\n| "), F.col("p_name"), F.lit(" | "), F.col("p_type"), F.lit(" |"))
    cells = table(spark, sf, "part").select("p_partkey", F.posexplode(T.table_rows(md)).alias("n", "cells"))
    return cells.where("n > 0").select("p_partkey", F.col("cells")[0].alias("name"), F.col("cells")[1].alias("type"))


# each .. takes away the part before it, which a text that grows part by part states
_PARTS = "list_filter(string_split(case when path = '' then page when path like '/%' then substr(path, 2) else regexp_replace(page, '[^/]*$', '') || path end, '/'), lambda x: x not in ('', '.'))"
_BROKEN = f"""l as (select host, page, unnest(regexp_extract_all({{html}}, 'href="([^"]*)"', 1)) as href from q),
r as (select host, page, href, regexp_replace(href, '[?#].*$', '') as path from l where not regexp_matches(href, '^[a-zA-Z][a-zA-Z0-9+.-]*:|^//')),
j as (select host, page, href, substr(list_reduce(list_concat([''], {_PARTS}), lambda a, p: case when p = '..' then regexp_replace(a, '/?[^/]*$', '') else a || '/' || p end), 2) as name, path from r),
t as (select host, page, href, case when name = '' then 'index.html' when path like '%/' then name || '/index.html' when not contains(string_split(name, '/')[-1], '.') then name || '/index.html' else name end as target from j)"""

_CLIMBING = """html || '<a href="../' || regexp_extract(page, '([^/]*)/[^/]*$', 1) || '/">x</a><a href="./../../none.html">y</a>'"""

QUERIES = {
    "published_projection": (published_projection, f"with {_FACTS} select fact_id, page, rule, tier, day from f where durability = 'durable'"),
    "contract_view": (contract_view, f"with {_FACTS} select page, count(*) as n, md5(string_agg('- ' || rule || ' (' || tier || ')', chr(10) order by fact_id)) as body from f where durability = 'durable' group by page"),
    "current_state_view": (current_state_view, f"with {_FACTS} select 'facts' as key, count(*)::varchar as value from f union all select 'as_of', strftime(max(day), '%Y-%m-%d') from f union all select rule, tier from f where durability = 'volatile'"),
    "page_rows": (page_rows, f"with {_FACTS} select fact_id, '| ' || rule || ' | ' || tier || ' |' as md, '<li id=\"order-' || fact_id || '\">' || {_ESC.format('tier')} || '</li>' as html from f"),
    "topic_counts": (topic_counts, f"with {_FACTS} select page, count(*) as n, min(day) as earliest from f where durability = 'durable' group by page"),
    "nav_groups": (nav_groups, f"with {_SITE} select host, min(page_id) as first_ord, count(*) as pages from q group by host"),
    "facet_rows": (facet_rows, f"with {_FACTS} select fact_id, tier from f where durability = 'durable' and tier in ('1-URGENT', '2-HIGH')"),
    "facet_counts": (facet_counts, f"with {_FACTS} select count(*) filter (durability = 'durable' and tier in ('1-URGENT', '2-HIGH')) as visible, count(*) as total from f"),
    "link_integrity": (link_integrity, f"with {_SITE}, {_BROKEN.format(html=_CLIMBING)} select distinct host, page, href, 'no target' as problem from t where (host, target) not in (select (host, page) from q)"),
    "link_fragments": (link_fragments, f"with {_SITE} select distinct host, page, '#top' as href, 'no fragment' as problem from q"),
    "sitemap": (sitemap, f"select page_id, '<url><loc>' || {_ESC.format('url')} || '</loc><lastmod>2024-05-01</lastmod></url>' as entry from pages"),
    "sitemap_difference": (sitemap_difference, "select url, 'left' as side from (select url from pages except all select url from pages where page_id % 10 <> 0)"),
    "text_index": (text_index, f"with {_SITE} select page_id, page || chr(9) || regexp_extract(html, '<title>([^<]*)</title>', 1) as line from q"),
    "structured_data": (structured_data, "select page_id, md5(json_object('@type', 'Article', 'headline', regexp_extract(html, '<title>([^<]*)</title>', 1), 'url', url, 'dateModified', '2024-05-01')) as json from pages"),
    "cross_format_parity": (cross_format_parity, "select l_orderkey as k, count(*) as one, max(l_linenumber)::bigint as two from lineitem group by l_orderkey having count(*) <> max(l_linenumber)"),
    "facet_labels": (facet_labels, "select o_orderkey as fact_id, o_orderpriority as expected, null::varchar as found from orders where o_orderpriority = '4-NOT SPECIFIED'"),
    "first_sentences": (first_sentences, "select doc_id, regexp_extract(text, '(?s)^(.*?[.!?])(?:\\s|$)', 1) as sentence, case when length(text) > 20 then text[1:20] || '...' else text end as short from documents"),
    "hit_windows": (hit_windows, "with h as (select doc_id, text, instr(text, 'License') as i from documents where contains(text, 'License')) select doc_id, substr(text, greatest(i - 40, 1), i - greatest(i - 40, 1) + 60) as window from h"),
    "markdown_tables": (markdown_tables, "select p_partkey, p_name as name, p_type as type from part"),
}
