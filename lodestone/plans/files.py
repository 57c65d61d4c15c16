"""Registered queries over files that are written from the tables and read back, each with its SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import publish
from ..sources import documents as D
from ..sources.artefacts import write_tree
from ..sources.kept import fresh_path
from ..sources.tables import site, table
from .publishing import _ESC


def _brands(spark, sf) -> DataFrame:
    """(name, parts, items): the parts of a brand, as Markdown lines in order; a brand's page holds what a reader is shown."""
    parts = table(spark, sf, "part").select(F.replace(F.lower("p_brand"), F.lit("#"), F.lit("-")).alias("name"), F.col("p_partkey").alias("ord"), F.col("p_name").alias("text"))
    return publish.by_group(parts, "name", "ord", F.concat(F.lit("- "), "text"))


def _markdown(brands: DataFrame) -> DataFrame:
    head = F.concat(F.lit("---\ntitle: "), "name", F.lit("\nsources: ["), F.col("n").cast("string"), F.lit(", 1]\ntitle: Brand "), "name", F.lit("\n---\n"))
    return brands.select(F.concat(F.lit("md/"), "name", F.lit(".md")).alias("rel"), F.concat(head, "body").alias("content"))


def _json(brands: DataFrame) -> DataFrame:
    """Every third file is wrapped in a field, every fifth cut off."""
    k = F.substring("name", -1, 1).cast("int")
    plain = F.to_json(F.struct(F.col("name"), F.col("n")))
    content = F.when(k == 1, F.substring(plain, F.lit(1), F.length(plain) - 3)).when(k == 2, F.concat(F.lit('{"brand": '), plain, F.lit("}"))).otherwise(plain)
    return brands.select(F.concat(F.lit("json/"), "name", F.lit(".json")).alias("rel"), content.alias("content"))


def _html(brands: DataFrame) -> DataFrame:
    body = F.concat(F.lit("<h1>"), T.html_escape(F.col("name")), F.lit("</h1>\n<p>"), T.html_escape(F.col("body")), F.lit("</p>\n"))
    return brands.select(F.concat(F.lit("html/"), "name", F.lit("/index.html")).alias("rel"), body.alias("content"))


def _tree(spark, sf, *kinds) -> str:
    brands, path = _brands(spark, sf), fresh_path(spark, "tree")
    readme = spark.createDataFrame([("md/README.md", "not a page")], "rel string, content string")
    write_tree(reduce(DataFrame.unionByName, [kind(brands) for kind in kinds], readme), path)
    return path


def tree_files(spark, sf):
    """Every Markdown and HTML file below the tree, README left out, by its path; with the Markdown folder copied as it is."""
    path = _tree(spark, sf, _markdown, _html)
    D.copy_static(spark, f"{path}/md", f"{path}/html/static")
    found = D.files_below(spark, path, ["md", "html"], "README.md")
    return found.select(F.regexp_extract("path", r"tree-[0-9a-f]+/(.*)$", 1).alias("rel"), F.md5("content").alias("content"))


def tree_front_matter(spark, sf):
    """Front matter of a folder's Markdown files: of two titles the last, and a list of whole numbers."""
    path = _tree(spark, sf, _markdown)
    head = D.whole_files(spark, f"{path}/md").select("file", D.front_matter(F.col("content")).alias("h"))
    return head.select("file", F.col("h.title").alias("title"), F.array_join(D.front_list(F.col("h.sources")).cast("array<string>"), ",").alias("sources"))


def tree_lines(spark, sf):
    """The numbered lines of the Markdown files that hold parts."""
    path = _tree(spark, sf, _markdown)
    lines = D.numbered_lines(D.whole_files(spark, f"{path}/md"))
    return lines.where("text like '- %'").select("file", "line_no", F.md5("text").alias("text"))


def tree_strict_json(spark, sf):
    """The files whose names say that they are whole, read by a schema that nothing may break."""
    path = _tree(spark, sf, _json)
    return D.strict_json(spark, f"{path}/json/*[3-9].json", "name string, n bigint")


def tree_tolerant_json(spark, sf):
    """All files: cut off ones are defaults, and what a field wraps is unwrapped."""
    path = _tree(spark, sf, _json)
    raw = D.whole_files(spark, f"{path}/json", "*.json", None)
    rows = raw.select("file", D.unwrapped(F.col("content"), "brand", "struct<name: string, n: bigint>").alias("r"))
    read = D.tolerant_json(spark, f"{path}/json", "name string, n bigint", {"n": F.lit(-1).cast("bigint")})
    broken = read.agg(F.count_if((F.col("n") == -1) & F.col("_corrupt_record").isNotNull()).alias("broken"))
    return rows.select("file", F.col("r.name").alias("name"), F.coalesce("r.n", F.lit(-1)).alias("n")).crossJoin(F.broadcast(broken))  # one row


def tree_lossy(spark, sf):
    """Documents written in one byte a letter and read as UTF-8: what is no UTF-8 comes as replacement characters."""
    path = fresh_path(spark, "tree")
    rows = table(spark, sf, "documents").select("source", F.concat_ws("\n", F.col("doc_id").cast("string"), F.element_at(F.split("text", "\n"), 1)).alias("text"), F.col("doc_id").alias("ord"))
    files = publish.by_group(rows, "source", "ord", F.col("text")).select(F.concat("source", F.lit(".txt")).alias("rel"), F.encode("body", "ISO-8859-1").alias("content"))
    write_tree(files, path)
    return D.lossy_files(spark, path).select("file", F.md5("content").alias("content"))


def sitemap_files(spark, sf):
    """Sitemaps of at most a hundred addresses and their index, written and read back."""
    path = fresh_path(spark, "tree")
    pages = site(spark, sf).select(F.col("page_id").alias("ord"), "url")
    write_tree(publish.sitemap_files(pages, F.lit("2024-05-01").cast("date"), "https://docs.example.org", 100), path)
    return D.whole_files(spark, path, "*.xml", None).select("file", F.md5("content").alias("content"))


_BRANDS = "b as (select replace(lower(p_brand), '#', '-') as name, count(*) as n, string_agg('- ' || p_name, chr(10) order by p_partkey) as body from part group by 1)"
_MD = "'---' || chr(10) || 'title: ' || name || chr(10) || 'sources: [' || n || ', 1]' || chr(10) || 'title: Brand ' || name || chr(10) || '---' || chr(10) || body || chr(10)"
_HTML = "'<h1>' || name || '</h1>' || chr(10) || '<p>' || " + _ESC.format("body") + " || '</p>' || chr(10)"
_XML = """'<?xml version="1.0" encoding="UTF-8"?>' || chr(10) || '<{0} xmlns="http://www.sitemaps.org/schemas/sitemap/0.9">' || chr(10) || {1} || chr(10) || '</{0}>' || chr(10)"""

QUERIES = {
    "tree_files": (tree_files, f"with {_BRANDS}, f as (select 'md/' || name || '.md' as rel, {_MD} as content from b union all select 'html/' || name || '/index.html', {_HTML} from b) select rel, md5(content) as content from f union all select 'html/static/' || name || '.md', md5({_MD}) from b"),
    "tree_front_matter": (tree_front_matter, f"with {_BRANDS} select name || '.md' as file, 'Brand ' || name as title, n || ',1' as sources from b"),
    "tree_lines": (tree_lines, f"with {_BRANDS}, l as (select name || '.md' as file, unnest(string_split(body, chr(10))) as text, unnest(range(1, n + 1)) as i from b) select file, (i + 5)::int as line_no, md5(text) as text from l"),
    "tree_strict_json": (tree_strict_json, f"with {_BRANDS} select name, n from b where right(name, 1)::int >= 3"),
    "tree_tolerant_json": (
        tree_tolerant_json,
        f"with {_BRANDS} select name || '.json' as file, case when right(name, 1) <> '1' then name end as name, case when right(name, 1) <> '1' then n else -1 end as n, (select count(*) from b where right(name, 1) = '1') as broken from b",
    ),
    "tree_lossy": (
        tree_lossy,
        "with d as (select source, string_agg(doc_id || chr(10) || string_split(text, chr(10))[1], chr(10) order by doc_id) || chr(10) as body from documents group by source) select source || '.txt' as file, md5(regexp_replace(body, '[^\\x00-\\x7F]', chr(65533), 'g')) as content from d",
    ),
    "sitemap_files": (
        sitemap_files,
        f"""with p as (select '<url><loc>' || {_ESC.format("url")} || '</loc><lastmod>2024-05-01</lastmod></url>' as line, page_id, row_number() over (order by page_id) as place from pages), k as (select (place - 1) // 100 as file, string_agg(line, chr(10) order by page_id) as body from p group by 1),
s as (select max(file) as last from k), f as (select case when last > 0 then 'sitemap-' || (file + 1) || '.xml' else 'sitemap.xml' end as file, {_XML.format("urlset", "body")} as content from k, s
union all select 'sitemap.xml', {_XML.format("sitemapindex", "(select string_agg('<sitemap><loc>https://docs.example.org/sitemap-' || (file + 1) || '.xml</loc></sitemap>', chr(10) order by file) from k)")} from s where last > 0) select file, md5(content) as content from f""",
    ),
}
