"""Publishing: filtered projections, grouped views, navigation, facets, link checks and rendered artefacts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import html_escape
from .search import ranked_by_count

SCHEME = "^[a-zA-Z][a-zA-Z0-9+.-]*:|^//"


def durable(facts: DataFrame) -> DataFrame:
    return facts.where("durability = 'durable'")


def published(facts: DataFrame, internal: list[str]) -> DataFrame:
    """The public projection: durable facts without internal columns."""
    return durable(facts).drop(*internal)


def by_group(facts: DataFrame, group: str, order: str, item: Column) -> DataFrame:
    """(group, n, body): each group's items in order, empty groups left out. A page's facts are one group; groups are bounded by what a page holds."""
    return facts.groupBy(group).agg(F.count("*").alias("n"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), item.alias("i")))), lambda x: x["i"]), "\n").alias("body"))


def navigation(pages: DataFrame, group: str) -> DataFrame:
    """(group, first_ord, pages): groups in order of first appearance."""
    return pages.groupBy(group).agg(F.min("ord").alias("first_ord"), F.count("*").alias("pages"))


def facet(rows: DataFrame, selections: dict[str, list]) -> Column:
    """Within a facet any selected value, across facets all; an empty facet passes."""
    out = F.lit(True)
    for column, chosen in selections.items():
        if chosen:
            out = out & F.coalesce(F.col(column).isin(chosen), F.lit(False))
    return out


def facet_counts(rows: DataFrame, selections: dict[str, list]) -> DataFrame:
    return rows.agg(F.count_if(facet(rows, selections)).alias("visible"), F.count("*").alias("total"))


def _hosted(pages: DataFrame) -> DataFrame:
    """pages with their host; those without one are all of one site."""
    return pages if "host" in pages.columns else pages.withColumn("host", F.lit(""))


def links(pages: DataFrame) -> DataFrame:
    """(host, page, href) of pages(page, html) or pages(host, page, html)."""
    return _hosted(pages).select("host", "page", F.explode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))).alias("href"))


def anchors(pages: DataFrame) -> DataFrame:
    """(host, target, fragment): the ids of each page."""
    return _hosted(pages).select("host", F.col("page").alias("target"), F.explode(F.array_distinct(F.regexp_extract_all("html", F.lit(' id="([^"]*)"'), F.lit(1)))).alias("fragment"))


def resolve(href: Column, page: Column) -> Column:
    """A link's target: / is the root, all else is relative to the page's directory; a directory or a name without ending is its index.html. Links with a scheme, and fragments alone, are null and the page."""
    path = F.regexp_replace(href, "[?#].*$", "")
    directory = F.regexp_replace(page, "[^/]*$", "")
    joined = F.when(path == "", page).when(F.startswith(path, F.lit("/")), F.substr(path, F.lit(2))).otherwise(F.concat(directory, path))
    parts = F.filter(F.split(joined, "/"), lambda p: (p != ".") & (p != ""))
    # each .. takes away the part before it
    plain = F.aggregate(parts, F.array().cast("array<string>"), lambda a, p: F.when(p == "..", F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(0)))).otherwise(F.concat(a, F.array(p))))
    name = F.array_join(plain, "/")
    ends = F.endswith(joined, F.lit("/")) | (name == "")
    whole = F.when(ends, F.concat(name, F.when(name == "", "").otherwise("/"), F.lit("index.html"))).when(~F.coalesce(F.element_at(F.split(name, "/"), -1), F.lit("")).contains("."), F.concat(name, F.lit("/index.html"))).otherwise(name)
    return F.when(~href.rlike(SCHEME), whole)


def broken_links(pages: DataFrame) -> DataFrame:
    """([host,] page, href, problem): links of pages([host,] page, html) without a target on their own site, and fragments that their target lacks."""
    columns = ["host", "page", "href"] if "host" in pages.columns else ["page", "href"]
    there = _hosted(pages).select("host", F.col("page").alias("target")).distinct()
    found = links(pages).withColumn("target", resolve(F.col("href"), F.col("page"))).where("target is not null")
    missing = found.join(there, ["host", "target"], "left_anti").select(*columns, F.lit("no target").alias("problem"))
    fragments = found.withColumn("fragment", F.regexp_extract("href", "#(.*)$", 1)).where("fragment <> ''").join(there, ["host", "target"], "left_semi")
    return missing.unionByName(fragments.join(anchors(pages), ["host", "target", "fragment"], "left_anti").select(*columns, F.lit("no fragment").alias("problem")))


def sitemap_entry(url: Column, day: Column) -> Column:
    return F.concat(F.lit("<url><loc>"), html_escape(url), F.lit("</loc><lastmod>"), F.date_format(day, "yyyy-MM-dd"), F.lit("</lastmod></url>"))


def structured_header(title: Column, url: Column, day: Column) -> Column:
    """An article and its breadcrumb as JSON."""
    article = F.struct(F.lit("Article").alias("@type"), title.alias("headline"), url.alias("url"), F.date_format(day, "yyyy-MM-dd").alias("dateModified"))
    return F.to_json(article)


def parity(one: DataFrame, two: DataFrame, key: str, value: str) -> DataFrame:
    """(key, one, two): keys whose value differs between two renderings, or that one lacks."""
    both = one.select(key, F.col(value).alias("one")).join(two.select(key, F.col(value).alias("two")), key, "full")
    return both.where(~F.col("one").eqNullSafe(F.col("two")))


def symmetric_difference(one: DataFrame, two: DataFrame) -> DataFrame:
    return one.exceptAll(two).withColumn("side", F.lit("left")).unionByName(two.exceptAll(one).withColumn("side", F.lit("right")))


def breadcrumb(host: Column, title: Column) -> Column:
    """The way from a site to a page as JSON."""
    step = lambda n, name: F.struct(F.lit("ListItem").alias("@type"), F.lit(n).alias("position"), name.alias("name"))
    return F.to_json(F.struct(F.lit("BreadcrumbList").alias("@type"), F.array(step(1, host), step(2, title)).alias("itemListElement")))


def page_header(title: Column, url: Column, day: Column, host: Column) -> Column:
    """Article and breadcrumb of a page, as one JSON array."""
    return F.concat(F.lit("["), structured_header(title, url, day), F.lit(","), breadcrumb(host, title), F.lit("]"))


def sitemap_document(pages: DataFrame, day: Column) -> DataFrame:
    """(ord, line): a whole sitemap of pages(ord, url), to be written in the order of ord."""
    frame = pages.sparkSession.createDataFrame([(-2, '<?xml version="1.0" encoding="UTF-8"?>'), (-1, '<urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9">'), (2**62, "</urlset>")], "ord long, line string")
    return frame.unionByName(pages.select("ord", sitemap_entry(F.col("url"), day).alias("line")))


def home(facts: DataFrame, topic: str, most: int = 5) -> DataFrame:
    """(position, topic, n, route): the topics with most facts, numbered, and where each leads."""
    best = facts.groupBy(topic).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.asc(topic)).limit(most)
    numbered = best.agg(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("less"), F.col(topic).alias("topic"), "n"))).alias("all"))  # `most` rows
    return numbered.select(F.posexplode("all").alias("p", "x")).select((F.col("p") + 1).alias("position"), F.col("x.topic").alias("topic"), F.col("x.n").alias("n"), F.concat(F.lit("/"), F.col("x.topic").cast("string"), F.lit("/index.html")).alias("route"))


def contents(facts: DataFrame, topic: str, order: str, text: Column, anchor: Column) -> DataFrame:
    """(topic, n, body): a topic's table of contents, an entry for each fact in order."""
    return by_group(facts, topic, order, F.concat(F.lit("- ["), text, F.lit("](#"), anchor, F.lit(")")))


def rendered_counts(views: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(key, n) of a Markdown view's list items and of an HTML view's, of views(key, md, html), to be held against each other by parity()."""
    count = lambda column, pattern: F.regexp_count(F.coalesce(F.col(column), F.lit("")), F.lit(pattern)).cast("long").alias("n")
    return views.select(key, count("md", "(?m)^- ")), views.select(key, count("html", "<li[ >]"))


#: Addresses of one sitemap file, by the format's own limit.
SITEMAP_URLS = 50_000


def sitemap_files(pages: DataFrame, day: Column, base: str, most: int = SITEMAP_URLS) -> DataFrame:
    """(rel, content) of the sitemaps of pages(ord, url), in the order of ord, which tells pages apart: one file up to `most` addresses, else numbered files and, as sitemap.xml, an index of them at `base`."""
    head = '<?xml version="1.0" encoding="UTF-8"?>'
    space = "http://www.sitemaps.org/schemas/sitemap/0.9"
    place = ranked_by_count(pages.select(F.lit(0).alias("_all"), F.col("ord").alias("id"), "url"), "_all").withColumn("file", F.floor((F.col("rank") - 1) / most))
    lines = F.transform(F.array_sort(F.collect_list(F.struct("rank", sitemap_entry(F.col("url"), day).alias("line")))), lambda x: x["line"])
    files = place.groupBy("file").agg(F.array_join(lines, "\n").alias("body"))  # at most `most` addresses
    files = files.select("file", F.concat(F.lit(f'{head}\n<urlset xmlns="{space}">\n'), "body", F.lit("\n</urlset>\n")).alias("content"))
    several = files.agg(F.max("file").alias("last")).select((F.col("last") > 0).alias("several"))
    named = files.crossJoin(F.broadcast(several)).select(F.when(F.col("several"), F.concat(F.lit("sitemap-"), (F.col("file") + 1).cast("string"), F.lit(".xml"))).otherwise("sitemap.xml").alias("rel"), "content")  # one row
    last = place.agg(F.max("file").alias("last")).where("last > 0")
    names = F.transform(F.sequence(F.lit(1).cast("long"), F.col("last") + 1), lambda k: F.concat(F.lit(f"<sitemap><loc>{base}/sitemap-"), k.cast("string"), F.lit(".xml</loc></sitemap>")))
    index = last.select(F.lit("sitemap.xml").alias("rel"), F.concat(F.lit(f'{head}\n<sitemapindex xmlns="{space}">\n'), F.array_join(names, "\n"), F.lit("\n</sitemapindex>\n")).alias("content"))
    return named.unionByName(index)
