"""Registered queries of retrieval, graphs, registries and differences, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import diff, extract, graph, registry, search, snapshots
from ..operators.postings import FORMAT
from ..sources import kept
from ..sources.tables import sections, table

QUERY = "idiot licensed thereat onblereon moron"
LOOKUP = "the erth ing"

_STOP = "[" + ",".join(f"'{w}'" for w in T.STOP_WORDS) + "]"
_TOKENS = "list_filter(string_split(regexp_replace(lower({0}), '[^a-z0-9]+', ' ', 'g'), ' '), lambda w: length(w) > 1 and not list_contains(" + _STOP + ", w))"
_SECTIONS = "s as (select doc_id as id, doc_id as ord, string_split(text, chr(10))[1] as title, source as file, text from documents)"
_INDEX = f"""{_SECTIONS}, t as (select id, unnest({_TOKENS.format("text")}) as term from s),
c as (select id, term, count(*) as tf from t group by id, term),
m as (select id, greatest(max(tf), 1) as most from c group by id),
d as (select term, count(*) as df, ln((select count(*) from s)::double / count(*)) as idf from c group by term),
w as (select c.id, c.term, (0.5 + 0.5 * c.tf / m.most) * d.idf as weight from c join m on c.id = m.id join d on c.term = d.term),
n as (select id, count(*) as terms, sqrt(sum(weight * weight)) as norm from w group by id)"""


def _asked(query: str) -> str:
    return "a as (select unnest([" + ",".join(f"'{t}'" for t in search.query_tokens(query)) + "]) as term)"


_EXPAND = """x as (select term from a union select d.term from d join (select term from a where length(term) >= 4 and term not in (select term from d)) q
on starts_with(d.term, q.term) and length(q.term) >= 0.6 * length(d.term) or starts_with(q.term, d.term) and length(d.term) >= 4 or contains(d.term, q.term) and length(q.term) >= 5)"""
_SCORE = f"""{_EXPAND}, v as (select x.term, coalesce(d.idf, ln(50)) as q from x left join d on x.term = d.term),
z as (select w.id, sum(w.weight * v.q) / (any_value(n.norm) * (select sqrt(sum(q * q)) from v)) as score from w join v on w.term = v.term join n on w.id = n.id where n.norm > 0 group by w.id having score >= 0.03)"""
_QUESTIONS = f"a as (select distinct item_id::varchar as query, unnest({_TOKENS.format('text')}) as term from benchmark)"
_NEAR = """y as (select q.term, d.term as near from d join (select distinct term from {asked} where length(term) >= 4 and term not in (select term from d)) q
on starts_with(d.term, q.term) and length(q.term) >= 0.6 * length(d.term) or starts_with(q.term, d.term) and length(d.term) >= 4 or contains(d.term, q.term) and length(q.term) >= 5)"""
_POSTING = f"p as (select id, unnest(list_distinct({_TOKENS.format('title')})) as keyword from s), pp as (select * from p where length(keyword) >= 4)"


def _index(spark, sf):
    """The kept index of the documents: built where there is none of these files yet, then opened."""
    rows = sections(spark, sf)
    return search.Index.open(spark, kept.kept(spark, f"section-index-{FORMAT}", table(spark, sf, "documents"), lambda path: search.Index.build(rows, path)))


def tfidf_search(spark, sf):
    return _index(spark, sf).semantic(QUERY).select("id", F.round("score", 6).alias("score"))


def semantic_top(spark, sf):
    best = _index(spark, sf).best(QUERY, 3)
    return best.select("id", F.round("score", 6).alias("score"), search.score_band(F.col("score")).alias("band"))


def keyword_search(spark, sf):
    hits = _index(spark, sf).keyword(LOOKUP, [])
    return search.ranked_by_count(hits, "hits")


def keyword_lookup(spark, sf):
    words = search.asked(spark, {LOOKUP: LOOKUP.split(" ")})
    hits = _index(spark, sf).postings.keyword_hits(words).select("id", F.col("matches").alias("hits"))
    return search.ranked_by_count(hits, "hits")


def query_expansion(spark, sf):
    return _index(spark, sf).postings.expanded(search.asked(spark, {QUERY: search.query_tokens(QUERY)})).select("term")


def _questions(spark, sf):
    """(query, term): the tokens of every benchmark item, as queries."""
    return table(spark, sf, "benchmark").select(F.col("item_id").cast("string").alias("query"), F.explode(F.array_distinct(T.tokens(F.col("text")))).alias("term"))


def _cut_words(asked):
    """The words of queries without their last letters, as a typing reader leaves them."""
    return asked.where(F.length("term") >= 6).select("query", F.expr("left(term, length(term) - 2)").alias("term"))


def keyword_search_many(spark, sf):
    """Every benchmark item as a query: the sections that hold its tokens, ranked within each query."""
    hits = _index(spark, sf).postings.keyword_hits(kept.settled(_questions(spark, sf))).select("query", "id", "hits")
    return search.ranked_by_count(kept.written(hits, "keyword-hits"), "hits", by=("query",))


def query_expansion_many(spark, sf):
    return _index(spark, sf).postings.expanded(_cut_words(_questions(spark, sf)))


def semantic_top_many(spark, sf):
    """The three best sections for every benchmark item."""
    best = _index(spark, sf).postings.top(_questions(spark, sf), 3, search.MIN_SCORE, search.UNKNOWN_IDF)
    return best.select("query", "id", F.round("score", 6).alias("score"), "rank")


def index_idf(spark, sf):
    return _index(spark, sf).idf.select("term", "df", F.round("idf", 6).alias("idf"))


def index_norms(spark, sf):
    return _index(spark, sf).norm.select("id", "terms", F.round("norm", 6).alias("norm"))


def idf_range(spark, sf):
    return _index(spark, sf).idf.agg(F.count("*").alias("terms"), F.round(F.min("idf"), 6).alias("least"), F.round(F.max("idf"), 6).alias("most"))


def hybrid_search(spark, sf):
    return _index(spark, sf).hybrid(QUERY + " " + LOOKUP, 10).withColumn("rrf", F.round("rrf", 6))


def section_topics(spark, sf):
    posting = search.postings(sections(spark, sf))
    return posting.groupBy("id").agg(F.array_join(F.array_sort(F.collect_set("keyword")), " ").alias("topics"), F.count("*").alias("n"))


def _edges(spark, sf, seeds):
    """Links of a few seeds to all vectors. Ids are unique, so the seeds' own vectors are as many as the seeds; they become literals of one pass over the table."""
    rows = table(spark, sf, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("e"))
    known = {r["vec_id"]: r["e"] for r in rows.where(F.col("vec_id").isin(seeds)).dropDuplicates(["vec_id"]).collect()}
    near = F.array(*[F.struct(F.lit(s).cast("long").alias("src"), F.array(*[F.lit(x) for x in v]).alias("q")) for s, v in known.items()])
    both = rows.select("vec_id", "e", F.explode(near).alias("n")).where("vec_id <> n.src") if known else rows.select("vec_id", "e", F.struct(F.col("vec_id").alias("src"), F.col("e").alias("q")).alias("n")).where("false")
    dot = F.aggregate(F.zip_with("e", "n.q", lambda x, y: x * y), F.lit(0.0), lambda a, x: a + x)
    return both.select("n.src", F.col("vec_id").alias("pos"), F.col("vec_id").alias("dst"), F.round(dot, 6).alias("relevance"), F.lit("near").alias("reason"))


SEEDS = [100, 200, 300]


def _neighbours(best):
    def run(spark, sf):
        seeds = spark.createDataFrame([(s, i) for i, s in enumerate(SEEDS)], "src long, seed_pos int")
        return graph.neighbours(seeds, _edges(spark, sf, SEEDS), 0.2, best).select("dst", "relevance", "via")

    return run


def _neighbours_sql(order):
    seeds = ", ".join(f"({s}, {i})" for i, s in enumerate(SEEDS))
    return f"""with seeds(src, seed_pos) as (values {seeds}),
e as (select s.src, s.seed_pos, r.vec_id as dst, round(list_dot_product(r.embedding::double[], q.embedding::double[]), 6) as relevance
from seeds s join embeddings q on q.vec_id = s.src join embeddings r on r.vec_id <> s.src)
select dst, relevance, src as via from (select *, row_number() over (partition by dst order by {order}) as n from e where relevance >= 0.2 and dst not in (select src from seeds)) where n = 1"""


def symptom_match(spark, sf):
    patterns = table(spark, sf, "benchmark").select(F.col("item_id").alias("symptom"), F.filter(F.split("text", "\n"), lambda x: F.trim(x) != "").alias("pattern"))
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text")
    return graph.symptoms(docs, patterns).select("id", "symptom", F.size("matched").cast("long").alias("matched"))


def section_fetch(spark, sf):
    rows = sections(spark, sf).withColumns({"start_line": F.lit(2), "end_line": F.when(F.col("id") % 2 == 0, 3)})
    return graph.fetch(rows).select("id", F.length("body").cast("long").alias("chars"), F.md5("body").alias("body"))


def section_listing(spark, sf):
    rows = sections(spark, sf).withColumn("line_count", F.size(F.split("text", "\n")).cast("long"))
    return graph.listing(rows)


def section_metadata(spark, sf):
    """Bounds and titles of sections; a missing title has a default."""
    rows = sections(spark, sf).select("id", "file", F.when(F.length("title") > 40, None).otherwise(F.col("title")).alias("title"), F.lit(1).alias("start_line"), F.size(F.split("text", "\n")).alias("end_line"))
    return rows.select("id", "file", F.coalesce("title", F.concat(F.lit("Section "), F.col("id").cast("string"))).alias("title"), (F.col("end_line") - F.col("start_line") + 1).cast("long").alias("line_count"))


def section_by_id(spark, sf):
    return sections(spark, sf).where(F.col("id") == 7).select("id", "file", F.md5("text").alias("text"))


def tokens_by_file(spark, sf):
    """Token, distinct-token and largest-count figures of each file."""
    counts = sections(spark, sf).select("file", F.explode(T.tokens(F.col("text"))).alias("term")).groupBy("file", "term").agg(F.count("*").alias("c"))
    return counts.groupBy("file").agg(F.sum("c").alias("tokens"), F.count("*").alias("terms"), F.max("c").alias("most"))


def merged_sources(spark, sf):
    both = sections(spark, sf).select("id", "ord", "file")
    return graph.merged(both.where("file <> 'src0'"), both.withColumn("file", F.lit("fallback")), "id").select("id", "file")


TERM = "12"


def registry_lookup(spark, sf):
    parts = table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), "p_brand", "p_type")
    makers = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"))
    return registry.lookup(TERM, part=(parts, ["name", "p_brand", "p_type"]), supplier=(makers, ["name"]))


def staleness_audit(spark, sf):
    month = lambda c: F.date_format(c, "yyyy.M")
    orders = table(spark, sf, "orders").select(F.lit("order").alias("kind"), F.col("o_orderkey").alias("id"), month("o_orderdate").alias("as_of"))
    events = table(spark, sf, "events").select(F.lit("event").alias("kind"), F.col("event_id").alias("id"), month("ts").alias("as_of"))
    baseline = table(spark, sf, "orders").agg(month(F.max("o_orderdate")).alias("baseline"))
    return registry.stale(orders.unionByName(events), baseline)


def freshness_bands(spark, sf):
    rows = table(spark, sf, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("day"))
    return registry.freshness(rows, "day", F.lit("1998-09-30").cast("date")).select("o_orderkey", "age_days", "band")


def version_check(spark, sf):
    found = table(spark, sf, "documents").select("doc_id", T.version_in(F.col("text")).alias("version"))
    return registry.version_mismatch(found, "1.0.0")


def _snapshots(spark, sf):
    events = table(spark, sf, "events")
    half = F.expr("n div 2")
    events = events.crossJoin(F.broadcast(events.agg(F.count("*").alias("n"))))  # one row
    last = lambda rows: diff.last_wins(rows, ["user_id", "event_type"], "value", "event_id")
    return last(events.where(F.col("event_id") < half)), last(events.where(F.col("event_id") >= half))


_SNAP = "h as (select count(*) // 2 as half from events), o as (select user_id, event_type, arg_max(value, event_id) as v from events, h where event_id < half group by all), n as (select user_id, event_type, arg_max(value, event_id) as v from events, h where event_id >= half group by all)"
_DIFF = """d as (select coalesce(o.user_id, n.user_id) as user_id, coalesce(o.event_type, n.event_type) as event_type, o.v as old_value, n.v as new_value,
case when o.user_id is null then 'added' when n.user_id is null then 'removed' when o.v = n.v then 'unchanged' else 'changed' end as status from o full join n on o.user_id = n.user_id and o.event_type = n.event_type)"""


def snapshot_map_diff(spark, sf):
    return diff.map_diff(*_snapshots(spark, sf), ["user_id", "event_type"], "value")


def snapshot_summary(spark, sf):
    return diff.summary(snapshot_map_diff(spark, sf))


def snapshot_set_diff(spark, sf):
    """Words of documents of even ids, as the old snapshot, against those of odd ids, as the new one."""
    docs = table(spark, sf, "documents")
    one, two = (docs.where(F.col("doc_id") % 2 == k).select(F.explode(T.tokens(F.col("text"))).alias("term")) for k in (0, 1))
    return diff.set_diff(one, two, ["term"])


def unconfirmed_additions(spark, sf):
    """Values of a user and type, by twenties, that the newer half of the events has and the older has not, and that no event of an even id confirms."""
    events = table(spark, sf, "events")
    events = events.crossJoin(F.broadcast(events.agg(F.expr("count(*) div 2").alias("half")))).withColumn("band", F.floor(F.col("value") / 20).cast("int"))  # one row
    key = ["user_id", "event_type", "band"]
    added = diff.set_diff(events.where("event_id < half"), events.where("event_id >= half"), key).where("status = 'added'").select(*key)
    return diff.unconfirmed(added, events.where("event_id % 2 = 0").select(*key).distinct(), key)


def _event_snapshots(spark, sf):
    """The last value of each user and type, a day before the last event and at it."""
    events = table(spark, sf, "events")
    last = events.agg(F.max("ts").alias("last"))
    events = events.crossJoin(F.broadcast(last))  # one row
    keys = ["user_id", "event_type"]
    old, new = (diff.last_wins(rows, keys, "value", "event_id") for rows in (events.where("ts < last - interval 1 hour"), events))
    return [snapshots.Snapshot.write(rows, keys, "value", kept.fresh_path(spark, "snapshot"), bits=5) for rows in (old, new)]


def snapshot_bucket_diff(spark, sf):
    """What one hour of events changed, from the buckets whose digests differ."""
    old, new = _event_snapshots(spark, sf)
    return old.diff(new)


_EVENT_SNAP = """h as (select max(ts) - interval 1 hour as half from events), o as (select user_id, event_type, arg_max(value, event_id) as v from events, h where ts < half group by all), n as (select user_id, event_type, arg_max(value, event_id) as v from events group by all)"""

#: A line's first word as a name, and what may follow it: a word behind a comma, one behind "of", or at least an end of a sentence.
NAMED, DETAILS, WINDOW = "\n([A-Z][a-z]+)", [(", ([a-z]+)", None), (" of ([a-z]+)", None), ("[.]", "(bare)")], 80
#: Patterns of one pass, one of them with a group.
PLACED = {"number": "[0-9]+", "sentence": "[.] ([A-Z])", "pair": "th[a-z]*ing"}


def placed_matches(spark, sf):
    """Every match of several patterns with its place in the text."""
    return extract.matches(table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text"), PLACED)


def _definitions(spark, sf):
    rows = extract.definitions(table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text"), NAMED, DETAILS, WINDOW)
    return rows.join(table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "source"), "id")


def placed_definitions(spark, sf):
    """Each document's definitions, the last one of a name by its place."""
    return diff.last_wins(_definitions(spark, sf).withColumn("place", F.col("at")), ["id", "name"], "value", "place")


def definition_map_diff(spark, sf):
    """The definitions that the sources' even documents leave against those of the odd ones, the last by document and place."""
    rows = _definitions(spark, sf).withColumn("place", F.struct("id", "at"))
    old, new = (diff.last_wins(rows.where(F.col("id") % 2 == k), ["source", "name"], "value", "place") for k in (0, 1))
    return diff.map_diff(old, new, ["source", "name"], "value")


# the i-th match lies behind the pieces between matches and the matches before it
_AT = "list_sum(list_transform({pieces}[1:i], lambda x: length(x)))::bigint + coalesce(list_sum(list_transform({hits}[1:i - 1], lambda x: length(x))), 0)::bigint"
_DEFINED = f"""h as (select doc_id as id, source, text, regexp_extract_all(text, '\n[A-Z][a-z]+') as hits, regexp_split_to_array(text, '\n[A-Z][a-z]+') as pieces from documents), j as (select *, unnest(range(1, len(hits) + 1)) as i from h),
k as (select id, source, hits[i][2:] as name, {_AT.format(pieces="pieces", hits="hits")} as place, text from j), w as (select *, substr(text, place + 1, 80) as part from k),
d as (select id, source, name, place, case when regexp_matches(part, ', [a-z]+') then regexp_extract(part, ', ([a-z]+)', 1) when regexp_matches(part, ' of [a-z]+') then regexp_extract(part, ' of ([a-z]+)', 1) when contains(part, '.') then '(bare)' end as value from w)"""
_PLACED_SQL = "with " + " , ".join(
    f"h{k} as (select doc_id as id, regexp_extract_all(text, '{p}') as hits, regexp_split_to_array(text, '{p}') as pieces from documents), j{k} as (select id, hits, pieces, unnest(range(1, len(hits) + 1)) as i from h{k})" for k, p in enumerate(PLACED.values())
) + " " + " union all ".join(f"select id, '{n}' as family, {'hits[i][3:]' if '(' in p else 'hits[i]'} as value, {_AT.format(pieces='pieces', hits='hits')} as at from j{k}" for k, (n, p) in enumerate(PLACED.items()))

FAMILIES = {"version": "[0-9]+[.][0-9]+[.][0-9]+", "token": "token = \"[0-9a-f]+\"", "mail": "[A-Za-z0-9.]+@[a-z0-9.]+"}


def extracted_identifiers(spark, sf):
    return diff.identifiers(table(spark, sf, "documents"), "doc_id", "text", FAMILIES)


def embedding_topk(spark, sf):
    """Exact cosine neighbours of three vectors; an extension, not one of the reference's own operators."""
    best = _edges(spark, sf, SEEDS)
    order = F.desc("relevance"), F.asc("src"), F.asc("dst")
    return search.ranked(best.orderBy(*order).limit(10), *order).select("src", "dst", "relevance", "rank")


_FAMILY_SQL = " union all ".join(f"select doc_id, '{n}' as family, unnest(list_distinct(regexp_extract_all(text, '{p}', 0))) as value from documents" for n, p in FAMILIES.items())

QUERIES = {
    "tfidf_search": (tfidf_search, f"with {_INDEX}, {_asked(QUERY)}, {_SCORE} select id, round(score, 6) as score from z"),
    "semantic_top": (semantic_top, f"with {_INDEX}, {_asked(QUERY)}, {_SCORE} select id, round(score, 6) as score, case when score >= 0.2 then 'HIGH' when score >= 0.1 then 'MEDIUM' else 'LOW' end as band from z order by round(z.score, 9) desc, id limit 3"),
    "keyword_search": (
        keyword_search,
        f"with {_SECTIONS}, {_POSTING}, q as (select unnest(['the', 'erth', 'ing']) as token), h as (select id, count(distinct token) as hits from pp join q on contains(lower(keyword), token) group by id) select id, hits, row_number() over (order by hits desc, id)::int as rank from h",
    ),
    "keyword_lookup": (
        keyword_lookup,
        f"with {_SECTIONS}, {_POSTING}, q as (select unnest(['the', 'erth', 'ing']) as token), h as (select id, count(*) as hits from pp join q on contains(lower(keyword), token) group by id) select id, hits, row_number() over (order by hits desc, id)::int as rank from h",
    ),
    "query_expansion": (query_expansion, f"with {_INDEX}, {_asked(QUERY)}, {_EXPAND} select distinct term from x"),
    "keyword_search_many": (
        keyword_search_many,
        f"with {_SECTIONS}, {_POSTING}, {_QUESTIONS}, h as (select query, id, count(distinct term) as hits from pp join a on contains(keyword, term) group by query, id) select query, id, hits, row_number() over (partition by query order by hits desc, id)::int as rank from h",
    ),
    "query_expansion_many": (
        query_expansion_many,
        f"with {_INDEX}, {_QUESTIONS}, c2 as (select distinct query, left(term, length(term) - 2) as term from a where length(term) >= 6), {_NEAR.format(asked='c2')} select query, term from c2 union select query, near from c2 join y on c2.term = y.term",
    ),
    "semantic_top_many": (
        semantic_top_many,
        f"""with {_INDEX}, {_QUESTIONS}, {_NEAR.format(asked='a')}, x as (select query, term from a union select query, near from a join y on a.term = y.term),
v as (select x.query, x.term, coalesce(d.idf, ln(50)) as q from x left join d on x.term = d.term), l as (select query, sqrt(sum(q * q)) as length from v group by query),
z as (select v.query, w.id, sum(w.weight * v.q) / (any_value(n.norm) * any_value(l.length)) as score from w join v on w.term = v.term join n on w.id = n.id join l on v.query = l.query where n.norm > 0 group by v.query, w.id having score >= 0.03),
r as (select *, row_number() over (partition by query order by round(score, 9) desc, id)::int as rank from z) select query, id, round(score, 6) as score, rank from r where rank <= 3""",
    ),
    "index_idf": (index_idf, f"with {_INDEX} select term, df, round(idf, 6) as idf from d"),
    "index_norms": (index_norms, f"with {_INDEX} select id, terms, round(norm, 6) as norm from n"),
    "idf_range": (idf_range, f"with {_INDEX} select count(*) as terms, round(min(idf), 6) as least, round(max(idf), 6) as most from d"),
    "hybrid_search": (
        hybrid_search,
        f"""with {_INDEX}, {_asked(QUERY + " " + LOOKUP)}, {_SCORE}, {_POSTING},
h as (select id, count(distinct term) as hits from pp join a on contains(lower(keyword), term) group by id),
k as (select id, row_number() over (order by hits desc, id)::int as keyword_rank from h), f as (select id, row_number() over (order by round(score, 9) desc, id)::int as tfidf_rank from z),
r as (select coalesce(k.id, f.id) as id, coalesce(1.0 / (60 + keyword_rank), 0) + coalesce(1.0 / (60 + tfidf_rank), 0) as rrf, keyword_rank, tfidf_rank from k full join f on k.id = f.id),
b as (select * from r order by rrf desc, id limit 10)
select b.id, title, round(rrf, 6) as rrf, keyword_rank, tfidf_rank, case when keyword_rank <= 3 and tfidf_rank <= 3 then 'HIGH' when keyword_rank <= 3 or tfidf_rank <= 3 then 'MEDIUM' else 'LOW' end as confidence,
case when keyword_rank is not null and tfidf_rank is not null then 'both layers' when keyword_rank is not null then 'keyword only' else 'tfidf only' end as layer from b join s on b.id = s.id""",
    ),
    "section_topics": (section_topics, f"with {_SECTIONS}, {_POSTING} select id, string_agg(keyword, ' ' order by keyword) as topics, count(*) as n from pp group by id"),
    "neighbour_expansion": (_neighbours(False), _neighbours_sql("seed_pos, dst")),
    "neighbour_expansion_best": (_neighbours(True), _neighbours_sql("relevance desc, seed_pos, dst")),
    "symptom_match": (
        symptom_match,
        "with p as (select item_id as symptom, list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '') as pattern from benchmark), m as (select doc_id as id, symptom, len(list_filter(pattern, lambda x: contains(lower(text), lower(x)))) as matched from documents, p) select id, symptom, matched from m where matched > 0",
    ),
    "section_fetch": (
        section_fetch,
        "with l as (select doc_id as id, string_split(text, chr(10)) as lines from documents), b as (select id, array_to_string(lines[2:least(case when id % 2 = 0 then 3 else len(lines) end, len(lines))], chr(10)) as body from l) select id, length(coalesce(body, '')) as chars, md5(coalesce(body, '')) as body from b",
    ),
    "section_listing": (
        section_listing,
        "select source as file, min(doc_id) as first_ord, count(*) as sections, min(doc_id) as first_id, max(doc_id) as last_id, sum(len(string_split(text, chr(10))))::bigint as lines from documents group by source",
    ),
    "section_metadata": (
        section_metadata,
        f"with {_SECTIONS} select id, file, case when length(title) <= 40 then title else 'Section ' || id end as title, len(string_split(text, chr(10))) as line_count from s",
    ),
    "section_by_id": (section_by_id, "select doc_id as id, source as file, md5(text) as text from documents where doc_id = 7"),
    "tokens_by_file": (
        tokens_by_file,
        f"with t as (select source as file, unnest({_TOKENS.format('text')}) as term from documents), c as (select file, term, count(*) as c from t group by all) select file, sum(c)::bigint as tokens, count(*) as terms, max(c) as most from c group by file",
    ),
    "merged_sources": (merged_sources, "select doc_id as id, case when source <> 'src0' then source else 'fallback' end as file from documents"),
    "registry_lookup": (
        registry_lookup,
        "select 'part' as kind, p_partkey as id, p_name as name from part where contains(lower(p_name), '12') or contains(lower(p_brand), '12') or contains(lower(p_type), '12') union all select 'supplier', s_suppkey, s_name from supplier where contains(lower(s_name), '12')",
    ),
    "staleness_audit": (
        staleness_audit,
        "with r as (select 'order' as kind, o_orderkey as id, strftime(o_orderdate, '%Y.%-m') as as_of from orders union all select 'event', event_id, strftime(ts, '%Y.%-m') from events), b as (select strftime(max(o_orderdate), '%Y.%-m') as baseline from orders) select kind, id, as_of, baseline from r, b where as_of is distinct from baseline",
    ),
    "freshness_bands": (
        freshness_bands,
        "with r as (select o_orderkey, date_diff('day', o_orderdate::date, date '1998-09-30') as age_days from orders) select *, case when age_days <= 45 then 'fresh' when age_days <= 90 then 'aging' else 'expired' end as band from r",
    ),
    "version_check": (version_check, "with v as (select doc_id, regexp_extract(text, '([0-9]+[.][0-9]+[.][0-9]+)', 1) as version from documents) select doc_id, version from v where version not in ('', '1.0.0')"),
    "snapshot_map_diff": (snapshot_map_diff, f"with {_SNAP}, {_DIFF} select * from d"),
    "snapshot_summary": (snapshot_summary, f"with {_SNAP}, {_DIFF} select status, count(*) as n from d group by status"),
    "snapshot_set_diff": (
        snapshot_set_diff,
        f"with a as (select distinct unnest({_TOKENS.format('text')}) as term from documents where doc_id % 2 = 0), b as (select distinct unnest({_TOKENS.format('text')}) as term from documents where doc_id % 2 = 1) select coalesce(a.term, b.term) as term, case when a.term is null then 'added' when b.term is null then 'removed' else 'unchanged' end as status from a full join b on a.term = b.term",
    ),
    "unconfirmed_additions": (
        unconfirmed_additions,
        "with h as (select count(*) // 2 as half from events), e as (select *, floor(value / 20)::int as band from events, h) select distinct user_id, event_type, band from e where event_id >= half and (user_id, event_type, band) not in (select (user_id, event_type, band) from e where event_id < half or event_id % 2 = 0)",
    ),
    "snapshot_bucket_diff": (snapshot_bucket_diff, f"with {_EVENT_SNAP}, {_DIFF} select * from d where status <> 'unchanged'"),
    "placed_matches": (placed_matches, _PLACED_SQL),
    "placed_definitions": (placed_definitions, f"with {_DEFINED} select id, name, arg_max(value, place) as value from d where value is not null group by id, name"),
    "definition_map_diff": (
        definition_map_diff,
        f"""with {_DEFINED}, l as (select source, name, id % 2 as side, arg_max(value, (id, place)) as value from d where value is not null group by all), o as (select * from l where side = 0), n as (select * from l where side = 1)
select coalesce(o.source, n.source) as source, coalesce(o.name, n.name) as name, o.value as old_value, n.value as new_value, case when o.name is null then 'added' when n.name is null then 'removed' when o.value = n.value then 'unchanged' else 'changed' end as status
from o full join n on o.source = n.source and o.name = n.name""",
    ),
    "extracted_identifiers": (extracted_identifiers, _FAMILY_SQL),
    "embedding_topk": (
        embedding_topk,
        f"""with seeds(src) as (values {", ".join(f"({s})" for s in SEEDS)}), e as (select s.src, r.vec_id as dst, round(list_dot_product(r.embedding::double[], q.embedding::double[]), 6) as relevance
from seeds s join embeddings q on q.vec_id = s.src join embeddings r on r.vec_id <> s.src) select src, dst, relevance, row_number() over (order by relevance desc, src, dst)::int as rank from e order by rank limit 10""",
    ),
}
