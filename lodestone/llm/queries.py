"""The registered queries of this package: each applies one operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import documents, fresh_path


def op7_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .jaccard_join import jaccard_components

    return jaccard_components(documents(spark, sf_dir), words=3, threshold=90)

def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .license_scan import scan

    docs = documents(spark, sf_dir)
    return scan(docs.select("doc_id", F.concat_ws("/", "source", F.col("doc_id").cast("string")).alias("path"), "text"))


def op2_byte_level_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .bpe_codec import round_trip

    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    coded = round_trip(documents(spark, sf_dir), path)
    digest = F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256)
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), digest.alias("ids_sha256"), F.sha2("bytes", 256).alias("decoded_sha256"))


def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .html_blocks import extract

    return extract(documents(spark, sf_dir, "pages").select("page_id", "url", "html")).withColumn("n_chars", F.length("text").cast("long"))


def op4_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontam import leaks

    return leaks(documents(spark, sf_dir), documents(spark, sf_dir, "benchmark"))


def op5_token_id_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .token_store import read, with_starts, write

    path = fresh_path(spark, "token-files")
    write(documents(spark, sf_dir), path, public_tokenizers.path("byte_bpe_50k.json"), end_id=0)
    return with_starts(read(spark, path, with_ids=False)).select("doc_id", "start", "n_tokens", "ids_crc32")


def op6_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ann import nearest

    return nearest(documents(spark, sf_dir, "embeddings"), every=50, k=5)


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .line_dedup import drop_repeated_lines

    kept = drop_repeated_lines(documents(spark, sf_dir).select("doc_id", "text"), bits=None)
    return kept.select("doc_id", "lines_dropped", "emptied", F.length("text").cast("long").alias("n_chars"), F.md5("text").alias("text_md5"))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .langid import identify

    return identify(documents(spark, sf_dir))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import rate_documents

    return rate_documents(documents(spark, sf_dir), documents(spark, sf_dir, "labels")).drop("segments")


def op11_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .packing import pack, pieces

    return pieces(pack(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"), end_id=1, room=4096))


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .spelling import variants, word_counts

    return variants(word_counts(documents(spark, sf_dir)))


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .fill_middle import restored, transform

    made = transform(documents(spark, sf_dir)).withColumn("restored", restored())
    digest = lambda c: F.sha2(F.col(c).cast("binary"), 256).alias(f"{c}_sha256")
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", digest("output"), digest("restored"))


def queries() -> dict:
    return {k: f for k, f in globals().items() if k.startswith("op") and callable(f)}


def _license_sql() -> str:
    from .license_scan import FILE_SHARE, TEMPLATES, THRESHOLD, _idf, strong_words

    templates = ", ".join(f"({i}, '{n}', '{t}')" for i, (n, t) in enumerate(TEMPLATES))
    token = "regexp_extract_all(lower({0}), '[a-z0-9]+', 0)"
    words = lambda ws: "[" + ", ".join(f"'{w}'" for w in ws) + "]"
    inside = f"len(list_filter(tok, lambda x: list_contains({words(_idf())}, x)))"
    return f"""with t(template, license, text) as (values {templates}),
u as (select template, license, unnest({token.format("text")}) as word from t), tf as (select template, license, word, count(*) as tf from u group by all),
idf as (select word, ln((select count(*) + 1 from t)::double / (1 + count(*))) + 1 as idf from tf group by word),
raw as (select template, license, tf.word, tf * idf as w from tf join idf on tf.word = idf.word), n as (select template, sqrt(sum(w * w)) as norm from raw group by template),
weight as (select raw.template, license, word, w / norm as weight from raw join n on raw.template = n.template),
f as (select doc_id, source || '/' || doc_id as path, text, row_number() over () as rid, source as dir from documents),
l as (select rid, length(text) as file_chars, unnest(range(len(string_split(text, chr(10))))) as line, unnest(string_split(text, chr(10))) as value from f),
k as (select rid, line, length(value) as chars, file_chars, {token.format("value")} as tok from l),
m as (select *, {inside} as inside from k where list_has_any(tok, {words(strong_words(THRESHOLD))})),
p as (select * from m where inside * inside * {1 - THRESHOLD * THRESHOLD!r}::double >= {THRESHOLD * THRESHOLD!r}::double * 0.999::double * (len(tok) - inside)),
g as (select rid, line, line - row_number() over (partition by rid order by line) as run from p),
y as (select rid, line, line as last from p union all select rid, min(line), max(line) from g group by rid, run having count(*) > 1),
w as (select y.rid, y.line, y.last, unnest(tok) as word from y join p on y.rid = p.rid and p.line between y.line and y.last), c as (select rid, line, last, word, count(*) as c from w group by all),
x as (select c.*, idf from c left join idf on c.word = idf.word),
len as (select rid, line, last, sqrt(sum(case when idf is null then c * power(ln((select count(*) + 1 from t)) + 1, 2) else c * c * idf * idf end)) as length from x group by all),
dot as (select rid, line, last, template, license, sum(c * idf * weight) as dot from x join weight on x.word = weight.word group by all),
s as (select dot.rid, dot.line, dot.last, license, round(dot / length, 6) as similarity from dot join len on dot.rid = len.rid and dot.line = len.line and dot.last = len.last where round(dot / length, 6) >= {THRESHOLD}),
b as (select rid, line, last, arg_min(license, (-similarity, license)) as license, max(similarity) as similarity from s group by all),
z as (select distinct p.rid, p.line, p.chars, p.file_chars from b join p on b.rid = p.rid and p.line between b.line and b.last), h as (select rid, sum(chars) as chars, max(file_chars) as file_chars from z group by rid),
o as (select b.rid, arg_min(b.license, (-similarity, b.line, b.last)) as license, max(similarity) as similarity, any_value(h.chars) as chars, any_value(h.file_chars) as file_chars from b join h on b.rid = h.rid group by b.rid),
q as (select dir, arg_min(struct_pack(path := path, license := license, similarity := similarity), (-similarity, path)) as g from f join o on f.rid = o.rid where chars >= {FILE_SHARE} * file_chars group by dir)
select doc_id, path, coalesce(o.license, q.g.license) as license, coalesce(o.similarity, q.g.similarity) as similarity, case when o.license is not null then 'own' when q.g.license is not null then 'inherited' else 'none' end as via,
case when o.license is not null then path else q.g.path end as from_path from f left join o on f.rid = o.rid left join q on f.dir = q.dir"""


_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_JACCARD_SQL = f"""with recursive w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_UPPER.lower()}'), '[^\\x20\\x09-\\x0D]+', 0) as w from documents),
s as (select doc_id, case when len(w) = 0 then [] when len(w) < 3 then [array_to_string(w, ' ')] else list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) end as s from w),
n as (select doc_id, len(s) as n from s), e as (select doc_id, hash(unnest(s)) as h from s),
p as (select x.doc_id as a, y.doc_id as b, count(*) as shared from e x join e y on x.h = y.h and x.doc_id < y.doc_id group by all),
k as (select a, b from p join n x on x.doc_id = a join n y on y.doc_id = b where 100 * shared >= 90 * (x.n + y.n - shared)),
both_ways as (select a, b from k union all select b, a from k),
reach as (select doc_id as a, doc_id as b from n union select r.a, k.b from reach r join both_ways k on r.b = k.a)
select n.doc_id, n as n_shingles, min(b) as component_id from n join reach on n.doc_id = reach.a group by all"""


_SPELLING_SQL = f"""with recursive crc as (select list_transform(range(256), lambda i: list_reduce(list_concat([i], range(8)), lambda c, k: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end)) as t),
r as (select coalesce(doc_id::varchar, '') as d, unnest(regexp_extract_all(translate(text, '{_UPPER}', '{_UPPER.lower()}'), '[A-Za-z\\x{{C0}}-\\x{{FF}}]+')) as run from documents),
g as (select d, run, count(*) as c, hex(encode(d || ':' || run)) as x from r where length(run) >= 6 group by d, run),
h as (select run, c, xor(4294967295, list_reduce(list_concat([4294967295], list_transform(range(length(x) // 2), lambda i: ('0x' || substr(x, 2 * i + 1, 2))::bigint)), lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1]))) as h from g, crc),
v as (select case when h % 199 = 0 then left(run, h % length(run)) || substr(run, h % length(run) + 2) else run end as word, c from h),
w as (select word, sum(c)::bigint as n from v where length(word) >= 6 group by word having sum(c) >= 5),
del as (select word, i, left(word, i) || substr(word, i + 2) as k from (select word, unnest(range(length(word))) as i from w)),
shorter as (select distinct d.word as a, w.word as b from del d join w on d.k = w.word),
near as (select x.word as a, y.word as b from del x join del y on x.k = y.k and x.i = y.i and x.word <> y.word union all select a, b from shorter union all select b, a from shorter),
best as (select a as word, count(*) as n_near, arg_min(struct_pack(f := b, n := w.n), (-w.n, b)) as best from near join w on near.b = w.word group by a),
f as (select w.word, w.n, coalesce(n_near, 0) as n_near, case when best.best.n >= 5 * w.n then best.best.f end as form, case when best.best.n >= 5 * w.n then best.best.n end as form_n from w left join best on w.word = best.word),
walk as (select word, word as at, form as up from f union all select walk.word, f.word, f.form from walk join f on walk.up = f.word)
select f.word, f.form, walk.at as root, f.n, f.n_near, f.form_n from f join walk on f.word = walk.word where walk.up is null"""
_FIM_SQL = """with t as (select doc_id, coalesce(text, '') as text, sha256('1:' || coalesce(doc_id::varchar, '')) as h from documents),
u as (select *, regexp_extract_all(text, '[A-Za-z]+|[^A-Za-z]') as u, list_transform([1, 9, 17, 25], lambda i: ('0x' || substr(h, i, 8))::bigint) as k from t),
c as (select *, len(u) as n, least(k[1] % (len(u) + 1), k[2] % (len(u) + 1)) as a, greatest(k[1] % (len(u) + 1), k[2] % (len(u) + 1)) as b,
case when text = '' or contains(text, '<P>') or contains(text, '<S>') or contains(text, '<M>') or k[3] % 100 >= 90 then 'plain' when k[4] % 100 < 20 then 'spm' else 'psm' end as form from u),
p as (select *, coalesce(array_to_string(u[1:a], ''), '') as prefix, coalesce(array_to_string(u[a + 1:b], ''), '') as middle, coalesce(array_to_string(u[b + 1:], ''), '') as suffix from c)
select doc_id, n, form, case when form <> 'plain' then length(prefix) end as prefix_chars, case when form <> 'plain' then length(middle) end as middle_chars,
sha256(case form when 'plain' then text when 'psm' then '<P>' || prefix || '<S>' || suffix || '<M>' || middle else '<S>' || suffix || '<P>' || prefix || '<M>' || middle end) as output_sha256, sha256(text) as restored_sha256 from p"""


def oracle_sql() -> dict[str, str]:
    return {"op1_license_scan": _license_sql(), "op7_ngram_jaccard_join": _JACCARD_SQL, "op12_spelling_variants": _SPELLING_SQL, "op13_fill_in_middle": _FIM_SQL}
