"""Operators on small fixtures: one change, one finding, and both directions of each check."""

import json

import pytest
from pyspark.sql import functions as F

from lodestone.functions import text as T
from lodestone.operators import diff, disclosure, graph, publish, registry, rules, search
from lodestone.sources import documents as D
from lodestone.sources.json_walk import walk
from lodestone.streaming.incremental import start_index, term_totals


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


@pytest.fixture(scope="module")
def sections(spark):
    data = [(1, 0, "Window functions", "a.md", "window functions rank rows over a frame"), (2, 1, "Constructor order", "a.md", "the constructor runs first and the frame later"), (3, 2, "Ranking", "b.md", "ranking ranks ranked rows"), (4, 3, "Café windows", "b.md", "café windows windows windows")]
    return spark.createDataFrame(data, "id long, ord int, title string, file string, text string")


def test_tokens(spark):
    df = spark.createDataFrame([("The Café-Bar x 42, and_most É",)], "t string")
    assert df.select(T.tokens(F.col("t"))).first()[0] == ["caf", "bar", "42", "most"]
    assert df.select(T.tokens(F.col("t"), [], unicode=True)).first()[0] == ["the", "café", "bar", "42", "and", "most"]


def test_keyword_counts_differ(sections):
    posting = search.postings(sections)
    assert rows(search.keyword_hits(posting, ["window", "rank"])) == [(1, 1), (3, 1), (4, 1)]
    both = sections.sparkSession.createDataFrame([("window", 1), ("windows", 1)], "keyword string, id long")
    assert rows(search.keyword_hits(both, ["window"])) == [(1, 1)] and rows(search.keyword_hits(both, ["window"], raw=True)) == [(1, 2)]
    assert search.keyword_hits(posting, []).count() == 0


def test_inherited_names_are_plain_tokens(sections):
    assert [r["id"] for r in search.Index.build(sections).semantic("constructor").collect()] == [2]


def test_expansion(spark):
    vocabulary = spark.createDataFrame([("rank",), ("ranking",), ("subrankings",), ("ra",)], "term string")
    assert {r[0] for r in search.expand(["rankin"], vocabulary, spark).collect()} == {"rankin", "ranking", "rank", "subrankings"}
    assert {r[0] for r in search.expand(["rank"], vocabulary, spark).collect()} == {"rank"}
    assert {r[0] for r in search.expand(["ran"], vocabulary, spark).collect()} == {"ran"}


def test_stop_words_only(sections):
    index = search.Index.build(sections)
    assert index.semantic("the and of").count() == 0 and index.hybrid("the and of").count() == 0
    with pytest.raises(ValueError):
        index.semantic("the", strict=True)
    with pytest.raises(ValueError):
        index.hybrid("rank", 0)


def test_hybrid(sections):
    index = search.Index.build(sections)
    got = index.hybrid("window ranking", 3).collect()
    assert len(got) == 3 and {r["layer"] for r in got} <= {"both layers", "keyword only", "tfidf only"}


def test_index_is_kept(sections, spark, tmp_path):
    index = search.Index.build(sections, f"{tmp_path}/index")
    again = search.Index.open(spark, f"{tmp_path}/index")
    assert rows(again.semantic("window rank").select("id", F.round("score", 9))) == rows(index.semantic("window rank").select("id", F.round("score", 9)))


def test_first_seed_wins(spark):
    seeds = spark.createDataFrame([(1, 0), (2, 1)], "src long, seed_pos int")
    edges = spark.createDataFrame([(1, 0, 9, 0.8, "a"), (2, 0, 9, 0.95, "b"), (1, 1, 2, 0.99, "self"), (2, 1, 8, 0.5, "weak")], "src long, pos int, dst long, relevance double, reason string")
    pick = lambda best: [(r["dst"], r["via"]) for r in graph.neighbours(seeds, edges, best=best).collect()]
    assert pick(False) == [(9, 1)] and pick(True) == [(9, 2)]
    assert graph.neighbours(seeds, edges, 0.0).count() == 2


def test_fetch_and_merge(spark):
    df = spark.createDataFrame([(1, "a\nb\nc", 2, 9), (2, "a\nb", None, None), (3, "a", 5, 6)], "id long, text string, start_line int, end_line int")
    assert rows(graph.fetch(df).select("id", "body")) == [(1, "b\nc"), (2, "a\nb"), (3, "")]
    one = spark.createDataFrame([(1, 0, "x")], "id long, ord int, v string")
    assert rows(graph.merged(one, one.withColumn("v", F.lit("y")).union(spark.createDataFrame([(2, 0, "z")], one.schema)), "id").select("id", "v")) == [(1, "x"), (2, "z")]


def test_registry(spark):
    records = spark.createDataFrame([(1, "4.1.0", "Old name"), (2, "4.0.0", None), (3, None, "new NAME")], "id long, as_of string, name string")
    baseline = spark.createDataFrame([("4.1.0",)], "baseline string")
    assert [r["id"] for r in registry.stale(records, baseline).orderBy("id").collect()] == [2, 3]
    assert [r["id"] for r in registry.stale(records.replace("4.0.0", "5.0.0"), baseline, ordered=True).collect()] == [3]
    assert [r["id"] for r in registry.lookup("name", entry=(records, ["name"])).orderBy("id").collect()] == [1, 3]
    seen = spark.createDataFrame([("x 1.2.3 y",), ("none",), ("1.0.0",)], "t string").select(T.version_in(F.col("t")).alias("version"))
    assert rows(registry.version_mismatch(seen, "1.0.0")) == [("1.2.3",)]
    days = spark.createDataFrame([("2024-01-01",), ("2024-02-20",), ("2024-03-01",)], "d string").select(F.to_date("d").alias("d"))
    assert [r["band"] for r in registry.freshness(days, "d", F.lit("2024-04-01").cast("date")).orderBy("d").collect()] == ["expired", "fresh", "fresh"]
    assert [r["band"] for r in registry.freshness(days, "d", F.lit("2024-05-01").cast("date")).orderBy("d").collect()] == ["expired", "aging", "aging"]


GOOD = [(1, "flag:a", "flag", "ok", "", "x", 5, [1, 2]), (2, "cmd:b", "command", "renamed", "c", "y", 6, [3])]
SCHEMA = "n long, id string, kind string, status string, renamed_to string, page string, lesson long, keys array<int>"
CHECKS = {
    "constant": (lambda d, p: rules.constant(d, "n", "kind", "flag"), {}, 1),
    "enum": (lambda d, p: rules.enum(d, "n", "status", ["ok", "renamed"]), {"status": "odd"}, 1),
    "enum null": (lambda d, p: rules.enum(d, "n", "status", ["ok", "renamed"]), {"status": None}, 1),
    "required": (lambda d, p: rules.required(d, "n", ["page"]), {"page": " "}, 1),
    "prefix": (lambda d, p: rules.prefix_by_kind(d, "n", "id", "kind", {"flag": "flag:", "command": "cmd:"}), {"id": "cmd:a"}, 1),
    "conditional": (lambda d, p: rules.conditional(d, "n", F.col("status") == "renamed", "renamed_to"), {"status": "renamed"}, 1),
    "unique": (lambda d, p: rules.unique(d, "n", "id", "n"), {"id": "cmd:b"}, 1),
    "foreign key": (lambda d, p: rules.foreign_key(d, "n", "lesson", p, "lesson"), {"lesson": 99}, 1),
    "nonempty": (lambda d, p: rules.nonempty(d, "n", "keys"), {"keys": []}, 1),
    "format": (lambda d, p: rules.matches(d, "n", "id", "^[a-z]+:[a-z]$"), {"id": "flag:A"}, 1),
    "sorted": (lambda d, p: rules.sorted_array(d, "n", "keys"), {"keys": [2, 1]}, 1),
    "childless": (lambda d, p: rules.childless(p, "lesson", d, "lesson"), {"lesson": 6}, 1),
    "header": (lambda d, p: rules.same_as_header(d, "n", "page", d.sparkSession.createDataFrame([("x",)], "h string"), "h"), {}, 1),
}


@pytest.mark.parametrize("name", sorted(CHECKS))
def test_rules_by_mutation(spark, name):
    check, change, bad = CHECKS[name]
    parents = spark.createDataFrame([(5,), (6,)], "lesson long")
    fields = [f.split()[0] for f in SCHEMA.split(", ")]
    good = spark.createDataFrame(GOOD, SCHEMA)
    if change:
        assert check(good, parents).count() == 0
        first = dict(zip(fields, GOOD[0])) | change
        good = spark.createDataFrame([tuple(first[f] for f in fields), GOOD[1]], SCHEMA)
    assert check(good, parents).count() == bad


def test_rule_families(spark):
    d = spark.createDataFrame([("see above",), ("above 100",)], "t string").withColumn("n", F.monotonically_increasing_id())
    found = rules.run([rules.Rule("R", lambda t: rules.lacks(t["d"], "n", "t", T.LEFT + "above(?! [0-9])"), "flag", ("d",)), rules.Rule("absent", lambda t: t["x"], needs=("x",))], {"d": d})
    assert rules.gate(found) == (0, 1)
    with pytest.raises(ValueError):
        rules.run([rules.Rule("absent", lambda t: t["x"], needs=("x",))], {})
    one, two = spark.createDataFrame([("1", None)], "a string, b string"), spark.createDataFrame([("2", "3")], "a string, b string")
    assert rules.headers_equal(one, two, ["a", "b"]).count() == 1 and rules.headers_equal(one, two, ["a", "b"], skip_missing=False).count() == 2


LEAKS = [("id 123456789 here", "digit-run"), ("call someInternalFieldName now", "camel-case"), ("the some_internal_name", "snake-case"), ("mail a.b@c.org", "e-mail"), ("at 10.20.30.40", "ipv4"), ("f" * 32, "hex-key"), ("my password = x", "never")]
CLEAN = ["plain words 1234567", "camelCase only", "snake_case", "version 1.2.3", "é12345678é is not bounded by letters? yes12345678", "127.0.0.1"]


@pytest.mark.parametrize("text, rule", LEAKS)
def test_leaks_are_found(spark, text, rule):
    assert {r["rule"] for r in disclosure.scan(spark.createDataFrame([(1, text)], "id long, text string")).collect()} == {rule}


def test_clean_prose_passes(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(CLEAN) if i != 4], "id long, text string")
    assert disclosure.scan(df).count() == 0
    # an ASCII boundary: an accented letter ends a run, as it does in other engines
    assert disclosure.scan(spark.createDataFrame([(1, "é12345678é")], "id long, text string")).count() == 1


def test_never_list_has_no_exemption(spark):
    df = spark.createDataFrame([(1, "secret_internal_thing password = 1")], "id long, text string")
    assert {r["rule"] for r in disclosure.scan(df, allow=["secret_internal_thing", "password ="]).collect()} == {"never"}


def test_quotes_flag(spark):
    long = '"' + "word " * 16 + '"'
    df = spark.createDataFrame([(1, long), (2, '"a b" “c d”'), (3, "none"), (4, long * 3)], "id long, text string")
    assert rows(disclosure.quotes(df)) == [(1, 1, 16, 1, False), (2, 2, 4, 0, False), (3, 0, 0, 0, False), (4, 3, 48, 3, True)]


def test_scope(spark):
    files = [(1, "html", "<script>var a_b_c = 1</script><p title='x_y_z'>fine</p>"), (2, "json", json.dumps({"a": {"b": ["some_inner_name", 123456789]}})), (3, "json", '{"broken: some_inner_name'), (4, "txt", "some_inner_name")]
    found = disclosure.scan(disclosure.scope(spark.createDataFrame(files, "id long, ext string, content string")))
    assert rows(found.select("id", "rule")) == [(2, "snake-case"), (3, "snake-case"), (4, "snake-case")]


def test_diff(spark):
    old, new = spark.createDataFrame([("a", 1), ("b", 2), ("n", None)], "k string, v int"), spark.createDataFrame([("b", 3), ("c", 4), ("n", None)], "k string, v int")
    assert rows(diff.map_diff(old, new, ["k"], "v").select("k", "status")) == [("a", "removed"), ("b", "changed"), ("c", "added"), ("n", "unchanged")]
    twice = spark.createDataFrame([("a", 1, 0), ("a", 2, 1)], "k string, v int, o int")
    assert rows(diff.last_wins(twice, ["k"], "v", "o")) == [("a", 2)]


def test_links(spark):
    pages = spark.createDataFrame(
        [("index.html", '<a href="/docs/">d</a><a href="https://x.org">x</a><a href="mailto:a@b">m</a><a href="/gone">g</a>'), ("docs/index.html", '<i id="a"></i><a href="../index.html">u</a><a href="#a">ok</a><a href="#b">no</a><a href="page#z">p</a>'), ("docs/page/index.html", '<i id="q"></i>')],
        "page string, html string",
    )
    assert rows(publish.broken_links(pages)) == [("docs/index.html", "#b", "no fragment"), ("docs/index.html", "page#z", "no fragment"), ("index.html", "/gone", "no target")]


def test_facets(spark):
    df = spark.createDataFrame([("a", "x"), ("a", "y"), ("b", "x"), (None, "x")], "f string, g string")
    assert publish.facet_counts(df, {"f": ["a"], "g": ["x", "y"]}).first() == (2, 4)
    assert publish.facet_counts(df, {"f": [], "g": []}).first() == (4, 4)


def test_sources(spark, tmp_path):
    (tmp_path / "README.md").write_text("no")
    (tmp_path / "a.md").write_text("---\ndomain: a\nsources: [1, 2]\ndomain: b\n---\nbody\nlast")
    (tmp_path / "b.md").write_text("no block\n---\nx: 1\n---\n")
    files = D.whole_files(spark, str(tmp_path))
    got = {r["file"]: r["f"] for r in files.select("file", D.front_matter(F.col("content")).alias("f")).collect()}
    assert got == {"a.md": {"domain": "b", "sources": "[1, 2]"}, "b.md": None}
    assert files.where("file = 'a.md'").select(D.front_list(D.front_matter(F.col("content"))["sources"])).first()[0] == [1, 2]
    assert D.numbered_lines(files.where("file = 'a.md'")).where("line_no = 7").first()["text"] == "last"
    (tmp_path / "x.json").write_text('{"a": 1}')
    (tmp_path / "bad.json").write_text("{")
    assert D.strict_json(spark, str(tmp_path / "x.json"), "a int").first()["a"] == 1
    with pytest.raises(Exception):
        D.strict_json(spark, str(tmp_path / "bad.json"), "a int").collect()
    assert D.tolerant_json(spark, str(tmp_path / "bad.json"), "a array<int>", {"a": F.array().cast("array<int>")}).first()["a"] == []
    both = spark.createDataFrame([('{"references": {"1": [2]}}',), ('{"1": [2]}',)], "j string").select(D.unwrapped(F.col("j"), "references", "map<string, array<bigint>>").alias("m"))
    assert [r["m"] for r in both.collect()] == [{"1": [2]}, {"1": [2]}]
    (tmp_path / "raw.bin").write_bytes(b"ok \xff end")
    assert D.lossy_files(spark, str(tmp_path / "raw.bin")).first()["content"] == "ok � end"
    deep = spark.createDataFrame([(1, '{"a": {"b": ["x", {"c": "y"}], "n": 1}}'), (2, "broken{")], "id long, j string")
    assert rows(walk(deep, "id", "j")) == [(1, "$.a.b[0]", "x"), (1, "$.a.b[1].c", "y")]
    D.write_index_document(deep, str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).count() == 2
    assert D.version_stamp(spark, '{"v": "1.2", "n": 3, "x": null}').first() == ("1.2", "3", None)


def test_text_helpers(spark):
    df = spark.createDataFrame([("One. Two", "a<b>&\"", "2024-02-30", "12a")], "s string, h string, d string, n string")
    r = df.select(T.first_sentence(F.col("s")).alias("f"), T.html_escape(F.col("h")).alias("h"), T.iso_date(F.col("d")).alias("d"), T.integer(F.col("n")).alias("n"), T.word_count(F.lit("  a b ")).alias("w"), T.slug(F.lit("A b! C")).alias("s")).first()
    assert tuple(r) == ("One.", "a&lt;b&gt;&amp;&quot;", None, None, 2, "a-b-c")


def test_incremental_index(spark, tmp_path):
    """Document frequencies kept up by a stream equal those of one pass, and a batch that runs again counts once."""
    source, store = str(tmp_path / "in"), str(tmp_path / "store")
    docs = spark.createDataFrame([(1, "alpha beta beta"), (2, "beta gamma")], "id long, text string")
    docs.write.parquet(source)
    for more in (None, [(3, "gamma delta")]):
        if more:
            spark.createDataFrame(more, docs.schema).write.mode("append").parquet(source)
        stream = spark.readStream.schema(docs.schema).parquet(source)
        start_index(stream, store, str(tmp_path / "check")).awaitTermination()
    assert rows(term_totals(spark, store)) == [("alpha", 1), ("beta", 2), ("delta", 1), ("gamma", 2)]
