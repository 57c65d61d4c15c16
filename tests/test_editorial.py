"""Readers, writers and rules of the editorial side on small fixtures."""

import pathlib

from pyspark.sql import functions as F

from lodestone.functions import text as T
from lodestone.operators import disclosure, graph, publish, rules, search
from lodestone.sources import documents as D


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_files_of_several_endings(spark, tmp_path):
    for name, text in (("a.md", "one"), ("sub/b.txt", "two"), ("sub/deep/c.json", "{}"), ("sub/d.png", "no"), ("sub/README.md", "no")):
        p = tmp_path / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(text)
    found = D.files_below(spark, str(tmp_path), ["md", "txt", "json"], without="README.md")
    assert sorted((r["path"].rsplit("/", 1)[1], r["content"]) for r in found.collect()) == [("a.md", "one"), ("b.txt", "two"), ("c.json", "{}")]


def test_artefacts_and_static_files(spark, tmp_path):
    target = f"{tmp_path}/out"
    pages = spark.createDataFrame([("a/index.html", "<p>é</p>"), ("a/index.md", "é"), ("b.xml", None)], "rel string, content string")
    D.write_artefacts(pages, target)
    D.write_artefacts(pages.where("rel <> 'b.xml'"), target)  # what was there before goes
    assert sorted(str(p.relative_to(target)) for p in pathlib.Path(target).rglob("*") if p.is_file()) == ["a/index.html", "a/index.md"]
    assert (pathlib.Path(target) / "a/index.html").read_text(encoding="utf-8") == "<p>é</p>"
    (tmp_path / "static").mkdir()
    (tmp_path / "static/x.bin").write_bytes(b"\x00\xff")
    assert D.copy_static(spark, f"file://{tmp_path}/static", f"file://{tmp_path}/site") == 1
    assert (tmp_path / "site/x.bin").read_bytes() == b"\x00\xff"


def test_whole_sitemap(spark):
    pages = spark.createDataFrame([(1, "http://a/?x&y"), (2, "http://b/")], "ord long, url string")
    lines = [r["line"] for r in publish.sitemap_document(pages, F.lit("2024-05-01").cast("date")).orderBy("ord").collect()]
    import xml.etree.ElementTree as X

    found = X.fromstring("\n".join(lines))
    assert [e.text for e in found.iter("{http://www.sitemaps.org/schemas/sitemap/0.9}loc")] == ["http://a/?x&y", "http://b/"]


def test_payload_field(spark):
    data = [('{"tool": "edit", "n": 1}',), ('{"tool": "edit", "n": ',), ("none",), (None,), ('{"other": 1}',)]
    df = spark.createDataFrame(data, "p string")
    assert [r[0] for r in df.select(D.payload_field(F.col("p"), "tool")).collect()] == ["edit", "edit", None, None, None]


def test_identifier_rules(spark):
    rules_ = [disclosure.prefixed(["acme_"]), disclosure.namespaced(), disclosure.called(["runTask"]), disclosure.worded(["Falcon"])]
    texts = spark.createDataFrame([(1, "acme_flag_x and ns__tool, runTask(1) runTasks(2) FALCON falcons"), (2, "acme nsx_tool runTask"), (3, "acme_ok")], "id long, text string")
    assert rows(disclosure.scan(texts, rules_, [], ["acme_ok"])) == [(1, "called", "runTask"), (1, "namespaced", "ns__tool"), (1, "prefixed", "acme_flag_x"), (1, "worded", "FALCON")]


def test_json_is_parsed(spark):
    deep = '{"a":' * 7 + '"some_inner_name"' + "}" * 7
    files = [(1, "json", '{"k": "some\\u005finner\\u005fname"}'), (2, "json", '{"k": "' + "x" * 1_000_000 + ' some_inner_name"}'), (3, "json", '{"some_inner_name": 1}'), (4, "json", "broken some_inner_name"), (5, None, "some_inner_name"), (6, "json", deep), (7, "json", None)]
    found = disclosure.scan(disclosure.scope(spark.createDataFrame(files, "id long, ext string, content string")))
    assert sorted(r["id"] for r in found.where("rule = 'snake-case'").collect()) == [1, 2, 4, 5, 6]


def test_types_and_derived_rows(spark):
    data = [(1, '"x"'), (2, "1"), (3, "2.5"), (4, "true"), (5, "[]"), (6, "{}"), (7, "oops"), (8, None), (9, "null")]
    df = spark.createDataFrame(data, "id long, v string")
    good = {"string": [1], "number": [2, 3], "boolean": [4], "array": [5], "object": [6]}
    for kind, ids in good.items():
        bad = {int(r["entity"]) for r in rules.typed(df, "id", "v", kind).collect()}
        assert bad == set(range(1, 10)) - set(ids), kind
    facts = spark.createDataFrame([(1, "p", "durable"), (2, "p", "volatile"), (3, "q", "durable")], "fact_id long, page string, durability string")
    derived = spark.createDataFrame([("a", 1, "p"), ("b", 2, "p"), ("c", 3, "p"), ("d", 9, "p"), ("e", None, "p")], "row string, fact_id long, page_ string")
    assert rows(rules.derived(derived, "row", "fact_id", "page_", facts)) == [("b", "fact_id", "not durable"), ("c", "fact_id", "other page"), ("d", "fact_id", "no fact"), ("e", "fact_id", "no fact")]


def test_gates_and_messages(spark):
    f = spark.createDataFrame([("r", "fail", "1", "x", None), ("r", "flag", "2", "x", "y")], "rule_id string, severity string, entity string, field string, hit string")
    assert rows(rules.gates([("one", f), ("two", f.where("severity = 'flag'")), ("three", f.where("false"))])) == [("one", 1, 1, 1), ("three", 0, 0, 0), ("two", 0, 1, 0)]
    assert [r[0] for r in rules.messages(f, 1).collect()] == ["r 1: x (missing)"]


def test_symptoms_of_any_length(spark):
    texts = spark.createDataFrame([(1, "Say: The Quick  brown fox, xOOMs"), (2, "quick brown"), (3, None), (4, "thequick brown foxes")], "id long, text string")
    patterns = spark.createDataFrame([("a", ["the quick  brown fox", "oom", "Quick brown"]), ("b", ["hequick brown fo", "the quick brown"]), ("c", [" "]), ("d", [])], "symptom string, pattern array<string>")
    got = {(r["id"], r["symptom"]): r["matched"] for r in graph.symptoms(texts, patterns).collect()}
    assert got == {(1, "a"): ["the quick  brown fox", "oom"], (2, "a"): ["Quick brown"], (4, "a"): ["Quick brown"], (4, "b"): ["hequick brown fo"], (1, "c"): [" "], (2, "c"): [" "], (4, "c"): [" "]}


def test_ranks_by_parts_are_the_ranks(spark, monkeypatch):
    monkeypatch.setattr(search, "RANK_IDS", 3)
    monkeypatch.setattr(search, "RANK_STEPS", 4)
    data = [(i, (i * 7) % 4, ((i * 13) % 11) / 11) for i in range(40)]
    df = spark.createDataFrame(data, "id long, hits long, score double")
    got = {r["id"]: r["rank"] for r in search.ranked_by_count(df, "hits").collect()}
    assert got == {i: n + 1 for n, (i, *_) in enumerate(sorted(data, key=lambda r: (-r[1], r[0])))}
    got = {r["id"]: r["rank"] for r in search.ranked_by_score(df, "score", "id").collect()}
    assert got == {i: n + 1 for n, (i, *_) in enumerate(sorted(data, key=lambda r: (-r[2], r[0])))}


def test_composed_text_and_row_functions(spark):
    s = spark.createDataFrame([(1, 0, "Title", "desc"), (2, 1, "Other", None)], "id long, ord int, title string, description string")
    out = search.composed(s, spark.createDataFrame([(1, "kw"), (1, "aa")], "id long, keyword string"), spark.createDataFrame([(2, "topic")], "id long, topic string"))
    assert {r["id"]: r["text"] for r in out.collect()} == {1: "Title aa kw desc", 2: "Other topic"}
    df = spark.createDataFrame([("x [a, b ,] y",), ("none",)], "t string")
    assert [r[0] for r in df.select(T.bracketed(F.col("t"))).collect()] == [["a", "b"], []]
