"""Many rules in one pass: equal to the rules one by one, one scan, observed totals, a gate that stops a publish."""

import io
from contextlib import redirect_stdout

import pytest
from pyspark.sql import functions as F

from lodestone.operators import conditions as c
from lodestone.operators import fused, rules
from lodestone.operators.fused import RowRule
from lodestone.plans import gates

SF = "/root/testdata/sf0.001"


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def _explained(df):
    out = io.StringIO()
    with redirect_stdout(out):
        df.explain("formatted")
    return out.getvalue()


@pytest.fixture(scope="module")
def data(spark):
    rows_ = [(1, "a1", "x", 5, ["a", "b"]), (2, "b1", None, 7, ["b", "a"]), (3, None, "y", None, []), (4, "a2", " ", 7, None), (5, "c", "x", 99, ["z"])]
    return spark.createDataFrame(rows_, "n long, name string, kind string, parent long, keys array<string>")


def test_equal_to_the_rules_one_by_one(data):
    own = [
        RowRule("enum", "kind", c.not_among("kind", ["x", "y"])),
        RowRule("const", "kind", c.not_constant("kind", "x")),
        RowRule("format", "name", c.not_like("name", "^a[0-9]$")),
        RowRule("sorted", "keys", c.unsorted("keys"), F.array_join("keys", ",")),
        RowRule("any", "keys", c.empty("keys"), F.lit(None)),
        RowRule("when", "kind", c.missing_when(F.col("n") > 1, "kind")),
        RowRule("then", "name", c.broken(F.col("n") > 1, F.col("parent") > 6)),
        RowRule("place", "kind", c.elsewhere(F.col("n") < 4, "kind", "x")),
        RowRule("banned", "name", c.like("name", "1"), F.regexp_extract("name", "[0-9]", 0), "flag"),
    ]
    plain = [
        ("enum", rules.enum(data, "n", "kind", ["x", "y"])),
        ("const", rules.constant(data, "n", "kind", "x")),
        ("format", rules.matches(data, "n", "name", "^a[0-9]$")),
        ("sorted", rules.sorted_array(data, "n", "keys")),
        ("any", rules.nonempty(data, "n", "keys")),
        ("when", rules.conditional(data, "n", F.col("n") > 1, "kind")),
        ("then", rules.consistent(data, "n", "name", F.col("n") > 1, F.col("parent") > 6)),
        ("place", rules.only_on(data, "n", F.col("n") < 4, "kind", "x")),
        ("banned", rules.lacks(data, "n", "name", "1").withColumn("hit", F.lit("1"))),
    ]
    mine = fused.findings(data, "n", own).select("rule_id", "entity", "field", "hit")
    assert rows(mine) == sorted(((n, *r) for n, f in plain for r in map(tuple, f.select("entity", "field", "hit").collect())), key=str)


def test_one_scan_for_thirty_rules(spark):
    assert len(gates.ORDER_RULES) == 30
    found = gates.order_findings(spark, SF)
    plan = _explained(found).split("\n\n\n", 1)[0]
    scans = [x for x in _explained(found).split("Location") if "orders.parquet" in x]
    assert plan.count("Generate") == 1 and len(scans) == 2  # the orders, and once more their keys for the customers' first orders
    simple = fused.findings(spark.read.parquet(f"{SF}/orders.parquet"), "o_orderkey", [RowRule(f"r{i}", "o_totalprice", F.col("o_totalprice") < i) for i in range(30)])
    plan = _explained(simple).split("\n\n\n", 1)[0]
    assert plan.count("Scan parquet") == 1 and "Union" not in plan and "Exchange" not in plan


def test_parents_and_first(data, spark):
    parents = spark.createDataFrame([(5, "p"), (7, "q"), (7, "a"), (None, "n")], "id long, label string")
    both = fused.with_first(fused.with_parent(data, "parent", parents, "id", "up", "label"), "parent", "n", "first")
    found = fused.findings(both, "n", [RowRule("known", "parent", F.col("parent").isNotNull() & F.col("up").isNull()), RowRule("label", "parent", F.coalesce(F.col("up.label") != "p", F.lit(False)), F.col("up.label")), RowRule("again", "parent", F.coalesce(F.col("n") > F.col("first"), F.lit(False)))])
    assert rows(found.select("rule_id", "entity", "hit")) == [("again", "4", "7"), ("known", "5", "99"), ("label", "2", "a"), ("label", "4", "a")]


def test_gate_stops_a_publish(data, spark, tmp_path):
    done = []
    bad = lambda severity: lambda: fused.findings(data, "n", [RowRule("enum", "kind", c.not_among("kind", ["x"]), gate="one", severity=severity)])
    assert fused.published(lambda: done.append(1), bad("flag"), f"{tmp_path}/flags", ["one", "two"]) == 0 and done == [1]
    with pytest.raises(fused.GateFailed) as stopped:
        fused.published(lambda: done.append(2), bad("fail"), f"{tmp_path}/fails", ["one", "two"])
    assert stopped.value.exit_code == 1 and "one: 3" in str(stopped.value) and done == [1]
    assert spark.read.parquet(f"{tmp_path}/fails").count() == 3  # the finding table stays
    with pytest.raises(fused.GateFailed) as stopped:
        fused.published(lambda: done.append(3), lambda: fused.findings(data.select("no_such"), "n", []), f"{tmp_path}/none", ["one"])
    assert stopped.value.exit_code == 2 and done == [1]
    assert fused.written(bad("flag")(), f"{tmp_path}/counts", ["one", "two"]) == {"one": (0, 3), "two": (0, 0)}


def test_observations(spark):
    schema = "id long, ns string, o struct<present boolean, source string, on boolean, at string, served_keys array<string>>"
    good = (True, "web", True, "s1", ["a", "b"])
    cases = [
        (1, "must", good, []),
        (2, "must", None, ["observation required"]),
        (3, "mustnot", good, ["observation forbidden"]),
        (4, "mustnot", None, []),
        (5, "other", None, ["unknown namespace"]),
        (6, None, good, ["unknown namespace"]),
        (7, "must", (None, None, None, "s1", None), ["present must be boolean"]),
        (8, "must", (False, None, None, "s1", None), []),
        (9, "must", (False, "web", None, "s1", None), ["absent with source or on"]),
        (10, "must", (True, "mail", True, "s1", None), ["unknown source"]),
        (11, "must", (True, None, None, "s1", None), ["present without on"]),
        (12, "must", (True, None, True, "", None), ["at missing"]),
        (13, "must", (True, None, True, "s2", None), ["at is not the stamp"]),
        (14, "must", (False, None, None, "s1", ["a"]), ["served keys of what is absent"]),
        (15, "must", (True, None, True, "s1", ["b", "a"]), ["served keys not sorted"]),
        (16, "must", (True, None, True, "s1", ["a", None]), ["served keys must be strings"]),
    ]
    df = spark.createDataFrame([x[:3] for x in cases], schema)
    hits = c.observations("o", "ns", {"must": True, "mustnot": False}, ["web", "app"], F.lit("s1"))
    got = {}
    for r in fused.findings(df, "id", [RowRule("V12", "o", hits=hits)]).collect():
        got.setdefault(int(r["entity"]), []).append(r["hit"])
    assert got == {i: m for i, _, _, m in cases if m}


def test_orders_and_documents(spark):
    """Ranks of neighbours and sections, large groups in several rows, results as one document."""
    from lodestone.operators import graph, search

    seeds = spark.createDataFrame([(1, 0), (2, 1)], "src long, seed_pos int")
    edges = spark.createDataFrame([(1, 0, 9, 0.8, "a"), (1, 1, 8, 0.9, "b"), (2, 0, 7, 0.9, "c"), (2, 1, 6, 0.8, "d")], "src long, pos int, dst long, relevance double, reason string")
    assert [r["dst"] for r in graph.in_order(graph.neighbours(seeds, edges)).orderBy("rank").collect()] == [8, 7, 9, 6]
    sections = spark.createDataFrame([(f, i, 10 * i, f"t{i}") for i in range(25) for f in ("a", "b") if f == "a" or i < 3], "file string, ord long, id long, title string")
    pages = {(r["file"], r["page"]): [x["id"] for x in r["items"]] for r in graph.nested(sections.withColumn("sid", F.col("id")).drop("id").withColumnRenamed("sid", "id"), "file", "id", "title", most=10).collect()}
    assert pages == {("a", 0): list(range(0, 100, 10)), ("a", 1): list(range(100, 200, 10)), ("a", 2): list(range(200, 250, 10)), ("b", 0): [0, 10, 20]}
    assert [r["rank"] for r in graph.by_id(sections.where("file = 'b'")).orderBy("id").collect()] == [1, 2, 3]
    rows_ = spark.createDataFrame([(1, 0.123456, None), (2, 0.5, "é\"")], "id long, score double, note string")
    made = search.rendered(rows_, ["id", "score", "note"], [F.desc("score")], 5, {"score": 4}).first()[0]
    assert made == '[{"id":2,"score":0.5,"note":"é\\""},{"id":1,"score":0.1235,"note":null}]'
    assert search.rendered(rows_.limit(0), ["id"], [F.desc("score")], 5).first()[0] == "[]"
    site = spark.createDataFrame([("one", "a/b/index.html", '<a href="../c.html">x</a><a href="/d/../e.html">y</a>'), ("two", "a/c.html", ""), ("one", "e.html", '<a href="a/b/">z</a>')], "host string, page string, html string")
    from lodestone.operators import publish

    assert rows(publish.broken_links(site)) == [("one", "a/b/index.html", "../c.html", "no target")]  # the other host's page of that path is no target


def test_anchors_cut_out(spark):
    files = spark.createDataFrame([("a", "One\ntwo\n\nFour"), ("b", ""), ("c", None)], "file string, content string")
    anchors = spark.createDataFrame([("a", i) for i in range(-1, 7)] + [("b", 1), ("c", 1), ("d", 1)], "file string, start_line int")
    from lodestone.sources.documents import numbered_lines

    plain = rules.anchored(anchors, "file", numbered_lines(files.where("content is not null")), "^[A-Z]")
    assert rows(rules.anchored_in(anchors, "file", files, "^[A-Z]")) == rows(plain) == [("a", "start_line", ""), ("a", "start_line", "two"), ("b", "start_line", "")]


def test_command_lines_and_padding(spark):
    from lodestone.functions import text as T

    lines = ["echo x > .conf/a", "cat .conf/a >> y", "cp a .conf/", "ls .conf/", "python edit.py .conf/a", "cp a b\nls .conf/", "tee .conf/x", "cat .conf/x", "a >b\n.conf/"]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "i int, c string")
    assert [r["i"] for r in df.where(T.writes_below(F.col("c"), ".conf/")).orderBy("i").collect()] == [0, 1, 2, 4, 6]
    assert tuple(df.limit(1).select(T.pad_end(F.lit("é"), 3), T.pad_end(F.lit("long"), 3), T.pad_start(F.lit("7"), 2)).first()) == ("é  ", "long", " 7")
