"""The kept index against plain scoring of all sections, and the gram index against looking at all words."""

import io
import random
from contextlib import redirect_stdout

import pytest
from pyspark.sql import functions as F

from lodestone.operators import grams, postings, search
from lodestone.sources import kept

WORDS = ["window", "windows", "frame", "framework", "rank", "ranking", "subrankings", "constructor", "order", "orders", "café", "zeta", "alphabet", "beta42", "the", "ab", "a1"]


def _sections(spark, rng, n, first=0):
    rows = [(first + i, i, " ".join(rng.choices(WORDS, k=3)), rng.choice([None, "", " ".join(rng.choices(WORDS, weights=range(1, len(WORDS) + 1), k=rng.randint(1, 30)))])) for i in range(n)]
    return spark.createDataFrame(rows, "id long, ord int, title string, text string")


def _plain(sections, query):
    counts = search.term_counts(sections)
    idf = search.idf_table(counts, sections.count())
    weight = search.weights(counts, idf)
    words = search.query_tokens(query)
    scores = search.cosine(weight, search.norms(weight), search.query_vector(search.expand(words, idf, sections.sparkSession), idf))
    return {r["id"]: round(r["score"], 9) for r in scores.collect()}


QUERIES = ["window rank", "rankin framewo", "constructors", "zeta unknownword", "beta42 alphabets", "orderly ranks"]


@pytest.fixture(scope="module")
def made(spark):
    before, postings.BUCKET_BITS = postings.BUCKET_BITS, 2
    sections = _sections(spark, random.Random(1), 120).repartition(3).cache()
    index = search.Index.build(sections)
    postings.BUCKET_BITS = before
    return sections, index


def _scores(rows):
    return {r["id"]: round(r["score"], 9) for r in rows.collect()}


@pytest.mark.parametrize("most", [1000, 1])
def test_same_rows_as_full_scoring(made, monkeypatch, most):
    monkeypatch.setattr(kept, "MOST_LITERALS", most)
    sections, index = made
    for query in QUERIES[1:3] if most > 1 else QUERIES[2:3]:
        assert _scores(index.semantic(query)) == _plain(sections, query)


@pytest.mark.parametrize("first", [1, 8])
def test_best(made, monkeypatch, first):
    monkeypatch.setattr(postings, "FIRST", first)
    sections, index = made
    for query in QUERIES[1:2]:
        plain = sorted(_plain(sections, query).items(), key=lambda p: (-p[1], p[0]))
        for k in (2, 500):
            got = [(r["id"], round(r["score"], 9)) for r in index.best(query, k).orderBy("rank").collect()]
            assert got == plain[:k]


def test_blocks_that_cannot_reach_the_best_stay_closed(made, spark):
    _, index = made
    vectors = kept.settled(index.postings.vectors(search.asked(spark, {"q": ["alphabet", "window"]}), search.UNKNOWN_IDF))
    hits = index.postings.hits(vectors)
    bounds = kept.settled(index.postings.bounds(hits))
    scores = index.postings.scores(hits, bounds)
    worst = scores.join(index.postings.blocks.select("bucket", F.explode("ids").alias("id")).distinct(), "id").groupBy("bucket").agg(F.max("score").alias("most"))
    assert bounds.join(worst, "bucket").where("most > bound + 1e-9").count() == 0
    first = postings._ranked(bounds, 2, F.desc("bound"), F.asc("bucket")).select("query", "bucket")
    more = index.postings.open_after(bounds, first, index.postings.scores(hits, first), 1)
    assert more.count() + 2 < bounds.count()


def _explained(rows):
    out = io.StringIO()
    with redirect_stdout(out):
        rows.explain("formatted")
    return out.getvalue()


def test_plans(made, spark):
    _, index = made
    plan = _explained(index.semantic("window rank"))
    assert "In(term, [" in plan.split("PushedFilters", 1)[1] and "Python" not in plan and "Arrow" not in plan
    expanded = index.postings.expanded(search.asked(spark, {"q": ["rankin", "framewo"], "r": ["constructors"]}))
    for p in (plan, _explained(expanded), _explained(index.keyword("window")), _explained(index.hybrid("window rank"))):
        assert "NestedLoop" not in p and "Cartesian" not in p


def test_segments_equal_a_rebuild(spark, tmp_path):
    rng = random.Random(5)
    one, two = _sections(spark, rng, 60).repartition(2), _sections(spark, rng, 40, 1000)
    grown = search.Index.build(one, f"{tmp_path}/grown")
    old = _scores(grown.semantic("window rank"))
    kept.mark(spark, f"{tmp_path}/grown/state-000007/half-written")  # no state without its mark counts
    grown = grown.added(two)
    whole = search.Index.build(one.unionByName(two), f"{tmp_path}/whole")
    for name, by in (("idf", "term"), ("norm", "id")):
        mine, theirs = ([tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in getattr(i, name).orderBy(by).collect()] for i in (grown, whole))
        assert mine == theirs
    for query in QUERIES[1:2]:
        assert _scores(grown.semantic(query)) == _scores(whole.semantic(query))
        assert sorted(map(tuple, grown.keyword(query).collect())) == sorted(map(tuple, whole.keyword(query).collect()))
    again = search.Index.open(spark, f"{tmp_path}/grown")
    assert _scores(again.semantic("window rank")) == _scores(grown.semantic("window rank")) != old
    with pytest.raises(FileNotFoundError):
        search.Index.open(spark, f"{tmp_path}/nothing")


def test_empty_and_wordless(spark, made):
    empty = search.Index.build(spark.createDataFrame([], "id long, ord int, title string, text string"))
    assert empty.semantic("window").count() == 0 and empty.best("window").count() == 0 and empty.keyword("window").count() == 0
    _, index = made
    assert index.semantic("zzzz").count() == 0 and index.semantic("the and of").count() == 0


def test_stop_lists_of_queries(made):
    """A query may leave out words that the index knows."""
    _, index = made
    assert index.semantic("window", stop=["window"]).count() == 0 and index.semantic("window", stop=[]).count() > 0


def test_top_of():
    assert [search.top_of(v) for v in ("5", "0", "x", None, " 7b", "")] == [5, 3, 3, 3, 7, 3]


def _expanded(words, vocabulary):
    out = set(words)
    for w in words:
        if w in vocabulary or len(w) < 4:
            continue
        out |= {v for v in vocabulary if v.startswith(w) and len(w) >= 0.6 * len(v) or w.startswith(v) and len(v) >= 4 or w in v and len(w) >= 5}
    return out


def test_expansion_of_many_queries(spark):
    rng = random.Random(3)
    vocabulary = sorted({"".join(rng.choices("abc", k=rng.randint(2, 9))) for _ in range(300)})
    sections = spark.createDataFrame([(i, i, w, w) for i, w in enumerate(vocabulary)], "id long, ord int, title string, text string")
    index = search.Index.build(sections, stop=[]).postings
    queries = {f"q{i}": ["".join(rng.choices("abc", k=rng.randint(2, 8))) for _ in range(5)] for i in range(40)}
    got = {}
    for r in index.expanded(search.asked(spark, queries)).collect():
        got.setdefault(r["query"], set()).add(r["term"])
    assert got == {q: _expanded(words, set(vocabulary)) for q, words in queries.items()}


@pytest.mark.parametrize("most", [1000, 2])
def test_grams(spark, tmp_path, monkeypatch, most):
    monkeypatch.setattr(kept, "MOST_LITERALS", most)
    rng = random.Random(2)
    words = sorted({"".join(rng.choices("abcdé", k=rng.randint(1, 8))) for _ in range(400)} | {"aaaa"})
    grams.GramIndex.write(spark.createDataFrame([(w,) for w in words], "word string"), str(tmp_path))
    tokens = ["".join(rng.choices("abcdé", k=rng.randint(1, 5))) for _ in range(60)] + ["aaa", "zzz", "", "a", "é", "abz"]
    found = grams.GramIndex.open(spark, str(tmp_path)).containing(spark.createDataFrame([(t,) for t in tokens], "token string"))
    assert sorted(map(tuple, found.collect())) == sorted({(t, w) for t in tokens if t for w in words if t in w})


def test_kept_once(spark, tmp_path):
    made, source = [], f"{tmp_path}/source"
    spark.range(3).write.parquet(source)

    def build(path):
        made.append(path)
        spark.range(2).write.parquet(path)

    one = kept.kept(spark, "test-kept", spark.read.parquet(source), build)
    assert kept.kept(spark, "test-kept", spark.read.parquet(source), build) == one and len(made) == 1
    spark.range(3).write.mode("append").parquet(source)
    assert kept.kept(spark, "test-kept", spark.read.parquet(source), build) != one and len(made) == 2

    def broken(path):
        spark.range(2).write.parquet(path)
        raise RuntimeError

    spark.range(1).write.mode("append").parquet(source)
    with pytest.raises(RuntimeError):
        kept.kept(spark, "test-kept", spark.read.parquet(source), broken)
    assert kept.kept(spark, "test-kept", spark.read.parquet(source), build) and len(made) == 3
