"""Language ID, toxicity, HTML extraction and nearest neighbours: held-out accuracy, recall and edges."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.llm import ann, html_blocks, langid, toxicity
from lodestone.llm._shared import prepare

SF = "/root/testdata/sf0.01"


def test_language_held_out(spark):
    prepare(spark)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = langid.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert len(rows) > 100 and np.mean([r["lang_pred"] == r["lang"] for r in rows]) > 0.97
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_language_edges(spark):
    prepare(spark)
    rng = random.Random(0)
    data = [(i, " ".join(rng.choices(["the", "thing", "of"] if i % 2 else ["der", "nicht", "ünd"], k=20)), "en" if i % 2 else "de", i) for i in range(200)]
    data += [(1000, None, "en", 0), (1001, "", "en", 0), (1002, "12 #!", None, 0), (1003, "the " * 60000, None, 0), (1003, "the " * 60000, None, 0), (None, "der nicht", None, 0)]
    docs = spark.createDataFrame(data, "doc_id long, text string, lang string, score int")
    got = {}
    for r in langid.identify(docs).collect():
        got.setdefault(r["doc_id"], []).append((r["lang_pred"], r["score"] > 0))
    assert got[1000] == got[1001] == got[1002] == [("und", False)]
    assert got[1003] == [("en", True)] * 2 and got[None] == [("de", True)]
    assert all(got[i] == [("en" if i % 2 else "de", True)] for i in range(200))
    assert langid.identify(docs.where("false")).count() == 0
    assert {r["lang_pred"] for r in langid.identify(docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def test_kernel_matches_its_definition():
    """The model's kernel part equals shared n-grams over the root of both counts."""
    texts = ["The cat sat", "the hat", "zzz 12 ü"]
    x, has = langid.presence(texts)
    assert has.all()
    grams = []
    for t in texts:
        s = "".join(c if c.isalpha() else " " for c in t.lower())
        s = " ".join(s.split()) + (" " if not s[-1].isalpha() else "")
        grams.append({s[i : i + n] for n in (1, 2, 3) for i in range(len(s) - n + 1)})
    assert [int(v) for v in x.sum(axis=1)] == [len(g) for g in grams]
    assert (x[0] * x[1]).sum() == len(grams[0] & grams[1])


def test_toxicity_held_out(spark):
    prepare(spark)
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    rows = toxicity.rate_documents(docs, labels).join(labels, "doc_id").where("held_out").collect()
    toxic = [r for r in rows if r["toxic"] == 1]
    assert len(toxic) > 50 and np.mean([r["predicted"] for r in toxic]) > 0.85
    assert np.mean([r["predicted"] for r in rows if r["toxic"] == 0]) < 0.02
    texts = {r["doc_id"]: r["text"].encode() for r in docs.where(F.col("doc_id").isin([r["doc_id"] for r in toxic])).collect()}
    for r in toxic[:20]:
        for s in r["segments"]:
            assert 0 <= s["start"] < s["end"] <= len(texts[r["doc_id"]]) and s["e_value"] < toxicity.SIGNIFICANT


def test_toxicity_edges(spark):
    prepare(spark)
    rng = random.Random(0)
    word = lambda: "".join(rng.choices("abcdefgh", k=5))
    data = [(i, " ".join([word() for _ in range(30)] + (["vileword"] * 2 if i % 5 == 0 else [])), 7) for i in range(600)]
    data += [(9000, None, 0), (9001, "", 0), (9002, "x " * 100000 + "vileword", 0), (9002, "x " * 100000 + "vileword", 0), (None, "vileword vileword", 0)]
    docs = spark.createDataFrame(data, "doc_id long, text string, score int")
    labels = spark.createDataFrame([(i, int(i % 5 == 0)) for i in range(600)] + [(None, 1), (5, None)], "doc_id long, toxic int")
    got = {}
    for r in toxicity.rate_documents(docs, labels).collect():
        got.setdefault(r["doc_id"], []).append(r["predicted"])
        assert 0 <= r["score"] <= 1
    assert got[9000] == got[9001] == [0] and got[None] == [1] and got[9002] == [0, 0]
    assert np.mean([got[i] == [int(i % 5 == 0)] for i in range(600)]) > 0.98
    for other in (labels.where("false"), labels.where("toxic = 0")):
        assert {r["score"] for r in toxicity.rate_documents(docs, other).collect()} == {0.0}
    assert toxicity.rate_documents(docs.where("false"), labels).count() == 0


def test_segments_are_the_maximal_ones():
    """Against the recursive definition: the best segment, then the same left and right of it."""
    rng = random.Random(1)

    def recursive(scores, offset=0):
        best = None
        for i in range(len(scores)):
            total = 0.0
            for j in range(i, len(scores)):
                total += scores[j]
                if total > 1e-9 and (best is None or total > best[0] + 1e-9):
                    best = (total, i, j)
        if best is None:
            return []
        s, i, j = best
        return recursive(scores[:i], offset) + [(offset + i, offset + j, round(s, 6))] + recursive(scores[j + 1 :], offset + j + 1)

    for _ in range(200):
        n = rng.randint(1, 25)
        places = sorted(rng.sample(range(n), rng.randint(0, n)))
        values = [rng.choice([3.17, 1.31, 0.57, -0.83]) * rng.uniform(0.5, 1.5) for _ in places]
        line = [-0.3] * n
        for p, v in zip(places, values):
            line[p] = v
        got = [(a, b, round(s, 6)) for a, b, s in toxicity.maximal_segments(places, values, -0.3)]
        assert got == recursive(line)


def test_html_drawn_layouts():
    model = html_blocks.train()
    rng = np.random.default_rng(77)
    right = total = 0
    for _ in range(150):
        page, main = html_blocks._drawn(rng)
        found = html_blocks.blocks(page)
        if found:
            p = html_blocks.probabilities(model, [html_blocks.vectors(found)])[0] >= 0.5
            right += sum(a == (t in main) for a, (t, _, _) in zip(p, found))
            total += len(found)
    assert right / total > 0.97


def test_html_pages_and_edges(spark):
    prepare(spark)
    page = '<html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body><nav><ul><li><a href="/a">Home</a></li><li><a href="/b">News</a></li></ul></nav><!-- c --><div class="ad">Buy now.</div><article><h1>A title &amp; more</h1><p>First  paragraph\n with <b>bold</b>&nbsp;text, long enough to be read.<br>And on.</p><p>Second one &lt;here&gt;, also of some length.</article><div id="comments"><p>anon wrote: nice</p></div><footer>&copy; 2024 x</footer></body></html>'
    rows = [(1, "u", page, "old"), (1, "u", page, "old"), (2, None, None, None), (3, "v", "", None), (None, "w", "<p>", None), (4, "x", page.replace("Second", "word " * 60000), None)]
    out = html_blocks.extract(spark.createDataFrame(rows, "page_id long, url string, html string, text string"))
    assert out.columns == ["page_id", "url", "text"]
    got = [(r["page_id"], r["text"]) for r in out.collect()]
    want = "A title & more\n\nFirst paragraph with bold text, long enough to be read. And on.\n\nSecond one <here>, also of some length."
    assert [t for i, t in got if i == 1] == [want, want]
    assert {t for i, t in got if i in (2, 3, None)} == {""}
    assert len(dict(got)[4]) > 300000
    assert html_blocks.extract(spark.createDataFrame([], "page_id long, html string")).count() == 0


def exact(rows, k, every):
    ids = np.array([r[0] for r in rows])
    unit = np.array([r[1] for r in rows], dtype=np.float64)
    unit /= np.linalg.norm(unit, axis=1)[:, None]
    out = {}
    for i in np.flatnonzero(ids % every == 0):
        s = unit @ unit[i]
        order = [j for j in np.lexsort((ids, -s)) if ids[j] != ids[i]][:k]
        out[int(ids[i])] = [(int(ids[j]), s[j]) for j in order]
    return out


def test_neighbours_recall(spark):
    prepare(spark)
    table = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    got = {}
    for r in ann.nearest(table, 50).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    want = exact([(r["vec_id"], r["embedding"]) for r in table.collect()], 5, 50)
    assert set(got) == set(want)
    assert np.mean([len({v for v, _ in got[q]} & {v for v, _ in want[q]}) / 5 for q in want]) > 0.95


def test_neighbours_edges(spark):
    prepare(spark)
    rng = np.random.default_rng(3)
    common = [1.0, 2.0, 3.0, 4.0, 5.0]
    rows = [(i, common if i % 3 == 0 else rng.normal(size=5).tolist(), 1) for i in range(300)]
    bad = [(1000, None, 0), (1001, [0.0] * 5, 0), (1002, [1.0, None, 1.0, 1.0, 1.0], 0), (1003, [float("nan")] * 5, 0), (1004, [1.0, 2.0], 0), (None, common, 0), (1005, [float("inf"), 1.0, 1.0, 1.0, 1.0], 0)]
    schema = "vec_id long, embedding array<double>, rank int"
    got = {}
    for r in ann.nearest(spark.createDataFrame(rows + bad, schema), 50).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append(r["vec_id"])
    want = exact(rows, 5, 50)
    assert set(got) == set(want)
    for q in (0, 150):
        assert got[q] == [v for v in range(0, 30, 3) if v != q][:5]  # ties go to the smaller ids
    few = spark.createDataFrame([(0, common), (1, common), (2, [-1.0] * 5)], "vec_id long, embedding array<double>")
    assert [(r["rank"], r["vec_id"]) for r in ann.nearest(few, 50).orderBy("rank").collect()] == [(1, 1), (2, 2)]
    assert ann.nearest(few.where("false"), 50).count() == 0


@pytest.mark.parametrize("size", [1, 3, 4, 7, 64])
def test_codes_beat_plain_rounding(size):
    """The anisotropic codes score nearer to the true products than the worst code would, for every length of vector."""
    rng = np.random.default_rng(size)
    x = rng.normal(size=(400, size))
    x /= np.linalg.norm(x, axis=1)[:, None]
    book = ann.train(x)
    codes = ann._codes(book, ann._pad(x))
    packed = codes[:, 0::2] << 4 | codes[:, 1::2]
    table = ann._tables(book, x[:5])
    approx = sum(table[:, j, packed[:, j]] for j in range(packed.shape[1]))
    assert np.abs(approx - x[:5] @ x.T).mean() < 0.15
