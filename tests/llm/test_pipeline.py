"""The pipeline's stages on a small corpus with planted cases, against what brute force says each should keep."""

import random

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")
from lodestone.llm._shared import cut  # noqa: E402

from .test_decontam import infix, words  # noqa: E402
from .test_jaccard_join import brute as components  # noqa: E402
from .test_line_dedup import brute as lines  # noqa: E402

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def corpus(tmp_path, spark):
    rng = random.Random(4)
    vocab = {"en": ["the", "and", "thing", "with", "that"], "de": ["der", "nicht", "und", "ünger", "auch"]}
    extra = ["".join(rng.choices("abcdefghij", k=rng.randint(3, 9))) for _ in range(900)]
    text = lambda lang, n: " ".join(rng.choice(vocab[lang]) if rng.random() < 0.4 else rng.choice(extra) for _ in range(n))
    docs = []
    for i in range(150):
        lang = "de" if i % 3 == 0 else "en"
        docs.append([i, "\n".join(text(lang, rng.randint(8, 40)) for _ in range(rng.randint(1, 4))), lang, f"src{i % 4}", 0])
    bench = [(k, text("en", 30)) for k in range(5)]
    near = docs[10][1].split()
    near[5] = "changed"
    docs += [
        [200, docs[7][1], "en", "src0", 0],  # a copy
        [201, " ".join(near), "en", "src0", 0],  # nearly one, in one line
        [202, "own words " + text("en", 20) + " " + bench[2][1] + " " + text("en", 20), "en", "src1", 0],  # a leak
        [203, "123 456 ###", None, "src1", 0],
        [204, None, "en", "src1", 0],
        [205, text("en", 300), "en", "src2", 0],
        [205, text("en", 300), "en", "src2", 0],
    ]
    docs.append([206, docs[-2][1] + " tail", "en", "src2", 0])
    for d in docs:
        d[4] = len(d[1]) if d[1] is not None else 0
    path = str(tmp_path)
    spark.createDataFrame([tuple(d) for d in docs], "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(bench, "item_id long, text string").coalesce(1).write.parquet(f"{path}/benchmark.parquet")
    return path, bench


def test_stages(spark, tmp_path):
    path, bench = corpus(tmp_path, spark)
    docs = spark.read.parquet(f"{path}/documents.parquet")
    inputs = docs.count()
    by_name = {}
    for name, stage in corpus_pipeline.STAGES:
        before = [tuple(r) for r in docs.select(*COLUMNS).collect()]
        docs = cut(stage(spark, docs, path), "test")
        by_name[name] = before, docs
        if name != "byte-level BPE":
            assert docs.columns == COLUMNS
    before, after = by_name["language ID"]
    assert sorted(r["doc_id"] for r in after.collect()) == sorted(d for d, *_ in before if d not in (203, 204)) and len(before) == inputs

    before, after = by_name["line dedup"]
    # the two rows of id 205 are documents of their own; brute force takes unique ids, so they are left out of the comparison with it
    got = {r["doc_id"]: (r["text"], r["n_chars"]) for r in after.collect()}
    want = {d: t for d, (t, n) in lines([(d, t) for d, t, *_ in before if d < 205]).items() if not (n and t == "")}
    assert {d: t for d, (t, _) in got.items() if d < 205} == want
    assert all(n == len(t) for t, n in got.values()) and 200 not in got

    before, after = by_name["n-gram Jaccard join"]
    groups = {}
    for i, (_, _, c) in enumerate(components([(i, t) for i, (_, t, *_) in enumerate(sorted(before))], 5, 80)):
        groups.setdefault(c, []).append(i)
    # a row of each group, that of the smallest id and text: rows of one id and other texts are documents of their own
    rows = [(d, t) for d, t, *_ in sorted(before)]
    assert sorted((r["doc_id"], r["text"]) for r in after.collect()) == sorted(rows[min(g)] for g in groups.values())

    before, after = by_name["benchmark decontamination"]
    leaked = {d for d, t, *_ in before if any(infix(words(b), words(t)) <= int(0.2 * len(words(b))) for _, b in bench)}
    assert sorted(r["doc_id"] for r in after.collect()) == sorted(d for d, *_ in before if d not in leaked) and 202 in leaked

    before, after = by_name["byte-level BPE"]
    assert sorted(r["doc_id"] for r in after.collect()) == sorted(d for d, *_ in before)
    assert all(r["n_tokens"] == len(r["ids"]) for r in after.collect())


def test_run(spark, tmp_path):
    path, _ = corpus(tmp_path, spark)
    out = corpus_pipeline.run(spark, path)
    assert "ids" in out.columns and out.count() > 100


def test_rows_of_one_id_null_ids_and_extra_columns(spark, tmp_path):
    rng = random.Random(9)
    text = lambda n: " ".join("".join(rng.choices("abcdefghij", k=rng.randint(3, 9))) for _ in range(n))
    one, two = text(60), text(60)
    near = " ".join(one.split()[:-1])
    rows = [(5, one, "x"), (5, two, "y"), (3, near, "x"), (None, one + " tail", "n"), (None, text(50), "n"), (8, two, "y"), (9, "", "e"), (9, "", "e"), (10, None, "e"), (11, text(40), "z"), (11, None, "z"), (5, two, "y")]
    docs = spark.createDataFrame([(d, t, "en", "s", len(t or ""), x) for d, t, x in rows], "doc_id long, text string, lang string, source string, n_chars long, component_id string").repartition(3)
    kept = corpus_pipeline.jaccard_join(spark, docs, "")
    assert kept.columns == docs.columns
    got = sorted(((r["doc_id"] is None, r["doc_id"] or 0, r["text"] or "", r["component_id"]) for r in kept.collect()))
    assert got == sorted([(False, 3, near, "x"), (False, 5, two, "y"), (True, 0, rows[4][1], "n"), (False, 9, "", "e"), (False, 9, "", "e"), (False, 10, "", "e"), (False, 11, rows[9][1], "z"), (False, 11, "", "z")])


def test_empty_tables(spark, tmp_path):
    path = str(tmp_path)
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, path).count() == 0


def test_texts_of_no_learnt_language_go(spark, tmp_path):
    path, _ = corpus(tmp_path, spark)
    docs = spark.read.parquet(f"{path}/documents.parquet")
    more = spark.createDataFrame([(900, "это совершенно другой язык", None, "x", 1), (901, "これは別の言語です", "en", "x", 1), (902, "the thing with that and the thing", None, "x", 1)], docs.schema)
    kept = {r["doc_id"] for r in corpus_pipeline.language_id(spark, docs.unionByName(more), path).collect()}
    assert 902 in kept and not kept & {900, 901, 203, 204} and set(range(150)) <= kept
