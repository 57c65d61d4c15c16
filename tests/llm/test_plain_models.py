"""Scores of the fitted models, worked out again word by word and n-gram by n-gram."""

import math
import random
import re
import zlib

import numpy as np

from lodestone.llm import _words as W
from lodestone.llm import langid, queries, toxicity
from lodestone.llm._shared import prepare


def _hash(word):
    return int(W.hashes(np.frombuffer(word, np.uint8), np.array([0]), np.array([len(word)]))[0])


def _best(scores, offset=0):
    """Maximal segments by their definition: the best one, then those left and right of it."""
    sums = [(sum(scores[i : j + 1]), -i, -j) for i in range(len(scores)) for j in range(i, len(scores)) if scores[i] > 0 and scores[j] > 0]
    if not sums or max(sums)[0] <= 0:
        return []
    s, i, j = max(sums)
    i, j = -i, -j
    return [*_best(scores[:i], offset), (offset + i, offset + j, s), *_best(scores[j + 1 :], offset + j + 1)]


def test_toxicity_word_by_word(spark):
    prepare(spark)
    rng = random.Random(3)
    vile = ["vileword", "nastything", "uglyterm", "awfulphrase"]
    plain = ["".join(rng.choices("abcdefghik", k=rng.randint(3, 8))) for _ in range(60)]
    data = [(i, " ".join(rng.choices(plain, k=25) + (rng.choices(vile, k=2) if i % 4 == 0 else []))) for i in range(800)]
    docs = spark.createDataFrame(data, "doc_id long, text string")
    model = toxicity.fit(docs, spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(800)], "doc_id long, toxic int"))
    assert model.rate > 0 and model.factor > 0
    table = {int(w): (float(r), float(o)) for w, r, o in zip(model.words, model.ranks, model.odds)}
    texts = [(k, " ".join(rng.choices(plain + vile, k=rng.randint(0, 40)))) for k in range(60)] + [(60, "VILEWORD vilewordish"), (61, ""), (62, None)]
    for r in toxicity.score(spark.createDataFrame(texts, "doc_id long, text string"), model).collect():
        words = [bytes(c + 32 if 65 <= c <= 90 else c for c in w) for w in re.findall(rb"[A-Za-z\x80-\xff]+", (r["text"] or "").encode())]
        odds = []
        for w in words:
            known = [table[h] for h in [_hash(w), *[int(W.mix(np.array([_hash(w[:n])], np.uint64) + np.uint64(n))[0]) for n in toxicity.STEMS if len(w) > n]] if h in table]
            odds.append(max(known, key=lambda x: x[0])[1] if known else toxicity.DRIFT)
        found = [(s, math.log(model.factor * len(words)) - model.rate * s) for _, _, s in _best(odds)]
        found = [(s, e) for s, e in found if e < math.log(toxicity.SIGNIFICANT)]
        evidence, top = math.log1p(sum(-e for _, e in found)), max((s for s, _ in found), default=0.0)
        want = 1 / (1 + math.exp(-max(-30, min(30, model.curve[0] + evidence * model.curve[1] + top * model.curve[2]))))
        assert abs(r["score"] - want) < 1e-6 and len(r["segments"]) == len(found)


def test_language_gram_by_gram(spark):
    prepare(spark)
    rng = random.Random(5)
    say = {"en": "the thing of and that with is".split(), "de": "der nicht und für ist auch".split(), "fr": "le la été que avec très".split()}
    data = [(i, " ".join(rng.choices(say[x], k=rng.randint(3, 30))), x) for i in range(240) for x in [sorted(say)[i % 3]]]
    model = langid.fit(spark.createDataFrame(data, "doc_id long, text string, lang string"))
    place = lambda g: ((int.from_bytes(b"\0", "big") + _packed(g)) * int(langid._MULTIPLY[len(g) - 1]) % 2**64) >> 50
    texts = [(i, t) for i, (_, t, _) in enumerate(data[:40])] + [(100, "Der, der! 12"), (101, "x"), (102, "7"), (103, None)]
    for r in langid.predict(spark.createDataFrame(texts, "doc_id long, text string"), model).collect():
        s = "".join(c if c.isalpha() else " " for c in (r["text"] or "").lower())
        s = re.sub(" +", " ", s).lstrip(" ")
        grams = {place(s[i : i + n]) for n in (1, 2, 3) for i in range(len(s) - n + 1)}
        if not s:
            assert (r["lang_pred"], r["score"]) == ("und", 0.0)
            continue
        kernel = [sum(float(model.landmarks[g, m]) for g in grams) / math.sqrt(len(grams)) for m in range(model.landmarks.shape[1])] + [1.0]
        out = [sum(k * float(w) for k, w in zip(kernel, model.weights[:, c])) for c in range(len(model.langs))]
        e = [math.exp(8 * (x - max(out))) for x in out]
        assert r["lang_pred"] == model.langs[out.index(max(out))] and abs(r["score"] - max(e) / sum(e)) < 1e-4


def _packed(gram):
    value = 0
    for c in gram:
        value = value << 21 | ord(c)
    return value % 2**64


def test_held_out_by_crc32(spark, tmp_path):
    rng = random.Random(6)
    rows = [(i, " ".join(rng.choices(["the", "thing", "vileword"] if i % 2 else ["der", "nicht"], k=12)), "en" if i % 2 else "de") for i in range(150)] + [(None, "the thing", "en")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, i % 2) for i in range(150)], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for query in (queries.op9_language_id, queries.op10_toxicity):
        found = {r["doc_id"]: r["held_out"] for r in query(spark, str(tmp_path)).collect()}
        assert found == {d: d is not None and zlib.crc32(str(d).encode()) % 5 == 0 for d, *_ in rows}


def test_languages_are_kept_however_many_there_are(spark):
    """100 languages with words of their own: held-out texts of each are named and fit, texts of letters by chance do not."""
    prepare(spark)
    rng = random.Random(8)
    say = {}
    for k in range(100):
        letters = rng.sample("abcdefghijklmnopqrstuvwxyzäöüßéèçñõøåşğıłžčřęőűабвгдежзиклмнопрстуфхцчшщыэюя", 14)
        say[f"l{k:02d}"] = ["".join(rng.choices(letters, k=rng.randint(2, 9))) for _ in range(60)]
    text = lambda x: " ".join(rng.choices(say[x], k=rng.randint(15, 60)))
    data = [(i, text(x), x) for i in range(6000) for x in [f"l{i % 100:02d}"]]
    model = langid.fit(spark.createDataFrame(data, "doc_id long, text string, lang string"))
    assert len(model.langs) == 100 and model.least.min() > 0
    fresh = [(i, text(f"l{i % 100:02d}")) for i in range(1000)]
    rows = {r["doc_id"]: r for r in langid.predict(spark.createDataFrame(fresh, "doc_id long, text string"), model).collect()}
    assert sum(rows[i]["lang_pred"] == f"l{i % 100:02d}" for i in rows) >= 980
    assert sum(r["fits"] for r in rows.values()) >= 990
    chance = [(i, " ".join("".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randint(2, 9))) for _ in range(40))) for i in range(200)]
    assert sum(r["fits"] for r in langid.predict(spark.createDataFrame(chance, "doc_id long, text string"), model).collect()) <= 2


def test_a_language_of_few_rows_has_its_least_share_from_them(spark):
    prepare(spark)
    data = [(1, "one text alone", "en"), (2, "one text alone", "en"), (3, "ein text", "de"), (4, "noch ein langer text", "de"), (5, "123", "xx")]
    model = langid.fit(spark.createDataFrame(data, "doc_id long, text string, lang string"))
    assert model.langs == ["de", "en"] and model.least[0] > 0 and model.least[1] == 0
    texts = [(1, "one text"), (2, "123"), (3, None)]
    rows = langid.predict(spark.createDataFrame(texts, "doc_id long, text string").selectExpr("*", "7 as fits"), model).collect()
    assert {r["doc_id"]: (r["lang_pred"], r["fits"]) for r in rows} == {1: ("en", True), 2: ("und", False), 3: ("und", False)}
