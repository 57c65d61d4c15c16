"""The token table holds all tokens that count, however many there are."""

import random

from lodestone.llm import toxicity as T


def test_weaker_toxic_tokens_stay_in_rich_vocabularies(spark):
    rng = random.Random(9)
    word = lambda first: rng.choice(first) + "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=9))
    harmless = [word("abcdefghijklm") for _ in range(9000)]
    rows = [(i, " ".join(harmless), 0) for i in range(130)]
    # equal texts count once, so each has a word of its own
    rows = [(i, f"{t} {word('abc')}", x) for i, t, x in rows]
    rows += [(1000 + i, " ".join(["zzqkvile", *[word("nopqrstuvwxy") for _ in range(16000)]]), 1) for i in range(40)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, toxic int").repartition(8)
    model = T.fit(frame.select("doc_id", "text"), frame.select("doc_id", "toxic"))
    assert len(model.words) > 20_000 and (model.odds < 0).sum() > 20_000
    assert (model.odds > 0).any()
