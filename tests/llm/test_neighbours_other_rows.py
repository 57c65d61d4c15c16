"""Nearest neighbours of rows that have a direction, or a few, in common, against brute force."""

import numpy as np
import pytest

from lodestone.llm import ann
from lodestone.llm._shared import prepare


@pytest.mark.parametrize("kind", ["offset", "clusters"])
def test_recall(spark, kind):
    prepare(spark)
    rng = np.random.default_rng(5)
    n, d = 3000, 32
    middle = rng.normal(size=(1 if kind == "offset" else 4, d))
    x = middle[rng.integers(0, len(middle), n)] + rng.normal(size=(n, d)) * 0.01
    got = {}
    for r in ann.nearest(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>"), 50).collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    hits = []
    for q in range(0, n, 50):
        order = np.argsort(-np.einsum("nd,d->n", unit, unit[q]))
        hits.append(len(got[q] & set(order[order != q][:5].tolist())) / 5)
    assert np.mean(hits) > 0.98
