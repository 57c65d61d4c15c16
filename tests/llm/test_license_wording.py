"""The licenses' own wording, and that no line is lost before its words are counted."""

import random
import re

from lodestone.llm import license_scan as S

from .test_license_scan import similarity

HEADERS = [
    ("BSD-3-Clause", "Copyright 2024 The Go Authors. All rights reserved. Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License, version 2."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License, version 3 or later."),
]


def test_true_wording(spark):
    rows = S.line_licenses(spark.createDataFrame([(0, "\n".join(t for _, t in HEADERS))], "rid long, text string")).collect()
    assert {r["line"]: r["license"] for r in rows} == dict(enumerate(n for n, _ in HEADERS))
    assert {r["line"]: r["similarity"] for r in rows if r["line"] > 0} == {1: 1.0, 2: 1.0}


def test_no_line_is_lost_and_frequent_words_are_set_apart():
    strong = set(S.strong_words(S.THRESHOLD))
    assert not strong & {"the", "of", "and", "to", "a", "in", "is", "that", "it"}
    rng = random.Random(3)
    for _, text in S.TEMPLATES:
        words = re.findall(S.WORD, text.lower())
        weak = [w for w in words if w not in strong]
        assert round(similarity(" ".join(weak))[0], 6) < S.THRESHOLD
        for _ in range(20):
            assert round(similarity(" ".join(rng.choices(weak or ["the"], k=len(words))))[0], 6) < S.THRESHOLD
