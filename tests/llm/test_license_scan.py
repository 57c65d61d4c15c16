"""License scans against a plain-Python version, inheritance along paths, and edges."""

import math
import re

from lodestone.llm import license_scan as S


def similarity(line):
    tokens = re.findall(S.WORD, line.lower())
    templates = [re.findall(S.WORD, t.lower()) for _, t in S.TEMPLATES]
    idf = lambda w: math.log((1 + len(templates)) / (1 + sum(w in t for t in templates))) + 1
    # words in no template have the largest idf and count once each
    v = {w: tokens.count(w) * idf(w) for w in set(tokens) if any(w in t for t in templates)}
    outside = sum(not any(w in t for t in templates) for w in tokens) * (math.log(1 + len(templates)) + 1) ** 2
    length = math.sqrt(sum(x * x for x in v.values()) + outside)
    best = (0.0, None)
    for (name, _), t in zip(S.TEMPLATES, templates):
        u = {w: t.count(w) * idf(w) for w in set(t)}
        norm = math.sqrt(sum(x * x for x in u.values()))
        c = sum(v.get(w, 0) * x for w, x in u.items()) / norm / length if length else 0.0
        if c > best[0] + 1e-9:
            best = (c, name)
    return best


LINES = [
    "Released under the MIT License.",
    "// released under THE mit license",
    "# Licensed under the Apache License, Version 2.0 (the License)",
    "This work is licensed under the GNU General Public License, version 3.",
    "This work is licensed under the GNU General Public License, version 2.",
    "the the the license of the version under the terms",
    "Permission is hereby granted to nobody",
    "Nothing to see here",
    "Licensed under CC BY-NC 4.0.",
    "license " * 50,
    "",
]


def test_lines_match_the_definition(spark):
    rows = S.line_licenses(spark.createDataFrame([(0, "\n".join(LINES))], "rid long, text string")).collect()
    got = {r["line"]: (round(r["similarity"], 6), r["license"]) for r in rows}
    want = {i: (round(c, 6), name) for i, (c, name) in enumerate(map(similarity, LINES)) if round(c, 6) >= S.THRESHOLD}
    assert got == want and len(want) >= 5


def test_nearest_ancestor(spark):
    mit, gpl = "Released under the MIT License.", "This work is licensed under the GNU General Public License, version 3."
    files = [
        (1, "LICENSE", mit, 1),
        (2, "a/b/c.py", "code", 1),
        (3, "a/COPYING.txt", "intro text\n" + gpl, 1),
        (4, "a/b/d.py", "# Licensed under CC BY-NC 4.0.\nx = 1\n" + "words " * 50, 1),
        (5, "z/e.py", None, 1),
        (6, "ab/f.py", "", 1),
        (6, "ab/f.py", "", 1),
        (7, None, "code", 1),
        (8, "a/b/x/LICENSE", "", 1),
        (9, "top.py", "code", 1),
    ]
    out = S.scan(spark.createDataFrame(files, "doc_id long, path string, text string, license int"))
    got = sorted((r["doc_id"], r["license"], r["via"], r["from_path"]) for r in out.collect())
    want = [
        (1, "MIT", "own", "LICENSE"),
        (2, "GPL-3.0", "inherited", "a/COPYING.txt"),
        (3, "GPL-3.0", "own", "a/COPYING.txt"),
        (4, "CC-BY-NC-4.0", "own", "a/b/d.py"),
        (5, "MIT", "inherited", "LICENSE"),
        (6, "MIT", "inherited", "LICENSE"),
        (6, "MIT", "inherited", "LICENSE"),
        (7, None, "none", None),
        (8, "GPL-3.0", "inherited", "a/COPYING.txt"),
        (9, "MIT", "inherited", "LICENSE"),
    ]
    assert got == want


def test_edges(spark):
    empty = spark.createDataFrame([], "doc_id long, path string, text string")
    assert S.scan(empty).count() == 0
    long = "word " * 200000 + "\nReleased under the MIT License.\n" + "word " * 200000
    rows = S.scan(spark.createDataFrame([(1, "a/b", long), (None, "a/c", "x")], "doc_id long, path string, text string")).collect()
    assert {(r["doc_id"], r["via"], r["license"]) for r in rows} == {(1, "own", "MIT"), (None, "none", None)}


def test_no_python_in_the_plan(spark):
    files = spark.createDataFrame([(1, "a/b", "x")], "doc_id long, path string, text string")
    plan = S.scan(files)._jdf.queryExecution().toString()
    assert not any(w in plan for w in ("Python", "Arrow", "Pandas"))
