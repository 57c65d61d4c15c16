"""Work that reads a text once: many patterns, lists of words, JSON of any depth."""

import io
import json
import random
import re
from contextlib import redirect_stdout

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lodestone.operators import automaton, disclosure, graph
from lodestone.sources.json_walk import string_values, walk


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def _explained(df):
    out = io.StringIO()
    with redirect_stdout(out):
        df.explain("formatted")
    return out.getvalue()


@pytest.mark.parametrize("block", [1 << 20, 40])
def test_found(spark, monkeypatch, block):
    monkeypatch.setattr(automaton, "BLOCK_CHARS", block)
    monkeypatch.setattr(automaton, "OUT_ROWS", 7)
    rng = random.Random(block)
    texts = [(i, rng.choice([None, "", "".join(rng.choices("abé🙂 ", k=rng.randint(1, 60)))])) for i in range(60)]
    patterns = ["".join(rng.choices("abé🙂 ", k=rng.randint(1, 4))) for _ in range(60)] + ["", None, "zzz", "a"]
    found = automaton.found(spark.createDataFrame(texts, "id int, text string"), spark.createDataFrame([(p, 1) for p in patterns], "pattern string, id int"))
    want = {(i, p, t.index(p)) for i, t in texts if t is not None for p in patterns if p is not None and p in t}
    assert rows(found) == sorted(want, key=str)
    none = spark.createDataFrame([], "pattern string")
    assert automaton.found(spark.createDataFrame(texts, "id int, text string"), none).collect() == []


def test_a_hundred_thousand_patterns(spark):
    rng = random.Random(4)
    patterns = sorted({" ".join("".join(rng.choices("abcdefgh", k=rng.randint(2, 6))) for _ in range(rng.randint(1, 4))) for _ in range(110_000)})[:100_000]
    texts = [(i, " ".join(rng.choices(patterns, k=20))) for i in range(40)]
    symptoms = spark.createDataFrame([(k, [p.upper()]) for k, p in enumerate(patterns)], "symptom long, pattern array<string>")
    found = graph.symptoms(spark.createDataFrame(texts, "id long, text string"), symptoms)
    plan = _explained(found)
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    got = {(r["id"], r["symptom"]) for r in found.collect()}
    assert all((i, k) in got for i, t in texts[:2] for k, p in enumerate(patterns) if p in t)
    assert all(patterns[k] in texts[i][1] for i, k in got)


WORD = "(?<![A-Za-z0-9_])"


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="aAbB_1(é ", max_size=40), st.lists(st.text(alphabet="abAB", min_size=1, max_size=3), min_size=1, max_size=5, unique=True))
def test_lists_as_patterns(text, words):
    """Hits of lists are those of the patterns that spell the same rule."""
    either = "(?:" + "|".join(map(re.escape, words)) + ")"
    for rule, pattern, fold in ((disclosure.called(words), WORD + either + r"(?=[(])", 0), (disclosure.worded(words), WORD + either + "(?![A-Za-z0-9_])", re.I | re.A)):
        spans = []
        for i, w in enumerate(rule.words):
            one, two = (automaton._folded(x) if fold else x for x in (text, w))
            spans += [(m.start(), i, m.start() + len(w)) for m in re.finditer(f"(?={re.escape(two)})", one)]
        assert list(automaton._hits(rule, spans, text)) == re.findall(pattern, text, fold)


def test_scan_of_lists(spark):
    texts = spark.createDataFrame([(1, "run_job(run_job) xrun_job( THING things Thing_ thing, password = x"), (2, None), (3, "")], "id long, text string")
    rules = [disclosure.called(["run_job", "job"]), disclosure.worded(["thing"]), ("digit-run", "[0-9]{8,}", 0)]
    assert rows(disclosure.scan(texts, rules, ["password =", "nowhere"], ["thing", "password ="])) == [(1, "called", "run_job"), (1, "never", "password ="), (1, "worded", "THING")]


@settings(max_examples=300, deadline=None)
@given(st.recursive(st.none() | st.booleans() | st.integers() | st.floats(allow_nan=False, allow_infinity=False) | st.text(max_size=6), lambda x: st.lists(x, max_size=4) | st.dictionaries(st.text(max_size=4), x, max_size=4), max_leaves=20), st.sampled_from([None, 1]))
def test_string_values(value, indent):
    def plain(v, path):
        if isinstance(v, str):
            yield path, v
        elif isinstance(v, list):
            for i, x in enumerate(v):
                yield from plain(x, f"{path}[{i}]")
        elif isinstance(v, dict):
            for k, x in v.items():
                yield from plain(x, f"{path}.{k}")

    for ascii_ in (True, False):
        assert string_values(json.dumps(value, ensure_ascii=ascii_, indent=indent)) == list(plain(value, "$"))


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet='{}[],:"\\au1e-+.0 \n', max_size=14))
def test_what_cannot_be_read(text):
    def once(pairs):
        if len({k for k, _ in pairs}) < len(pairs):
            raise ValueError
        return dict(pairs)

    try:
        json.loads(text, object_pairs_hook=once, parse_constant=lambda _: 1 / 0)
        read = True
    except (ValueError, ZeroDivisionError):
        read = False
    assert (string_values(text) is not None) == read


def test_walk_any_depth(spark):
    deep = '{"a":[' * 500 + '"x"' + "]}" * 500
    texts = [(1, deep), (2, None), (3, "{"), (4, '"top"'), (5, '{"a": "\\ud800 \\u00e9", "a2": {"a": "b"}}'), (6, '{"a": 1, "a": "x"}'), (7, "[" * 100_000 + "]" * 100_000)]
    tracker = spark.sparkContext.statusTracker()
    before = len(tracker.getJobIdsForGroup(None))
    found = walk(spark.createDataFrame(texts, "k int, j string"), "k", "j")
    assert len(tracker.getJobIdsForGroup(None)) == before  # nothing runs while the plan is made
    assert rows(found) == rows(spark.createDataFrame([(1, "$" + ".a[0]" * 500, "x"), (4, "$", "top"), (5, "$.a", "? é"), (5, "$.a2.a", "b")], "k int, path string, value string"))
    assert _explained(found).count("+- * Scan") == 1
