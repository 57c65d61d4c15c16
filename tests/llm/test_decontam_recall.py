"""Recall of items with all the edits that similarity allows, by length and by the place of the edits; no false alarm."""

import random

import numpy as np
import pytest

from lodestone.llm import decontam as D

CASES = 40


def _word(rng):
    return "".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(3, 8)))


def _edited(rng, words, n, how):
    words = list(words)
    if how == "spread":
        for _ in range(n):
            k, kind = rng.randrange(len(words)), rng.random()
            words[k : k + 1] = [_word(rng)] if kind < 0.5 else [] if kind < 0.75 else [words[k], _word(rng)]
    elif how == "even":
        for i in range(n):
            words[i * len(words) // n] = _word(rng)
    elif how == "first replaced":
        words[:n] = [_word(rng) for _ in range(n)]
    elif how == "first missing":
        del words[:n]
    else:
        words[-n:] = [_word(rng) for _ in range(n)]
    return words


@pytest.mark.parametrize("how", ["spread", "even", "first replaced", "first missing", "last replaced"])
def test_recall_by_length(how):
    rng = random.Random(how)
    for length in (8, 15, 30, 60, 120, 200):
        items = [[_word(rng) for _ in range(length)] for _ in range(CASES)]
        block = D.build(list(range(CASES)), [" ".join(x) for x in items], 0.8, 2, D.RECALL)
        # half of the passages begin their text, with nothing before
        before = lambda i: [] if i % 2 else [_word(rng) for _ in range(50)]
        texts = [" ".join(before(i) + _edited(rng, x, D.edits_of(length, 0.8), how) + [_word(rng) for _ in range(50)]).encode() for i, x in enumerate(items)]
        data = np.frombuffer(b"".join(texts), np.uint8)
        found = D.matches(block, data, np.concatenate([[0], np.cumsum([len(t) for t in texts])]))
        assert all(text == block.ids[item] and edits <= D.edits_of(length, 0.8) for text, item, edits, *_ in found)
        assert len(found) >= 0.95 * CASES, (how, length, len(found))


def test_short_items_and_low_similarity():
    """Of few words without an edit, and a similarity at which a passage need not keep a word pair."""
    block = D.build([1, 2, 3, 4], ["one", "two words", "three words here", ""], 0.8, 2, D.RECALL)
    text = b"one two words, three words here"
    assert sorted((block.ids[i], e) for _, i, e, *_ in D.matches(block, np.frombuffer(text, np.uint8), np.array([0, len(text)]))) == [(1, 0), (2, 0), (3, 0)]
    rng = random.Random(1)
    item = [_word(rng) for _ in range(20)]
    block = D.build([7], [" ".join(item)], 0.5, 2, D.RECALL)
    text = " ".join(w if i % 2 else _word(rng) for i, w in enumerate(item)).encode()
    assert [(i, e) for _, i, e, *_ in D.matches(block, np.frombuffer(text, np.uint8), np.array([0, len(text)]))] == [(0, 10)]


def test_the_first_of_two_equally_near_passages():
    block = D.build([5], ["alpha beta gamma delta epsilon zeta eta theta"], 0.8, 2, D.RECALL)
    one, two = "alpha beta gamma delta epsilon zeta eta xx", "alpha beta yy delta epsilon zeta eta theta"
    text = f"{one} {'filler ' * 30}{two}".encode()
    ((_, _, edits, start, _),) = D.matches(block, np.frombuffer(text, np.uint8), np.array([0, len(text)]))
    assert (edits, start) == (1, 0)
