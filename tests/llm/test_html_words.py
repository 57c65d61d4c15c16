"""Blocks of pages are read to their last word."""

import numpy as np

from lodestone.llm import html_blocks as H


def _said(text):
    return H.vectors([(text, np.zeros(H.PATH, np.float32), 0)])[0][H.PATH : H.PATH + H.WORDS]


def test_words_after_the_twelfth_count():
    opening = " ".join(f"word{i}" for i in range(12))
    assert not np.allclose(_said(opening + " subscribe newsletter cookies"), _said(opening + " mountain valley river"))


def test_words_are_bounded():
    for text in ("one", "same " * 5000, " ".join(f"w{i}" for i in range(5000)), "... !!!"):
        assert np.linalg.norm(_said(text)) <= 1 + 1e-4
    assert np.linalg.norm(_said(" ".join(f"w{i}" for i in range(50)))) > 0.5
