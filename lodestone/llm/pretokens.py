"""Pre-tokenisation without regular expressions: codepoint classes and an associative scan of transition functions.

The split rule of byte-level BPE (contractions, runs of letters, digits or other signs each with an optional space before, runs of white space that leave their last character to what
follows) is a small automaton. Its transition functions over all symbols generate a finite monoid; each character becomes the number of its function, and
composing functions is a table look-up, which is associative. So the states before all characters of many texts come from one blocked prefix scan over small integers.
"""

from __future__ import annotations

import sys
import unicodedata
from functools import lru_cache

import numpy as np

# The letters that may follow an apostrophe in a contraction, and the code points with the property White_Space.
SHORT, LONG = ("s", "t", "m", "d"), ("re", "ve", "ll")
WHITE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]

LETTER, NUMBER, OTHER, QUOTE, BLANK, WHITES = range(6)
#: Symbols: classes with what follows resolved. QUOTE2 and QUOTE3 begin a contraction of that length if a token begins there; END_* are the last white space before something else.
S_LETTER, S_NUMBER, S_OTHER, S_QUOTE, S_QUOTE2, S_QUOTE3, S_END_BLANK, S_END_WHITE, S_WHITE = range(9)
SYMBOLS = 9
#: States: nothing open, a space that joins what follows, an open run of letters, numbers, other signs or white space, two or one characters of a contraction left.
FREE, SPACED, IN_LETTERS, IN_NUMBERS, IN_OTHER, IN_WHITE, TWO_LEFT, ONE_LEFT = range(8)
STATES = 8
_OPENS = [IN_LETTERS, IN_NUMBERS, IN_OTHER, IN_OTHER, ONE_LEFT, TWO_LEFT, SPACED, FREE, IN_WHITE]
_SIGNS = (S_OTHER, S_QUOTE, S_QUOTE2, S_QUOTE3)


def _step(state: int, symbol: int) -> tuple[int, bool]:
    """The next state, and whether a token begins at the symbol."""
    if state == TWO_LEFT:
        return ONE_LEFT, False
    if state == ONE_LEFT:
        return FREE, False
    if state == SPACED and symbol < S_END_BLANK:
        return (IN_OTHER if symbol in _SIGNS else _OPENS[symbol]), False
    if (state, symbol) in ((IN_LETTERS, S_LETTER), (IN_NUMBERS, S_NUMBER), (IN_WHITE, S_WHITE)) or state == IN_OTHER and symbol in _SIGNS:
        return state, False
    return _OPENS[symbol], True


@lru_cache(None)
def classes() -> np.ndarray:
    """The class of every code point."""
    out = np.full(sys.maxunicode + 1, OTHER, dtype=np.uint8)
    for c in range(sys.maxunicode + 1):
        kind = unicodedata.category(chr(c))[0]
        if kind == "L":
            out[c] = LETTER
        elif kind == "N":
            out[c] = NUMBER
    out[WHITE] = WHITES
    out[0x20], out[0x27] = BLANK, QUOTE
    return out


@lru_cache(None)
def monoid() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, int]:
    """(function numbers of the symbols, then of the symbols at a text's start; composition table; functions by number; starts by state and symbol; identity)."""
    inside = [tuple(_step(s, x)[0] for s in range(STATES)) for x in range(SYMBOLS)]
    at_start = [(_OPENS[x],) * STATES for x in range(SYMBOLS)]
    identity = tuple(range(STATES))
    number = {identity: 0}
    todo = [identity]
    while todo:
        f = todo.pop()
        for g in inside + at_start:
            h = tuple(g[s] for s in f)
            if h not in number:
                number[h] = len(number)
                todo.append(h)
    functions = np.array(list(number), dtype=np.uint8)
    table = np.array([[number[tuple(g[s] for s in f)] for g in number] for f in number], dtype=np.uint16)
    starts = np.array([[_step(s, x)[1] for x in range(SYMBOLS)] for s in range(STATES)], dtype=bool)
    return np.array([number[f] for f in inside + at_start], dtype=np.uint16), table, functions, starts, 0


def scan(x: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Inclusive prefix compositions of function numbers, in blocks: within blocks side by side, then over the blocks' totals, which is the same problem."""
    n = len(x)
    if n <= 64:
        out = x.copy()
        for i in range(1, n):
            out[i] = table[out[i - 1], x[i]]
        return out
    width = min(256, int(np.sqrt(n)) + 1)
    rows = -(-n // width)
    padded = np.zeros(rows * width, dtype=np.uint16)
    padded[:n] = x
    acc = np.ascontiguousarray(padded.reshape(rows, width).T)
    flat, k = table.ravel(), np.int32(len(table))
    for j in range(1, width):
        acc[j] = flat[acc[j - 1] * k + acc[j]]
    before = np.zeros(rows, dtype=np.uint16)
    before[1:] = scan(acc[-1], table)[:-1]
    return np.ascontiguousarray(flat[before[None, :] * k + acc].T).ravel()[:n]


def boundaries(codes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Where tokens begin in the code points of texts laid end to end; first: the places where nonempty texts begin."""
    n = len(codes)
    if not n:
        return np.zeros(0, dtype=np.int64)
    kinds = classes()[codes]
    symbol = np.array([S_LETTER, S_NUMBER, S_OTHER, S_QUOTE, S_WHITE, S_WHITE], dtype=np.uint8)[kinds]
    last = np.append(first[1:], n) - 1
    follows = np.zeros(n, dtype=bool)  # by something that is no white space, in the same text
    follows[:-1] = kinds[1:] < BLANK
    follows[last] = False
    symbol[follows & (kinds == BLANK)] = S_END_BLANK
    symbol[follows & (kinds == WHITES)] = S_END_WHITE
    quotes = np.flatnonzero(follows & (kinds == QUOTE))
    if len(quotes):
        one = codes[quotes + 1]
        ends = last[np.searchsorted(first, quotes, side="right") - 1]
        two = np.where(quotes + 2 <= ends, codes[np.minimum(quotes + 2, n - 1)], 0)
        symbol[quotes[np.isin(one, [ord(c) for c in SHORT])]] = S_QUOTE2
        for a, b in LONG:
            symbol[quotes[(one == ord(a)) & (two == ord(b))]] = S_QUOTE3
    numbers, table, functions, starts, _ = monoid()
    x = numbers[symbol]
    x[first] = numbers[symbol[first].astype(np.int64) + SYMBOLS]
    after = functions[scan(x, table), FREE]
    state = np.zeros(n, dtype=np.uint8)
    state[1:] = after[:-1]
    state[first] = FREE
    return np.flatnonzero(starts[state, symbol])

