"""Words of many texts at once, as arrays: spans and 64-bit hashes straight from UTF-8 bytes."""

from __future__ import annotations

import numpy as np
import xxhash

_U = np.uint64
#: White space of the word rule: space and the codes 9 to 13.
SPACE = np.zeros(256, dtype=bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True
#: Lower-cases A-Z and nothing else.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_STEP = _U(0x9E3779B97F4A7C15)
#: Longest span, in bytes, whose hash is mixed from its 8-byte parts here; longer ones go to xxhash one by one.
LONG = 64


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values with well-spread bits."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> _U(30)
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


#: What the hash of a span of so many bytes begins with, and the first so many bytes of eight.
_BEGUN = mix(np.arange(LONG + 2, dtype=np.uint64) * _STEP) * _STEP
_BYTES = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def parts(data: np.ndarray) -> np.ndarray:
    """The 8 bytes from each place of data, as numbers; zeros follow its end."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    return np.ndarray(len(data) + 1, "<u8", padded, strides=(1,))


def spans(data: np.ndarray, offsets: np.ndarray, space: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of words in bytes, and for each text the number of words before it (one entry more than texts)."""
    if not len(data):
        none = np.zeros(0, dtype=np.int64)
        return none, none, np.zeros(len(offsets), dtype=np.int64)
    word = ~np.frombuffer(data.tobytes().translate(space.tobytes()), bool)
    # where words begin and end by turns
    turns = np.empty(len(data) + 1, bool)
    turns[0], turns[-1] = word[0], word[-1]
    np.not_equal(word[1:], word[:-1], out=turns[1:-1])
    at = np.flatnonzero(turns)
    edges = offsets[(offsets > 0) & (offsets < len(data))]
    edges = np.unique(edges[word[edges] & word[edges - 1]])
    if len(edges):  # a text's first byte begins a word even if the text before ends in one
        at = np.insert(at, np.repeat(np.searchsorted(at, edges), 2), np.repeat(edges, 2))
    starts, ends = at[::2].copy(), at[1::2].copy()
    return starts, ends, np.searchsorted(starts, offsets)


def hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span's bytes, the same wherever the span lies."""
    length = ends - starts
    view = parts(data)
    out = mix(_BEGUN[np.minimum(length, LONG + 1)] ^ (view[starts] & _BYTES[np.minimum(length, 8)]))
    at = np.flatnonzero(length > 8)
    for j in range(8, LONG, 8):
        at = at[length[at] > j]
        if not len(at):
            break
        out[at] = mix(out[at] * _STEP ^ (view[starts[at] + j] & _BYTES[np.minimum(length[at] - j, 8)]))
    for i in np.flatnonzero(length > LONG).tolist():
        out[i] = xxhash.xxh3_64_intdigest(data[starts[i] : ends[i]].tobytes())
    return out
