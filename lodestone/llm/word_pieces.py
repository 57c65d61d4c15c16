"""Token ids of a tokenizer that treats words apart (white space dropped, merges inside words, word ends marked), each distinct piece encoded once.

Texts are cut into pieces where the tokenizer's result can't depend on what lies beyond the cut: at ASCII white space, behind a run of ASCII letters, and before one that follows other ASCII signs.
No cut is made beside a byte above 127, as composition, case and letter classes there are the library's matter, nor behind an apostrophe, which may take the next letters. A text that holds a special token's string goes to the library whole.
"""

from __future__ import annotations

import json
import os
from collections.abc import Callable, Iterator

import numpy as np

from .piece_table import PieceTable

_SPACE, _LETTER, _OTHER, _APOSTROPHE, _HIGH = range(5)
_CLASS = np.full(256, _OTHER, dtype=np.uint8)
_CLASS[[32, 9, 10, 11, 12, 13]] = _SPACE
_CLASS[65:91] = _CLASS[97:123] = _LETTER
_CLASS[39] = _APOSTROPHE
_CLASS[128:] = _HIGH
#: Whether a piece may end between two bytes, by their classes.
_CUT = np.zeros((5, 5), dtype=bool)
_CUT[_SPACE] = _CUT[:, _SPACE] = True
_CUT[_LETTER, [_OTHER, _APOSTROPHE]] = True
_CUT[_OTHER, _LETTER] = True
_known: dict[str, WordEncoder] = {}


class _WordTable(PieceTable):
    def pieces(self, data: np.ndarray, raw: bytes, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        kind = _CLASS[data]
        edge = np.ones(len(data) + 1, dtype=bool)
        edge[1:-1] = _CUT[kind[:-1], kind[1:]]
        edge[offsets] = True
        at = np.flatnonzero(edge)
        starts, ends = at[:-1], at[1:]
        word = kind[starts] != _SPACE  # white space is cut off on both sides, so its pieces are single signs
        return starts[word], ends[word]


class WordEncoder:
    """A tokenizer file of the tokenizers library, with the ids of the pieces met lately."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        if (spec.get("normalizer") or {}).get("type") not in (None, "Sequence", "Lowercase", "NFC") or spec["model"].get("end_of_word_suffix") != "</w>":
            raise ValueError("not a tokenizer that treats words apart")
        self.special = [t["content"].encode() for t in spec.get("added_tokens", [])]
        self.kind = np.uint16 if self.tokenizer.get_vocab_size() <= 65536 else np.uint32
        self.table = _WordTable(self._encode, self.kind)

    def _encode(self, pieces: list[bytes]) -> list[np.ndarray]:
        found = self.tokenizer.encode_batch_fast([p.decode() for p in pieces], add_special_tokens=False)
        return [np.array(e.ids, dtype=self.kind) for e in found]

    def ids(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of texts given by their UTF-8 bytes, laid end to end, and each text's number of ids."""
        return with_special(*self.table.ids(data, offsets), data, offsets, self.special, self._encode)


def with_special(flat: np.ndarray, counts: np.ndarray, data: np.ndarray, offsets: np.ndarray, special: list[bytes], encode: Callable[[list[bytes]], list[np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """ids and counts of texts, those that hold a special token's string encoded again, whole, as the library takes it for the token."""
    raw = data.tobytes()
    rows = sorted({int(np.searchsorted(offsets, i, side="right")) - 1 for s in special for i in _places(raw, s)})
    if not rows:
        return flat, counts
    parts = np.split(flat, np.cumsum(counts)[:-1])
    for r in rows:
        parts[r] = encode([raw[offsets[r] : offsets[r + 1]]])[0]
    return np.concatenate(parts), np.array([len(p) for p in parts], dtype=np.int64)


def _places(raw: bytes, part: bytes) -> Iterator[int]:
    at = raw.find(part)
    while at >= 0:
        yield at
        at = raw.find(part, at + 1)


def encoder(path: str) -> WordEncoder:
    """This worker's encoder of a tokenizer file."""
    if path not in _known:
        _known[path] = WordEncoder(path)
    return _known[path]
