"""Words of a text, ``[^\\x20\\x09-\\x0D]+``, and their hashes."""

from __future__ import annotations

import numpy as np
import xxhash

#: Words whose hash a worker remembers; beyond it the memory starts anew.
MOST_WORDS = 500_000


def words_of(text: str | None) -> list[str]:
    """Words between ASCII white space; other white space is part of a word."""
    parts = (text or "").encode().split()
    return b" ".join(parts).decode().split(" ") if parts else []


class _Known(dict):
    def __missing__(self, word: str) -> int:
        self[word] = out = xxhash.xxh64_intdigest(word.encode(), 7)
        return out


class WordHashes:
    """64-bit hashes of words, each computed once."""

    def __init__(self):
        self.known = _Known()

    def __call__(self, words: list[str]) -> np.ndarray:
        if len(self.known) > MOST_WORDS:
            self.known = _Known()
        return np.fromiter(map(self.known.__getitem__, words), np.uint64, len(words))
