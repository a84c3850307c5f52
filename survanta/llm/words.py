"""Words of a text as byte strings and 64-bit codes; the shared helper of the text operators.

A word is a run of characters other than space and U+0009..U+000D. ``bytes.split`` breaks at exactly these six
bytes, none of which occurs inside a longer UTF-8 sequence, so the UTF-8 form can be split directly;
``bytes.lower`` changes A-Z only.
"""

from __future__ import annotations

import numpy as np
import xxhash

#: A worker's word cache is emptied beyond so many entries, so its memory stays bounded.
CACHE_WORDS = 300_000

ODD = np.uint64(0x9E3779B97F4A7C15)
MIX = np.uint64(0xBF58476D1CE4E5B9)
ONE = np.uint64(1)


def words_of(text: str | None, lower: bool = True) -> list[bytes]:
    """Words in order; null gives none."""
    if not text:
        return []
    raw = text.encode("utf-8", "surrogatepass")
    return (raw.lower() if lower else raw).split()


class WordCodes(dict):
    """Word to 64-bit code, computed once per word and worker."""

    def __missing__(self, word: bytes) -> int:
        code = xxhash.xxh64_intdigest(word)
        self[word] = code
        return code

    def of(self, words: list[bytes]) -> np.ndarray:
        if len(self) > CACHE_WORDS:
            self.clear()
        return np.fromiter(map(self.__getitem__, words), dtype=np.uint64, count=len(words))


def mixed(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(29))
    h = h * MIX
    return h ^ (h >> np.uint64(32))


def windows(codes: np.ndarray, k: int) -> np.ndarray:
    """A 64-bit hash of each run of ``k`` codes; empty where there are fewer."""
    n = len(codes) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    h = np.zeros(n, np.uint64)
    for i in range(k):
        h = mixed(h * ODD + codes[i:i + n] + ONE)
    return h


def shingle_set(codes: np.ndarray, k: int) -> np.ndarray:
    """Sorted distinct window hashes; the whole sequence as one where it is shorter than ``k``; empty without words."""
    if not len(codes):
        return np.empty(0, np.uint64)
    return np.unique(windows(codes, min(k, len(codes))))
