"""Hashes of words and of word k-grams, vectorised over a text."""

from __future__ import annotations

import numpy as np
import xxhash

SEED = 42
#: Words whose hashes a task remembers (some 60 MB).
REMEMBERED = 300_000

_NEXT = np.uint64(0x9E3779B97F4A7C15)
_MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


class WordCodes(dict):
    """The 64-bit hash of each word; words seen before are looked up.  Workers outlive a task: ``clear`` at its end."""

    def __missing__(self, word: bytes) -> bytes:
        if len(self) > REMEMBERED:
            self.clear()
        code = self[word] = xxhash.xxh64_digest(word, SEED)
        return code

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.frombuffer(b"".join(map(self.__getitem__, words)), np.uint64)


def mixed(h: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """The hash of a path, lengthened by a word."""
    with np.errstate(over="ignore"):
        h = (h + codes) * _NEXT
        return h ^ h >> np.uint64(29)


def gram_hashes(codes: np.ndarray, k: int) -> np.ndarray:
    """A well-mixed hash of the k-gram at each word that has one."""
    n = max(0, len(codes) - k + 1)
    h = np.zeros(n, np.uint64)
    for j in range(k):
        h = mixed(h, codes[j : j + n])
    with np.errstate(over="ignore"):
        h = (h ^ h >> np.uint64(30)) * _MIX[0]
        h = (h ^ h >> np.uint64(27)) * _MIX[1]
        return h ^ h >> np.uint64(31)
