"""Words and hashed word sequences of texts, for operators that run over Arrow batches."""

from __future__ import annotations

import re

import numpy as np

#: Longest runs of letters and digits (of the lower-cased text).
WORD = re.compile(r"[^\W_]+")
#: Words whose hash a worker remembers, so that its memory stays bounded.
REMEMBERED = 500_000

_GOLD = np.uint64(0x9E3779B97F4A7C15)
_MIX1, _MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit mixer (splitmix64's finaliser)."""
    x = (x ^ (x >> np.uint64(30))) * _MIX1
    x = (x ^ (x >> np.uint64(27))) * _MIX2
    return x ^ (x >> np.uint64(31))


class _Hashes(dict):
    def __missing__(self, word: str) -> int:
        import xxhash

        if len(self) >= REMEMBERED:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass"))
        return h


_hashes = _Hashes()


def word_hashes(text: str | None) -> np.ndarray:
    """One 64-bit hash for each word of a text, in order; empty for null."""
    if not text:
        return np.zeros(0, np.uint64)
    return np.array([_hashes[w] for w in WORD.findall(text.lower())], np.uint64)


def sequences(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all sequences of ``n`` words, in order; empty if there are fewer words."""
    m = len(words) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    h = words[:m].copy()
    for k in range(1, n):
        h = mix(h + _GOLD) + words[k : k + m] * _MIX1
    return mix(h)
