"""Word shingles as 64-bit numbers, for the operators that compare texts."""

from __future__ import annotations

import re

import numpy as np
import xxhash

WORD = re.compile(r"\w+")
K = 5
_STEP = np.uint64(0x9E3779B97F4A7C15)
_A, _B = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit mixer."""
    x = (x ^ (x >> np.uint64(30))) * _A
    x = (x ^ (x >> np.uint64(27))) * _B
    return x ^ (x >> np.uint64(31))


class WordNumbers(dict):
    """Word -> 64-bit hash; forgets everything when it has grown large."""

    def __missing__(self, word: str) -> int:
        if len(self) >= 500_000:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word.encode())
        return value


_numbers = WordNumbers()


def word_numbers(text: str | None) -> np.ndarray:
    words = WORD.findall(text.lower()) if text else []
    return np.fromiter(map(_numbers.__getitem__, words), np.uint64, len(words))


def shingles(text: str | None, k: int = K) -> np.ndarray:
    """Hashes of all runs of k words (lower-cased `\\w+`), in text order; none below k words."""
    words = word_numbers(text)
    n = len(words) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = words[:n].copy()
    for i in range(1, k):
        out *= _STEP
        out += words[i : i + n]
    return mix(out)


def labelled(values: np.ndarray) -> np.ndarray:
    """Each value together with the number of its earlier occurrences, so that none is repeated."""
    order = np.argsort(values, kind="stable")
    ranked = values[order]
    fresh = np.ones(len(ranked), bool)
    fresh[1:] = ranked[1:] != ranked[:-1]
    if fresh.all():
        return values
    place = np.arange(len(ranked))
    label = np.empty(len(ranked), np.uint64)
    label[order] = place - np.maximum.accumulate(np.where(fresh, place, 0))
    return np.where(label > 0, mix(values + label * _STEP), values)
