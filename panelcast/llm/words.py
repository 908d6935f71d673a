"""Words of a text as numbers, and n-grams of words, for code that runs in Arrow batches.

A word is a run of bytes other than space and U+0009 to U+000D, so ``bytes.split`` finds exactly the words
of the pattern ``[^\\x20\\x09-\\x0D]+``. Hashes do not depend on the process.
"""

from __future__ import annotations

import numpy as np
import xxhash

#: Words one Python worker remembers before it starts again. Bounds memory, never results.
REMEMBERED = 300_000

_ODD = np.uint64(0x9E3779B97F4A7C15)


def hashes(words: list[bytes]) -> np.ndarray:
    """One unsigned 64-bit number per word, computed each time: that takes less than to look most words up, and no memory."""
    return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))


def mix(values: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit numbers; a bijection."""
    values = values ^ (values >> np.uint64(32))
    values = values * np.uint64(0xD6E8FEB86659FD93)
    values ^= values >> np.uint64(32)
    values *= np.uint64(0xD6E8FEB86659FD93)
    values ^= values >> np.uint64(32)
    return values


def ngrams(numbers: np.ndarray, size: int) -> np.ndarray:
    """Hash of every run of ``size`` consecutive words, in order; empty if there are fewer words."""
    count = len(numbers) - size + 1
    if count <= 0:
        return np.empty(0, np.uint64)
    total = numbers[:count].copy()
    for step in range(1, size):
        total *= _ODD
        total += numbers[step : step + count]
    return mix(total)


def ngram_set(words: list[bytes], size: int) -> np.ndarray:
    """Sorted distinct n-grams. A text of fewer words has all its words as its one n-gram; no words, none."""
    if not words:
        return np.empty(0, np.uint64)
    return np.unique(ngrams(hashes(words), min(size, len(words))))
