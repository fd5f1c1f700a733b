"""Word hashes and shingle sets of texts, computed in Python workers with numpy."""

from __future__ import annotations

import numpy as np
import xxhash


def word_list(text: str | None) -> list[bytes]:
    """Words in UTF-8 with A-Z lower-cased, split at ASCII white space."""
    return text.encode().lower().split() if text else []


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(32))


def shingle_hashes(hashes: np.ndarray, size: int) -> np.ndarray:
    """One 64-bit hash for each run of ``size`` words; of all words as one run if there are fewer."""
    n = len(hashes) - size + 1
    if n < 1:
        size, n = len(hashes), min(len(hashes), 1)
    out = np.full(n, size, np.uint64)
    for k in range(size):
        out = mixed(out * np.uint64(0x9E3779B97F4A7C15) + hashes[k:k + n])
    return out


def shingle_set(text: str | None, size: int) -> np.ndarray:
    """The distinct shingle hashes of a text, sorted."""
    return np.unique(shingle_hashes(word_hashes(word_list(text)), size))
