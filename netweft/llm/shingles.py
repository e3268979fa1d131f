"""Sets of word shingles as sorted 64-bit hashes.

Words are the runs of bytes other than ASCII white space in the UTF-8 text with
A-Z lower-cased. A text with fewer words than a shingle has is one shingle of
all its words; without words it has the empty set.
"""
from __future__ import annotations

import numpy as np
import xxhash

_P = np.uint64(0x9E3779B97F4A7C15)
_A, _B = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mixed(x: np.ndarray) -> np.ndarray:
    """Spreads every bit of 64-bit values over all bits."""
    x = (x ^ (x >> np.uint64(30))) * _A
    x = (x ^ (x >> np.uint64(27))) * _B
    return x ^ (x >> np.uint64(31))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().lower().split()


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def sequence_hashes(hashes: np.ndarray, n: int) -> np.ndarray:
    """Of every n words in a row."""
    if len(hashes) < n:
        return np.empty(0, np.uint64)
    out = hashes[: len(hashes) - n + 1].copy()
    for k in range(1, n):
        out *= _P
        out += hashes[k : len(hashes) - n + 1 + k]
    return mixed(out ^ np.uint64(n))


def shingle_set(text: str | None, n: int) -> np.ndarray:
    h = word_hashes(words_of(text))
    if not len(h):
        return h
    s = sequence_hashes(h, min(n, len(h)))
    s.sort()
    return s[np.concatenate(([True], s[1:] != s[:-1]))]
