"""Word shingles as 64-bit hashes, shared by the near-duplicate operators."""

from __future__ import annotations

import numpy as np

#: Odd multipliers of the places in a shingle; shorter sequences use those of their own length.
_MULT = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD)]


def mix(x: np.ndarray) -> np.ndarray:
    """The finishing step of splitmix64, element by element."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(text: str | None) -> np.ndarray:
    """A hash for each word; A-Z count as a-z. bytes.split() parts at x20 and x09-x0D exactly."""
    import xxhash

    words = (text or "").encode().lower().split()
    return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))


def sequence(words: np.ndarray, size: int = 5) -> np.ndarray:
    """The shingle that starts at each word; a shorter text is one shingle, an empty one has none."""
    n = len(words)
    if n == 0:
        return np.zeros(0, np.uint64)
    k = min(size, n)
    out = np.full(n - k + 1, k, np.uint64)
    for j in range(k):
        out = (out ^ (words[j : n - k + 1 + j] * _MULT[j % 5])) * np.uint64(0x2545F4914F6CDD1D)
        out ^= out >> np.uint64(29)
    return mix(out)


def shingle_set(text: str | None, size: int = 5) -> np.ndarray:
    """The distinct shingles of a text, sorted."""
    return np.unique(sequence(word_hashes(text), size))


def overlap(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of two sorted sets."""
    if len(a) > len(b):
        a, b = b, a
    if len(a) == 0:
        return 0
    at = np.searchsorted(b, a)
    at[at == len(b)] = len(b) - 1
    return int(np.count_nonzero(b[at] == a))
