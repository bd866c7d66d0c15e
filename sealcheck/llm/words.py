"""Words of whole texts as 64-bit hashes, by array operations instead of a loop over words."""

from __future__ import annotations

import numpy as np

BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 2 ** 64)
_POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
# Everything in ASCII but letters and digits parts words where punctuation does not matter.
PUNCTUATION = np.array([c < 128 and not chr(c).isalnum() for c in range(256)])
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
# What a byte adds to the polynomial: never 0, so leading bytes count.
VALUE = LOWER.astype(np.uint64) + np.uint64(1)


def powers(n: int) -> list[np.ndarray]:
    """Powers of the base and of its inverse, at least n of them."""
    if len(_POWERS[0]) < n:
        size = 1 << n.bit_length()
        for i, base in enumerate((BASE, INVERSE)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _POWERS[i] = np.multiply.accumulate(steps)
    return _POWERS


def mix(h: np.ndarray) -> np.ndarray:
    """Spread every input bit over the word."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def word_hashes(raw: bytes, gaps: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, start, end) of each word: runs of bytes outside `gaps`, by default 0x20 and 0x09 to 0x0D; A-Z read as a-z.

    A hash is the polynomial of the word's bytes, taken from running sums over the text, and its length.
    """
    data = np.frombuffer(raw, np.uint8)
    gap = np.ones(len(data) + 2, bool)
    gap[1:-1] = gaps[data]
    edges = np.flatnonzero(gap[1:] != gap[:-1])
    starts, ends = edges[::2], edges[1::2]
    if not len(starts):
        return np.zeros(0, np.uint64), starts, ends
    power, inverse = powers(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    terms = VALUE[data]
    terms *= power[:len(data)]
    np.cumsum(terms, out=total[1:])
    h = (total[ends] - total[starts]) * inverse[starts]
    return mix(h + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)), starts, ends


def shingles(words: np.ndarray, size: int) -> np.ndarray:
    """Hashes of runs of `size` words; a shorter text that has words is one run."""
    size = min(size, len(words))
    if not size:
        return words
    h = np.zeros(len(words) - size + 1, np.uint64)
    for i in range(size):
        h = mix(h * np.uint64(BASE) + words[i:len(words) - size + 1 + i])
    return h
