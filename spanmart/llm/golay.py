"""The binary Golay code of length 23: every word lies within 3 bits of exactly one codeword."""

from __future__ import annotations

from functools import cache
from itertools import combinations

import numpy as np

LENGTH = 23
DATA = 12
GENERATOR = 0b101011100011  # x^11 + x^9 + x^7 + x^6 + x^5 + x + 1, a fixed value
PARITY = LENGTH - DATA


def syndrome(word: int) -> int:
    """Remainder of a word by the generator polynomial."""
    for bit in range(LENGTH - 1, PARITY - 1, -1):
        if word >> bit & 1:
            word ^= GENERATOR << (bit - PARITY)
    return word


@cache
def error_of() -> np.ndarray:
    """Syndrome → the error pattern of at most 3 bits that causes it (the code is perfect)."""
    out = np.full(1 << PARITY, -1, np.int64)
    for weight in range(4):
        for bits in combinations(range(LENGTH), weight):
            pattern = sum(1 << b for b in bits)
            out[syndrome(pattern)] = pattern
    return out


@cache
def _remainders() -> tuple[np.ndarray, np.ndarray]:
    """Syndromes of the low and of the high half of a word; a word's own is their exclusive or."""
    low = np.array([syndrome(x) for x in range(1 << DATA)], np.int64)
    high = np.array([syndrome(x << DATA) for x in range(1 << PARITY)], np.int64)
    return low, high


def nearest(words: np.ndarray) -> np.ndarray:
    """Index (the data bits) of the codeword nearest to each word."""
    low, high = _remainders()
    remainder = low[words & ((1 << DATA) - 1)] ^ high[words >> DATA]
    return (words ^ error_of()[remainder]) >> PARITY


def keys(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(position of the word, index) for the codewords nearest to each word and to its 23 neighbours.

    Two words that differ in 2 bits have a common neighbour, and two that differ in 1 bit
    are neighbours, so words within 2 bits share an index.  A word within 2 bits of a codeword
    has that index alone; one 3 bits away has five more.
    """
    words = np.asarray(words, np.int64)
    flips = np.array([0, *(1 << b for b in range(LENGTH))], np.int64)
    found = np.sort(nearest(words[:, None] ^ flips[None, :]), axis=1)
    new = np.ones(found.shape, bool)
    new[:, 1:] = found[:, 1:] != found[:, :-1]
    return np.nonzero(new)[0], found[new]
