"""The binary Golay code of length 23: a perfect code, each word lies within three bits of exactly one of 4096 codewords."""

from __future__ import annotations

from functools import cache

import numpy as np

#: Generator polynomial x^11 + x^9 + x^7 + x^6 + x^5 + x + 1 (fixed value).
GENERATOR = 0b101011100011
LENGTH = 23


def _remainder(value: int) -> int:
    for i in range(LENGTH - 1, 10, -1):
        if value >> i & 1:
            value ^= GENERATOR << (i - 11)
    return value


@cache
def tables() -> tuple[np.ndarray, np.ndarray]:
    """Syndromes of the single bits, and for each of 2048 syndromes the error of at most three bits that has it."""
    single = np.array([_remainder(1 << i) for i in range(LENGTH)], np.int64)
    errors = np.zeros(2048, np.int64)
    for i in range(LENGTH):
        errors[single[i]] = 1 << i
        for j in range(i):
            errors[single[i] ^ single[j]] = 1 << i | 1 << j
            for k in range(j):
                errors[single[i] ^ single[j] ^ single[k]] = 1 << i | 1 << j | 1 << k
    return single, errors


def nearby_codewords(words: np.ndarray) -> np.ndarray:
    """For each word the 12-bit indices of the codewords that it and its 23 neighbours decode to: an array of n x 24.

    A row holds one or six different indices. Two words that differ in at most two bits have a neighbour in common
    (or are neighbours), so they always share an index.
    """
    single, errors = tables()
    words = words.astype(np.int64)
    syndrome = np.zeros(len(words), np.int64)
    for i in range(LENGTH):
        syndrome ^= np.where(words >> i & 1, single[i], 0)
    flips = np.concatenate([[0], 1 << np.arange(LENGTH, dtype=np.int64)])
    moved = syndrome[:, None] ^ np.concatenate([[0], single])[None, :]
    return (words[:, None] ^ flips[None, :] ^ errors[moved]) >> 11


@cache
def signs() -> np.ndarray:
    """All codewords, lengthened by a parity bit, as rows of +1 (bit set) and -1: 4096 x 24."""
    words = np.array([m << 11 | _remainder(m << 11) for m in range(4096)], np.int64)
    bits = words[:, None] >> np.arange(LENGTH) & 1
    bits = np.concatenate([bits, bits.sum(1, keepdims=True) & 1], 1)
    return (2 * bits - 1).astype(np.float32)


def likeliest_codewords(margins: np.ndarray, count: int) -> np.ndarray:
    """Soft decoding: for rows of 24 signed margins the indices of the `count` best correlated codewords, in any order."""
    score = margins.astype(np.float32) @ signs().T
    return np.argpartition(score, 4096 - count, axis=1)[:, 4096 - count :]
