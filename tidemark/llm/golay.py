"""The perfect binary Golay code (23, 12): every 23-bit word lies within three bits of exactly one codeword."""

from __future__ import annotations

from functools import cache
from itertools import combinations

import numpy as np

N, CHECK_BITS = 23, 11
GENERATOR = 0b110001110101  # x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1


@cache
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Syndromes of the low 12 bits, of the high 11 bits, and the error pattern of each syndrome."""
    unit = []
    for bit in range(N):
        r = 1 << bit
        for k in range(N - 1, CHECK_BITS - 1, -1):
            if r >> k & 1:
                r ^= GENERATOR << (k - CHECK_BITS)
        unit.append(r)
    low, high = np.zeros(1 << 12, np.uint16), np.zeros(1 << 11, np.uint16)
    for bit in range(N):
        table, b = (low, bit) if bit < 12 else (high, bit - 12)
        table[(np.arange(len(table)) >> b) & 1 == 1] ^= unit[bit]
    errors = np.zeros(1 << CHECK_BITS, np.uint32)
    for weight in range(4):
        for bits in combinations(range(N), weight):
            syndrome = 0
            for b in bits:
                syndrome ^= unit[b]
            errors[syndrome] = sum(1 << b for b in bits)
    return low, high, errors


def decode(words: np.ndarray) -> np.ndarray:
    """The 12-bit index of the codeword nearest to each 23-bit word."""
    low, high, errors = _tables()
    w = words.astype(np.uint32)
    return (w ^ errors[low[w & 0xFFF] ^ high[w >> 12]]) >> CHECK_BITS


def near(words: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Indices of the codewords reached from each word by flipping at most one of its `bits` bits.

    Returns the owners' positions and the indices, without repeats for one owner: one index for words within two bits
    of their codeword, six or fewer else. Two words that differ in one bit: the index of either is among the other's.
    Two words that differ in two bits share an index at least.
    """
    w = words.astype(np.uint32)
    flips = np.concatenate(([0], 1 << np.arange(bits, dtype=np.uint32))).astype(np.uint32)
    found = np.sort(decode(w[:, None] ^ flips[None, :]), axis=1)
    first = np.ones(found.shape, bool)
    first[:, 1:] = found[:, 1:] != found[:, :-1]
    owner, at = np.nonzero(first)
    return owner, found[owner, at]
