"""Runs of characters (terms, words) in the texts of an Arrow batch, and hashes of them.

Everything works on the UTF-8 bytes of all texts in a row, with A-Z in lower case and nothing else
changed. Hashes are prefix polynomials modulo 2 ** 64; whoever needs certainty compares bytes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from moodtide.llm.words import BASE, BYTE_VALUES, INVERSE, U, flat_bytes, mix, powers

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def lowered(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts, A-Z in lower case, and where each text begins (one more at the end)."""
    data, offsets = flat_bytes(texts)
    return LOWER[data], offsets


def runs(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First byte and end of each longest run of bytes that are ``inside``; none crosses a text's edge."""
    n = len(inside)
    before, after = np.zeros(n, bool), np.zeros(n, bool)
    before[1:], after[:-1] = inside[:-1], inside[1:]
    edges = offsets[(offsets > 0) & (offsets < n)]
    before[edges] = False
    after[edges - 1] = False
    return np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1


def run_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    sums = np.zeros(len(data) + 1, U)
    with np.errstate(over="ignore"):
        np.cumsum(BYTE_VALUES[data] * powers(BASE, len(data)), out=sums[1:])
        return mix((sums[ends] - sums[starts]) * powers(INVERSE, len(data))[starts] + (ends - starts).astype(U))


def same_bytes(a: np.ndarray, a_starts: np.ndarray, b: np.ndarray, b_starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Whether a[a_starts : + size] equals b[b_starts : + size], for each of them."""
    ends = np.cumsum(sizes)
    step = np.arange(int(ends[-1]) if len(ends) else 0) - np.repeat(ends - sizes, sizes)
    unequal = a[np.repeat(a_starts, sizes) + step] != b[np.repeat(b_starts, sizes) + step]
    wrong = np.concatenate([[0], np.cumsum(unequal)])
    return wrong[ends] == wrong[ends - sizes]
