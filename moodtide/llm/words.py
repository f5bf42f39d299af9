"""Words and runs of words as hashes, for whole Arrow batches at once.

A word is a longest run of ASCII letters, ASCII digits and characters beyond ASCII, in lower case.
Beyond ASCII, punctuation, spaces and controls part words as signs do in ASCII, and each character
of a script written without spaces (SCRIPTS_WITHOUT_SPACES) is a word by itself. Hashes have 64 bits. Everything works on flat arrays: the words of all texts of a batch in a row,
with the place where each text begins.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 20
U = np.uint64
MULTIPLIER = 0x9E3779B97F4A7C15
IS_WORD = np.zeros(256, bool)
IS_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True

PARTING, IN_WORD, OWN_WORD = 0, 1, 2
#: Thai, Lao, Myanmar, Khmer, kana, Han with its extensions; first and last code points.
SCRIPTS_WITHOUT_SPACES = (
    (0x0E00, 0x0EFF), (0x1000, 0x109F), (0x1780, 0x17FF), (0x3005, 0x3007), (0x3040, 0x30FF), (0x31F0, 0x31FF),
    (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0xFF66, 0xFF9F), (0x1B000, 0x1B16F), (0x20000, 0x3FFFF),
)
#: Zero width space and byte order mark: format characters that part words.
PARTING_FORMATS = (0x200B, 0xFEFF)


def kind_of(code: int) -> int:
    category = unicodedata.category(chr(code))
    if category[0] in "PZ" or category == "Cc" or code in PARTING_FORMATS:
        return PARTING
    return OWN_WORD if any(first <= code <= last for first, last in SCRIPTS_WITHOUT_SPACES) else IN_WORD


def kinds_of(codes: np.ndarray) -> np.ndarray:
    """The kind of each code point, looked up once for those that are met."""
    met = np.zeros(int(codes.max(initial=0)) + 1, bool)
    met[codes] = True
    kinds = np.zeros(len(met), np.uint8)
    kinds[met] = [kind_of(int(code)) for code in np.flatnonzero(met)]
    return kinds[codes]


def beyond_ascii(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First byte, number of bytes and kind of each character beyond ASCII of UTF-8 bytes."""
    at = np.flatnonzero(data >= 0xC0)
    lead = data[at].astype(np.int64)
    size = 2 + (lead >= 0xE0) + (lead >= 0xF0)
    codes = lead & (0x7F >> size)
    for j in range(1, 4):
        more = size > j
        codes[more] = codes[more] << 6 | (data[at[more] + j] & 0x3F)
    return at, size, kinds_of(codes)


def mix(x: np.ndarray) -> np.ndarray:
    """A well-spread permutation of 64-bit numbers."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
        return x ^ (x >> U(31))


with np.errstate(over="ignore"):
    BYTE_VALUES = mix(np.arange(1, 257, dtype=U) * U(MULTIPLIER))
    FACTORS = mix(np.arange(1, 65, dtype=U) * U(MULTIPLIER) + U(77)) | U(1)

BASE = int(FACTORS[7])
INVERSE = pow(BASE, -1, 2**64)


def powers(base: int, n: int) -> np.ndarray:
    """base ** 0 ... base ** (n - 1), modulo 2 ** 64."""
    out = np.full(max(n, 1), U(base), U)
    out[0] = U(1)
    with np.errstate(over="ignore"):
        return np.multiply.accumulate(out)[:n] if n else out[:0]


def slices(texts: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows that hold about ``limit`` bytes, one row at least."""
    offsets = np.asarray(pc.cumulative_sum(pc.fill_null(pc.binary_length(texts), 0).cast(pa.int64())))
    begin = 0
    while begin < len(offsets):
        before = offsets[begin - 1] if begin else 0
        end = max(begin + 1, int(np.searchsorted(offsets, before + limit, "right")))
        yield begin, end
        begin = end


def flat_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts in a row, and len(texts) + 1 offsets; null is empty."""
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def words_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words, and for each text the number of words before it (one more at the end)."""
    data, offsets = flat_bytes(pc.utf8_lower(pc.fill_null(texts, "")))
    n = len(data)
    inside = IS_WORD[data]
    at, size, kind = beyond_ascii(data)
    for j in range(4):
        inside[at[(kind == PARTING) & (size > j)] + j] = False
    before, after = np.zeros(n, bool), np.zeros(n, bool)
    before[1:], after[:-1] = inside[:-1], inside[1:]
    alone = kind == OWN_WORD
    edges = np.concatenate([offsets, at[alone], at[alone] + size[alone]])
    edges = edges[(edges > 0) & (edges < n)]
    before[edges] = False
    after[edges - 1] = False
    starts = np.flatnonzero(inside & ~before)
    ends = np.flatnonzero(inside & ~after) + 1
    sums = np.zeros(n + 1, U)
    with np.errstate(over="ignore"):
        np.cumsum(BYTE_VALUES[data] * powers(BASE, n), out=sums[1:])
        hashes = mix((sums[ends] - sums[starts]) * powers(INVERSE, n)[starts] + (ends - starts).astype(U))
    return hashes, np.searchsorted(starts, offsets)


def windows(words: np.ndarray, size: int) -> np.ndarray:
    """Hash of each run of ``size`` words, texts not told apart."""
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, U)
    with np.errstate(over="ignore"):
        out = words[:n] * FACTORS[0]
        for j in range(1, size):
            out += words[j : j + n] * FACTORS[j]
        return mix(out)


def within(offsets: np.ndarray, size: int) -> np.ndarray:
    """Whether the window at each word lies wholly in its text."""
    total = int(offsets[-1])
    ok = np.ones(total, bool)
    for j in range(1, size):
        at = offsets[1:] - j
        ok[at[at >= offsets[:-1]]] = False
    return ok


def shingles_of(words: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``size`` words and the text of each.

    A text of fewer words, but at least one, has one shingle made of all its words.
    """
    counts = np.diff(offsets)
    ok = within(offsets, size)
    ok[max(0, len(words) - size + 1) :] = False
    places = np.flatnonzero(ok)
    hashes = windows(words, size)[places]
    owner = np.repeat(np.arange(len(counts)), counts)[places]
    short = np.flatnonzero((counts > 0) & (counts < size))
    if len(short):
        own = np.zeros(len(short), U)
        with np.errstate(over="ignore"):
            for j in range(size - 1):
                has = counts[short] > j
                own[has] += words[offsets[short[has]] + j] * FACTORS[j]
            own = mix(own + counts[short].astype(U))
        hashes, owner = np.concatenate([hashes, own]), np.concatenate([owner, short])
    return hashes, owner


def sequence_keys(words: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes per text that together stand for its words in their order."""
    place = np.arange(len(words)) - np.repeat(offsets[:-1], np.diff(offsets))
    longest = int(np.diff(offsets).max(initial=0))
    out = []
    for base, values in ((BASE, words), (int(FACTORS[9]), mix(words + U(1)))):
        sums = np.zeros(len(words) + 1, U)
        with np.errstate(over="ignore"):
            np.cumsum(values * powers(base, longest)[place], out=sums[1:])
            out.append(mix(sums[offsets[1:]] - sums[offsets[:-1]] + np.diff(offsets).astype(U)))
    return out[0], out[1]
