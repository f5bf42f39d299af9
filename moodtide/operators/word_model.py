"""A linear model over hashed words, as the scorer takes one."""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass
from functools import lru_cache

import numpy as np

_BLANKS = re.compile("[ \\r\\n\\t]+")


@lru_cache(maxsize=1 << 16)
def _bucket(word: str, buckets: int) -> int:
    return int.from_bytes(hashlib.md5(word.encode()).digest()[:4], "big") % buckets


@dataclass(frozen=True)
class HashedWords:
    """Logits are the mean weight of a text's words, times ``scale``.

    ``weights`` has a row per bucket and a column per class. Words part at blanks and line breaks and
    fall into the bucket of their MD5. A model made for short texts says so by ``max_tokens``: it sees
    that many words of each text; without, it sees them all. A text without words has logits of zero.
    """

    weights: np.ndarray
    scale: float = 1.0
    max_tokens: int | None = None

    def __call__(self, texts: list[str | None]) -> list[list[float]]:
        buckets = len(self.weights)
        words = [[w for w in _BLANKS.split(text or "") if w][: self.max_tokens] for text in texts]
        sizes = [len(found) for found in words]
        counts = np.zeros((len(texts), buckets))
        rows = np.repeat(np.arange(len(texts)), sizes)
        columns = np.array([_bucket(w, buckets) for found in words for w in found], dtype=np.int64)
        np.add.at(counts, (rows, columns), 1.0)
        means = counts @ self.weights / np.maximum(sizes, 1)[:, None]
        return (means * self.scale).tolist()
