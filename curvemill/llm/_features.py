"""Hashed byte n-gram counts of documents, as the two text classifiers use them."""

from __future__ import annotations

import numpy as np

from curvemill.llm._common import U64

_FACTOR = U64(0x9E3779B97F4A7C15)


def byte_grams(part: np.ndarray, n: int, bits: int) -> np.ndarray:
    """Hash in [0, 2**bits) of each n consecutive bytes."""
    total = len(part) - n + 1
    if total <= 0:
        return np.zeros(0, np.int64)
    key = np.zeros(total, U64)
    for k in range(n):
        key = (key << U64(8)) | part[k : k + total]
    return ((key * _FACTOR) >> U64(64 - bits)).astype(np.int64)


def gram_docs(offsets: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Start places of documents' grams in the part from offsets[0], and their counts (those that cross documents are left out)."""
    return offsets[:-1] - offsets[0], np.maximum(np.diff(offsets) - (n - 1), 0)
