"""Hashed byte n-grams of whole texts."""

from __future__ import annotations

import numpy as np

#: Bytes hashed at a time, so that a very long text needs no more memory.
CHUNK = 1 << 20


def bins_of(raw: bytes, order: int, bits: int) -> np.ndarray:
    """The bin, of ``2 ** bits``, of each n-gram of ``order`` (4 at most) consecutive bytes."""
    x = np.frombuffer(raw, np.uint8).astype(np.uint32)
    if len(x) < order:
        return np.empty(0, np.int64)
    code = x[: len(x) - order + 1].copy()
    for i in range(1, order):
        code = (code << np.uint32(8)) | x[i : len(x) - order + 1 + i]
    return ((code * np.uint32(0x9E3779B1)) >> np.uint32(32 - bits)).astype(np.int64)


def counts_of(raw: bytes, order: int, bits: int) -> np.ndarray:
    """How often each bin occurs, over the whole of ``raw``."""
    total = np.zeros(1 << bits, np.int64)
    for at in range(0, max(1, len(raw)), CHUNK):
        total += np.bincount(bins_of(raw[at : at + CHUNK + order - 1], order, bits), minlength=1 << bits)
    return total
