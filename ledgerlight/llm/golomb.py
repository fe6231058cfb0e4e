"""Golomb-Rice code for sorted sets of integers, with whole-array operations only."""

from __future__ import annotations

import numpy as np


def encode(values: np.ndarray, limit: int) -> tuple[bytes, int]:
    """Bytes and Rice parameter for sorted distinct ``values`` in [0, limit): differences as unary quotients, then remainders."""
    if len(values) == 0:
        return b"", 0
    gaps = np.diff(values.astype(np.uint64), prepend=np.uint64(0))
    width = max(0, int(limit // len(values)).bit_length() - 1)
    quotients = (gaps >> np.uint64(width)).astype(np.int64)
    unary = np.ones(int(quotients.sum()) + len(values), np.uint8)
    unary[np.cumsum(quotients + 1) - 1] = 0
    places = np.arange(width - 1, -1, -1, dtype=np.uint64)
    rest = ((gaps[:, None] >> places) & np.uint64(1)).astype(np.uint8).ravel()
    return np.packbits(np.concatenate([unary, rest])).tobytes(), width


def decode(data: bytes, width: int, count: int) -> np.ndarray:
    """The ``count`` values that ``encode`` was given."""
    if count == 0:
        return np.zeros(0, np.uint64)
    bits = np.unpackbits(np.frombuffer(data, np.uint8))
    ends = np.flatnonzero(bits == 0)[:count]
    quotients = np.diff(ends, prepend=-1) - 1
    start = int(ends[-1]) + 1
    rest = bits[start : start + count * width].reshape(count, width).astype(np.uint64)
    low = rest @ (np.uint64(1) << np.arange(width - 1, -1, -1, dtype=np.uint64)) if width else np.zeros(count, np.uint64)
    return np.cumsum((quotients.astype(np.uint64) << np.uint64(width)) + low)
