"""Words of whole texts as arrays: byte offsets and hashes, without a Python object per word."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

LETTER, BLANK, BORDER = 0, 1, 2
#: Bytes with A-Z lower-cased.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32
_rng = np.random.default_rng(20)
#: Two independent polynomial hashes modulo 2^64: a value for each byte and an odd base.
VALUES = _rng.integers(0, 1 << 63, (2, 256), np.uint64) * np.uint64(2) + np.uint64(1)
BASES = (0x9E3779B97F4A7C15, 0xD1342543DE82EF95)


def kinds(blanks: bytes, borders: bytes = b"") -> np.ndarray:
    """Table of bytes that end a word, and of those that end a piece too."""
    table = np.zeros(256, np.uint8)
    table[list(blanks)] = BLANK
    table[list(borders)] = BORDER
    return table


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xA3B195354A39B70D)
    return x ^ (x >> np.uint64(32))


_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _power(which: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, grown to the longest run seen."""
    held = _powers.get(which)
    if held is None or len(held[0]) < n:
        size = 1 << max(20, (n - 1).bit_length())
        out = []
        for factor in (BASES[which], pow(BASES[which], -1, 1 << 64)):
            row = np.full(size, factor, np.uint64)
            row[0] = 1
            out.append(np.multiply.accumulate(row))
        held = _powers[which] = (out[0], out[1])
    return held


@dataclass
class Words:
    """Words of some texts one after another; ``data`` are the lower-cased bytes that ``start`` and ``end`` refer to."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    text: np.ndarray
    piece: np.ndarray
    first: np.ndarray

    def hashed(self, which: int = 0) -> np.ndarray:
        """64-bit hash of every word."""
        powers, inverse = _power(which, len(self.data))
        sums = np.zeros(len(self.data) + 1, np.uint64)
        np.cumsum(VALUES[which][self.data] * powers[: len(self.data)], out=sums[1:])
        return mix((sums[self.end] - sums[self.start]) * inverse[self.start] + (self.end - self.start).astype(np.uint64))


def words(texts: list[str], table: np.ndarray) -> Words:
    """Words of ``texts`` under a table of ``kinds``; no word and no piece reaches beyond its text."""
    parts = [t.encode("utf-8", "surrogatepass") for t in texts]
    data = LOWER[np.frombuffer(b"\n".join([*parts, b""]), np.uint8)]
    lengths = np.array([len(p) + 1 for p in parts], np.int64)
    kind = table[data]
    edges = np.cumsum(lengths) - 1
    kind[edges] = BORDER
    letter = np.zeros(len(data) + 2, np.int8)
    letter[1:-1] = kind == LETTER
    step = np.diff(letter)
    start, end = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
    text = np.searchsorted(edges, start)
    first = np.searchsorted(text, np.arange(len(parts) + 1))
    return Words(data, start, end, text, np.cumsum(kind == BORDER)[start] if len(start) else start, first)
