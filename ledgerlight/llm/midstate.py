"""SHA-256 with its chaining value at hand: states that can be kept in a column, and whole arrays of them moved on by one block.

A library's hash object can be copied inside a process but not stored. The chaining value after a whole number of 64-byte
blocks is the same thing in 32 bytes: since a digest as hex text is exactly one block, the state of a parent before any of
its children is such a value.
"""

from __future__ import annotations

from math import isqrt

import numpy as np

HEX = np.frombuffer(b"0123456789abcdef", np.uint8)
BLOCK = 64


def _primes(n: int) -> list[int]:
    found: list[int] = []
    k = 2
    while len(found) < n:
        if all(k % p for p in found):
            found.append(k)
        k += 1
    return found


def _cube_root(n: int) -> int:
    root = 1 << -(-n.bit_length() // 3)
    while root**3 > n:
        root = (2 * root + n // root**2) // 3
    return root


#: The first 32 bits of the fractions of square roots (start) and cube roots (rounds) of the first primes.
START = np.array([isqrt(p << 64) & 0xFFFFFFFF for p in _primes(8)], np.uint32)
ROUNDS = np.array([_cube_root(p << 96) & 0xFFFFFFFF for p in _primes(64)], np.uint32)


def _turn(x: np.ndarray, n: int) -> np.ndarray:
    return (x >> np.uint32(n)) | (x << np.uint32(32 - n))


def compress(states: np.ndarray, blocks: np.ndarray) -> np.ndarray:
    """States (n, 8) after one more block (n, 16) of big-endian words each."""
    w = list(np.ascontiguousarray(blocks.T))
    for t in range(16, 64):
        a, b = w[t - 15], w[t - 2]
        w.append(w[t - 16] + (_turn(a, 7) ^ _turn(a, 18) ^ (a >> np.uint32(3))) + w[t - 7] + (_turn(b, 17) ^ _turn(b, 19) ^ (b >> np.uint32(10))))
    a, b, c, d, e, f, g, h = before = list(np.ascontiguousarray(states.T))
    for t in range(64):
        one = h + (_turn(e, 6) ^ _turn(e, 11) ^ _turn(e, 25)) + (g ^ (e & (f ^ g))) + ROUNDS[t] + w[t]
        two = (_turn(a, 2) ^ _turn(a, 13) ^ _turn(a, 22)) + (((a | b) & c) | (a & b))
        a, b, c, d, e, f, g, h = one + two, a, b, c, d + one, e, f, g
    return np.stack([x + y for x, y in zip(before, (a, b, c, d, e, f, g, h))], axis=1)


def fresh(n: int) -> np.ndarray:
    """States before the first block."""
    return np.tile(START, (n, 1))


def hex_blocks(digests: np.ndarray) -> np.ndarray:
    """Digests (n, 8) as the block that their hex text is."""
    raw = digests.astype(">u4").view(np.uint8).reshape(len(digests), 32)
    text = np.empty((len(raw), BLOCK), np.uint8)
    text[:, 0::2], text[:, 1::2] = HEX[raw >> 4], HEX[raw & 15]
    return text.view(">u4").astype(np.uint32)


def finish(states: np.ndarray, blocks: np.ndarray) -> np.ndarray:
    """Digests of messages of ``blocks`` (n) whole blocks, whose states these are."""
    last = np.zeros((len(states), 16), np.uint32)
    last[:, 0] = 1 << 31
    bits = blocks.astype(np.uint64) * np.uint64(8 * BLOCK)
    last[:, 14], last[:, 15] = (bits >> np.uint64(32)).astype(np.uint32), (bits & np.uint64(0xFFFFFFFF)).astype(np.uint32)
    return compress(states, last)


def pack(words: np.ndarray) -> bytes:
    return words.astype(">u4").tobytes()


def unpack(data: bytes) -> np.ndarray:
    """Digests or states (n, 8) out of ``pack``."""
    return np.frombuffer(data, ">u4").astype(np.uint32).reshape(-1, 8)
