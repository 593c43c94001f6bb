"""Seeded generator on unsigned 32-bit words, in numpy: many streams side by side.

Fixed values: the constants of splitmix32, xoshiro128** and the string hash.
"""

from __future__ import annotations

import numpy as np

GOLDEN = np.uint32(0x9E3779B9)
MIX_1 = np.uint32(0x85EBCA6B)
MIX_2 = np.uint32(0xC2B2AE35)
HASH_START = 5381


def string_hash(text: str) -> int:
    """Unsigned 32-bit hash over UTF-16 units."""
    h = HASH_START
    raw = text.encode("utf-16-le", "surrogatepass")
    for unit in np.frombuffer(raw, "<u2").tolist():
        h = (h * 33 & 0xFFFFFFFF) ^ unit
    return h


def _rotated(x: np.ndarray, k: int) -> np.ndarray:
    return x << np.uint32(k) | x >> np.uint32(32 - k)


class Streams:
    """One generator for each seed; every draw gives an array with an element for each."""

    def __init__(self, seeds):
        seed = np.array([string_hash(s) if isinstance(s, str) else int(s) & 0xFFFFFFFF for s in seeds], np.uint32)
        words = []
        for _ in range(4):
            seed = seed + GOLDEN
            z = (seed ^ seed >> np.uint32(16)) * MIX_1
            z = (z ^ z >> np.uint32(13)) * MIX_2
            words.append(z ^ z >> np.uint32(16))
        self.words = words

    def uint32(self) -> np.ndarray:
        a, b, c, d = self.words
        out = _rotated(b * np.uint32(5), 7) * np.uint32(9)
        shifted = b << np.uint32(9)
        c, d = c ^ a, d ^ b
        b, a = b ^ c, a ^ d
        self.words = [a, b, c ^ shifted, _rotated(d, 11)]
        return out

    def floats(self) -> np.ndarray:
        """In [0, 1)."""
        return self.uint32() / 4294967296.0

    def integers(self, low: int, high: int) -> np.ndarray:
        """In [low, high] by remainder; the full 32-bit range has no remainder and gives NaN."""
        span = (high - low + 1) & 0xFFFFFFFF
        drawn = self.uint32().astype(np.int64)
        return low + drawn % span if span else np.full(len(drawn), np.nan)

    @property
    def state(self) -> list[str]:
        """32 hex digits for each stream."""
        return ["".join(f"{int(w):08x}" for w in words) for words in zip(*self.words)]

    @state.setter
    def state(self, states: list[str]) -> None:
        self.words = [np.array([int(s[8 * k : 8 * k + 8], 16) for s in states], np.uint32) for k in range(4)]
