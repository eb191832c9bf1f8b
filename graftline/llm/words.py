"""Words of many texts at once: hashes and places found by array arithmetic over the joined bytes.

A word is a run of letters and digits (ASCII, lower-cased A-Z) and of bytes from 0x80 on."""
from __future__ import annotations

from dataclasses import dataclass

import numpy as np

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IN_WORD = np.zeros(256, bool)
_IN_WORD[48:58] = _IN_WORD[97:123] = _IN_WORD[128:] = True
_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INVERSE = pow(_BASE, -1, 2**64)
_powers: dict[int, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """Scatter the bits of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64; the last table is kept, as most slices have about one size."""
    held = _powers.get(base)
    if held is None or len(held) < n:
        held = np.full(max(n, 1 << 16), base, np.uint64)
        held[0] = 1
        held = np.multiply.accumulate(held)
        if len(held) <= 1 << 23:
            _powers[base] = held
    return held[:n]


def lower(text: bytes) -> np.ndarray:
    return _LOWER[np.frombuffer(text, np.uint8)]


@dataclass
class Words:
    """Words of a slice of texts in order: 64-bit hash, text number, byte places in the joined text, and where each text's words begin."""

    hashes: np.ndarray
    text: np.ndarray
    begin: np.ndarray
    end: np.ndarray
    first: np.ndarray  # first word of each text, and the number of all words at the end
    raw: bytes

    def window(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all runs of k words of one text, and the number of each run's first word."""
        n = len(self.hashes) - k + 1
        if n <= 0:
            return np.empty(0, np.uint64), np.empty(0, np.int64)
        h = np.zeros(n, np.uint64)
        for i, c in enumerate(powers(0xD6E8FEB86659FD93, k)):
            h += self.hashes[i:n + i] * c
        at = np.flatnonzero(self.text[:n] == self.text[k - 1:])
        return mix(h[at]), at


def words(texts: list[bytes]) -> Words:
    raw = b"\n".join([*texts, b""])
    low = lower(raw)
    inside = _IN_WORD[low]
    change = np.diff(inside.astype(np.int8), prepend=0, append=0)
    begin, end = np.flatnonzero(change == 1), np.flatnonzero(change == -1)
    upto = np.zeros(len(low) + 1, np.uint64)
    np.cumsum((low.astype(np.uint64) + np.uint64(1)) * powers(_BASE, len(low)), out=upto[1:])
    hashes = mix((upto[end] - upto[begin]) * powers(_BASE_INVERSE, len(low) + 1)[begin] + (end - begin).astype(np.uint64))
    starts = np.r_[0, np.cumsum([len(t) + 1 for t in texts])].astype(np.int64)
    first = np.searchsorted(begin, starts)
    text = np.repeat(np.arange(len(texts)), np.diff(first))
    return Words(hashes, text, begin, end, first, raw)


def hash_words(listed: list[bytes]) -> np.ndarray:
    """Hashes of single words, the same as inside texts."""
    return words([b" ".join(listed)]).hashes
