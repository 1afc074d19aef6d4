"""Word shingles of texts as sets of 64-bit numbers, in numpy."""

from __future__ import annotations

import hashlib

import numpy as np
import xxhash

from packlens.llm.common import lower_ascii, words_of

SHINGLE = 5
_KNOWN_WORDS = 500_000
_MIX = np.random.default_rng(11).integers(1, 2**63, 16, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def mixed(x: np.ndarray) -> np.ndarray:
    """A fixed one-to-one scrambling of 64-bit numbers."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x9E3779B97F4A7C15)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


class Shingler:
    """Shingle sets of texts; keeps the numbers of words it has met, up to a bound."""

    def __init__(self, size: int = SHINGLE) -> None:
        self.size = size
        self.known: dict[str, int] = {}

    def _word(self, word: str) -> int:
        if len(self.known) >= _KNOWN_WORDS:
            self.known.clear()
        n = self.known[word] = xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"))
        return n

    def set_of(self, text: str | None) -> np.ndarray:
        """Sorted distinct shingles; with fewer words than a shingle has, one for the whole sequence; else none."""
        words = words_of(lower_ascii(text)) if text else []
        if not words:
            return np.empty(0, np.uint64)
        known, new = self.known, self._word
        ids = np.fromiter([known.get(w) or new(w) for w in words], np.uint64, len(words))
        width = min(self.size, len(words))
        total = np.full(len(words) - width + 1, width, np.uint64)
        for j in range(width):
            total += ids[j : len(ids) - width + 1 + j] * _MIX[j]
        return np.unique(mixed(total))


class Signer:
    """Min-hash signatures: coordinate k is the least value that permutation k gives to a shingle."""

    def __init__(self, coordinates: int, seed: int = 5) -> None:
        self.factor = np.random.default_rng(seed).integers(1, 2**62, coordinates, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

    def sign(self, shingles: np.ndarray) -> np.ndarray:
        out = np.full(len(self.factor), 2**64 - 1, np.uint64)
        for at in range(0, len(shingles), 2048):
            part = shingles[at : at + 2048]
            np.minimum(out, (self.factor[:, None] * part[None, :]).min(axis=1), out=out)
        return (out >> np.uint64(32)).astype(np.uint32)


def digest_of(shingles: np.ndarray) -> bytes:
    """Sixteen bytes that stand for the whole set."""
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()
