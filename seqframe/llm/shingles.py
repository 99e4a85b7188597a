"""Word shingles of texts as fingerprints."""

from __future__ import annotations

import numpy as np
import xxhash

U = np.uint64
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_WEIGHTS = [U(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)]
_MAX_WORDS = 400_000


class _Words(dict):
    def __missing__(self, word: bytes) -> bytes:
        h = self[word] = xxhash.xxh3_64_digest(word)
        return h


class Shingler:
    """Distinct word shingles of a text as sorted 64-bit fingerprints; words are hashed once.

    A-Z are lower-cased. Words are what stands between space, tab, line feed,
    vertical tab, form feed and carriage return.
    """

    def __init__(self, length: int = 5):
        self.length = length
        self.words = _Words()

    def word_prints(self, text: str) -> np.ndarray:
        if len(self.words) > _MAX_WORDS:
            self.words.clear()
        words = text.encode("utf-8", "surrogatepass").translate(_LOWER).split()
        return np.frombuffer(b"".join(map(self.words.__getitem__, words)), ">u8").astype(U)

    def prints(self, text: str | None) -> np.ndarray:
        """Sorted distinct shingles; fewer words than a shingle's are one shingle, no word is none."""
        h = self.word_prints(text or "")
        n = min(self.length, len(h))
        if not n:
            return h
        s = np.full(len(h) - n + 1, U(n))
        for k in range(n):
            s = (s ^ (s >> U(31))) * _WEIGHTS[k % 5] + h[k:len(h) - n + 1 + k]
        s = (s ^ (s >> U(29))) * U(0xBF58476D1CE4E5B9)
        return np.unique(s ^ (s >> U(32)))


def set_print(prints: np.ndarray) -> int:
    """Signed 64-bit identity of a set of shingles."""
    h = xxhash.xxh3_64_intdigest(prints.tobytes())
    return h - (1 << 64) if h >> 63 else h
