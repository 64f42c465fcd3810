"""Hashed word shingles of whole texts, shared by the operators that need them."""

from __future__ import annotations

import numpy as np
import xxhash

from .common import kept

_STEP = np.uint64(0x9E3779B97F4A7C15)


def _mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit (splitmix finaliser)."""
    x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return x ^ x >> np.uint64(31)


class Shingler:
    """Sets of ``width``-word shingles as sorted 64-bit hashes.

    A-Z are lower-cased and words are runs of bytes other than 20 and 09-0D. A
    text of fewer words has its whole sequence as its one shingle; one without
    words has none. Hashes of words met are kept, up to ``keep``.
    """

    def __init__(self, width: int, keep: int = 100_000):
        self.width, self.keep, self.known = width, keep, {}

    def words(self, text: str | None) -> np.ndarray:
        words, known = (text or "").encode("utf-8", "surrogatepass").lower().split(), self.known
        missing = {w for w in words if w not in known}
        if missing:
            if len(known) + len(missing) > self.keep and known:
                known.clear()
                missing = set(words)
            known.update((w, xxhash.xxh3_64_intdigest(w)) for w in missing)
        return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))

    def __call__(self, text: str | None) -> np.ndarray:
        h = self.words(text)
        if not len(h):
            return h
        n = max(1, len(h) - self.width + 1)
        acc = np.full(n, min(len(h), self.width), np.uint64)
        for i in range(min(self.width, len(h))):
            acc = _mixed(acc * _STEP + h[i : i + n])
        return np.unique(acc)


def shingler(width: int) -> Shingler:
    """One for each width and worker process, which keeps the words it has met from task to task."""
    return kept(("shingles", width), lambda: Shingler(width))
