"""Looking up the words of short known texts (benchmark items, license templates) in long ones."""

from __future__ import annotations

import re

import numpy as np

WORD = re.compile(r"\w+")
#: Odd multipliers, one per position of a seed.
_MIX = np.array([(0x9E3779B97F4A7C15 * (2 * i + 1)) & 0xFFFFFFFFFFFFFFFF | 1 for i in range(64)], np.uint64)


def words(text: str) -> list[str]:
    return WORD.findall(text.lower())


class Vocabulary:
    """Ids from 1 for the words of the known texts; any other word is 0 and matches nothing."""

    def __init__(self, texts: list[list[str]]):
        self.ids: dict[str, int] = {}
        for t in texts:
            for w in t:
                self.ids.setdefault(w, len(self.ids) + 1)

    def of(self, ws: list[str]) -> np.ndarray:
        get = self.ids.get
        return np.fromiter((get(w, 0) for w in ws), np.int64, len(ws))


def seed_hashes(ids: np.ndarray, mask: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    """Positions at which all words that the mask cares about are known, and the hashes of these words there. mask: offsets of the positions that count."""
    n = len(ids) - mask[-1]
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    known = ids > 0
    ok = known[mask[0] : mask[0] + n].copy()
    for o in mask[1:]:
        ok &= known[o : o + n]
    at = np.flatnonzero(ok)
    h = np.full(len(at), mask[-1] + 1, np.uint64)
    for k, o in enumerate(mask):
        h = (h ^ ids[at + o].astype(np.uint64)) * _MIX[k % 64]
        h ^= h >> np.uint64(32)
    return at, h


class SeedIndex:
    """Sorted hashes with (text, position) behind them."""

    def __init__(self, hashes: np.ndarray, text: np.ndarray, at: np.ndarray):
        order = np.argsort(hashes, kind="stable")
        self.hashes, self.text, self.at = hashes[order], text[order], at[order]

    def hits(self, at: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each hash that is in the index and each place it stands for: position in the long text, known text, position there."""
        lo = np.searchsorted(self.hashes, h, "left")
        found = lo < len(self.hashes)
        found[found] = self.hashes[lo[found]] == h[found]
        if not found.any():
            z = np.zeros(0, np.int64)
            return z, z, z
        at, lo, h = at[found], lo[found], h[found]
        n = np.searchsorted(self.hashes, h, "right") - lo
        which = np.repeat(lo, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        return np.repeat(at, n), self.text[which], self.at[which]
