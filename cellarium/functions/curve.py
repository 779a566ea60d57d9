"""Places on the space-filling curve: keys of cells, the interval of keys that a cell holds, and boxes as few intervals.

A leaf of a level is an aligned block of smallest cells, so the Morton keys of what it holds are one interval that starts with its
corner's; leaves that don't overlap hold disjoint intervals. In a table sorted by key, a box is a few ranges of rows.
"""

from __future__ import annotations

import heapq

from pyspark.sql import Column
from pyspark.sql import functions as F

from .mapping import Index, shl, shr, z_order
from .meta import GridMeta

#: Bits of an index that a key of 63 bits holds.
BITS = 21

Interval = tuple[int, int]


def shift(meta: GridMeta) -> int:
    """By how many bits indices are too long for a key; keys then tell blocks of so many halvings apart."""
    return max(0, max((n - 1).bit_length() for n in meta.extent) - BITS)


def key(meta: GridMeta, index: Index) -> Column:
    by = shift(meta)
    return z_order(tuple(shr(i, by) for i in index) if by else index)


def keys_of_level(meta: GridMeta, level: Column) -> Column:
    """How many keys a cell of a level holds; 1 where cells are smaller than what a key tells apart."""
    return shl(1, F.greatest(F.lit(meta.max_level - shift(meta)) - level, F.lit(0)) * 3)


def interleaved(x: int, y: int, z: int) -> int:
    return sum(((v >> b) & 1) << (3 * b + d) for d, v in enumerate((x, y, z)) for b in range(BITS))


def box_intervals(meta: GridMeta, low: tuple[int, int, int], high: tuple[int, int, int], most: int = 64) -> list[Interval]:
    """Ascending intervals (both ends in them) of the keys that cells overlapping a box of indices (both ends in it) can start with. The octree over the keys is split, larger blocks first, at most so often; blocks that are not split any more are taken whole, so intervals may hold other cells too."""
    by = shift(meta)
    low, high = [max(0, v) >> by for v in low], [min(n - 1, v) >> by for v, n in zip(high, meta.extent)]
    if any(a > b for a, b in zip(low, high)):
        return []
    top = max((n - 1) >> by for n in meta.extent).bit_length()
    largest = max(0, meta.max_level - by)  # a leaf is at most so large
    heap, found = [(-top, (0, 0, 0))], []
    while heap:
        size, corner = heapq.heappop(heap)
        size = -size
        n, start = 1 << size, interleaved(*corner)
        if any(c > b or c + n <= a for c, a, b in zip(corner, low, high)):
            continue
        if size == 0 or most <= 0 or all(c >= a and c + n - 1 <= b for c, a, b in zip(corner, low, high)):
            found.append((start, start + n**3 - 1))
            continue
        most -= 1
        if size <= largest:
            found.append((start, start))  # the block may be a leaf
        half = n >> 1
        for k in range(8):
            heapq.heappush(heap, (1 - size, tuple(c + half * (k >> d & 1) for d, c in enumerate(corner))))
    out: list[Interval] = []
    for a, b in sorted(found):
        if out and a <= out[-1][1] + 1:
            out[-1] = out[-1][0], max(b, out[-1][1])
        else:
            out.append((a, b))
    return out


def in_intervals(k: Column, intervals: list[Interval]) -> Column:
    """Whether a key is in one of some intervals, as comparisons that scans can use."""
    each = [(k >= a) & (k <= b) if a < b else k == a for a, b in intervals]
    while len(each) > 1:
        each = [x | y for x, y in zip(each[::2], each[1::2])] + ([each[-1]] if len(each) % 2 else [])
    return each[0] if each else F.lit(False)
