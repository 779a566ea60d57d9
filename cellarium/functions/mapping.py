"""Cell ids, levels and indices as column expressions: arithmetic and shifts only, so they stay in generated code."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .meta import GridMeta

Index = tuple[Column, Column, Column]


def _long(x) -> Column:
    return x.cast("long") if isinstance(x, Column) else F.expr(f"{x}L")


def _int(x) -> Column:
    return x.cast("int") if isinstance(x, Column) else F.lit(x)


def div(a: Column, b) -> Column:
    """Integer division."""
    return F.call_function("div", _long(a), _long(b))


def shl(a, b) -> Column:
    return F.call_function("shiftleft", _long(a), _int(b))


def shr(a, b) -> Column:
    return F.call_function("shiftright", _long(a), _int(b))


def let(value: Column, use) -> Column:
    """use(value), with value computed once where it would be repeated many times over."""
    return F.transform(F.array(value), use)[0]


def cells_before(meta: GridMeta, level: Column) -> Column:
    """Number of possible cells of smaller levels than one from 0 to the largest: n (8^level - 1) / 7."""
    n = meta.level0_cells
    return div(shl(n, level * 3) - n, 7)


def level_of(meta: GridMeta, cell: Column) -> Column:
    """Refinement level, -1 for ids that are no cell's."""
    level = sum(((cell > meta.cells_before(k)).cast("int") for k in range(1, meta.max_level + 1)), F.lit(0))
    return F.when((cell >= 1) & (cell <= meta.last_cell), level).otherwise(-1)


def length_in_indices(meta: GridMeta, level: Column) -> Column:
    return F.when(level >= 0, shl(1, F.lit(meta.max_level) - level))


def indices_of(meta: GridMeta, cell: Column, level: Column | None = None) -> Index:
    """Indices of the cell's corner nearest the origin; null for ids that are no cell's. level: the cell's, if it is at hand as a column."""
    level = level_of(meta, cell) if level is None else level
    x, y, _ = meta.length
    rest, step = F.when(level >= 0, cell - 1 - cells_before(meta, level)), F.lit(meta.max_level) - level
    return shl(rest % shl(x, level), step), shl(div(rest, shl(x, level)) % shl(y, level), step), shl(div(rest, shl(x * y, level * 2)), step)


def cell_at(meta: GridMeta, index: Index, level: Column) -> Column:
    """The cell of a level at given indices; 0 outside the grid or its levels."""
    inside = (level >= 0) & (level <= meta.max_level)
    for i, n in zip(index, meta.extent):
        inside = inside & (i >= 0) & (i < n)
    return F.when(inside, cell_inside(meta, index, level)).otherwise(_long(0))


def cell_inside(meta: GridMeta, index: Index, level: Column) -> Column:
    """cell_at for indices and a level known to be in the grid."""
    x, y, _ = meta.length
    level, down = _int(level), _int(F.lit(meta.max_level) - level)
    i, j, k = (F.call_function("shiftright", c, down) for c in index)
    return cells_before(meta, level) + 1 + i + j * shl(x, level) + k * shl(x * y, level * 2)


def children_inside(meta: GridMeta, first: Column, level: Column) -> list[Column]:
    """The eight children of a cell of a level below the largest, from the first: a step in y is a row, one in z a plane of the next level."""
    x, y, _ = meta.length
    wide, plane = shl(2 * x, level), shl(4 * x * y, level * 2)
    return [first, first + 1, first + wide, first + wide + 1, first + plane, first + plane + 1, first + plane + wide, first + plane + wide + 1]


def parent_at(meta: GridMeta, cell: Column, level: Column, index: Index) -> Column:
    """The parent of a cell whose level and indices are at hand; the cell itself at level 0."""
    return F.when(level > 0, cell_at(meta, index, level - 1)).otherwise(cell)


def parent(meta: GridMeta, cell: Column) -> Column:
    """The cell itself at level 0, 0 for no cell."""
    return let(_place(meta, cell), lambda p: F.when(p["lvl"] >= 0, parent_at(meta, p["cell"], p["lvl"], _index(p))).otherwise(F.lit(0).cast("long")))


def first_child(meta: GridMeta, cell: Column) -> Column:
    """The cell itself at the largest level, 0 for no cell."""
    return let(_place(meta, cell), lambda p: F.when(p["lvl"] == meta.max_level, p["cell"]).when(p["lvl"] >= 0, cell_at(meta, _index(p), p["lvl"] + 1)).otherwise(F.lit(0).cast("long")))


def children_at(meta: GridMeta, index: Index, level: Column) -> list[Column]:
    """The eight children of the cell of a level at given indices, x fastest, then y, z; zeros at the largest level."""
    half = shr(1 << meta.max_level, level + 1)
    return [cell_at(meta, tuple(c + half if k >> d & 1 else c for d, c in enumerate(index)), level + 1) for k in range(8)]


def children(meta: GridMeta, cell: Column) -> Column:
    """Array of the eight children; zeros where there are none."""
    return let(_place(meta, cell), lambda p: F.array(*children_at(meta, _index(p), F.when(p["lvl"] >= 0, p["lvl"]).otherwise(F.lit(meta.max_level)))))


def siblings(meta: GridMeta, cell: Column) -> Column:
    """Array of the parent's children; at level 0 the cell and zeros."""

    def of(p: Column) -> Column:
        two = shr(2 << meta.max_level, p["lvl"])  # length of the parent
        corner = tuple(c - c % two for c in _index(p))
        none = [_long(0)] * 7
        return F.when(p["lvl"] > 0, F.array(*children_at(meta, corner, p["lvl"] - 1))).otherwise(F.array(F.when(p["lvl"] == 0, p["cell"]).otherwise(F.lit(0).cast("long")), *none))

    return let(_place(meta, cell), of)


def level0_parent(meta: GridMeta, cell: Column) -> Column:
    return let(_place(meta, cell), lambda p: cell_at(meta, _index(p), F.when(p["lvl"] >= 0, F.lit(0)).otherwise(-1)))


def _place(meta: GridMeta, cell: Column) -> Column:
    """cell, lvl, ix, iy, iz."""

    def of(p: Column) -> Column:
        at = F.when(p["lvl"] >= 0, p["lvl"])
        return F.struct(p["cell"].alias("cell"), p["lvl"].alias("lvl"), *[i.alias(n) for i, n in zip(indices_of(meta, p["cell"], at), ("ix", "iy", "iz"))])

    return let(F.struct(_long(cell).alias("cell"), level_of(meta, cell).alias("lvl")), of)


def _index(p: Column) -> Index:
    return p["ix"], p["iy"], p["iz"]


def with_place(df: DataFrame, meta: GridMeta, cell: str = "cell", prefix: str = "") -> DataFrame:
    """df with lvl, ix, iy, iz, len of its cells as columns, each computed once and in generated code: what plans over many rows use. Indices and length are null for ids that are no cell's."""
    df = df.withColumn(prefix + "lvl", level_of(meta, F.col(cell)))
    at = F.when(F.col(prefix + "lvl") >= 0, F.col(prefix + "lvl"))
    return df.withColumns({**{prefix + n: i for n, i in zip(("ix", "iy", "iz"), indices_of(meta, F.col(cell), at))}, prefix + "len": length_in_indices(meta, F.col(prefix + "lvl"))})


def ancestor(meta: GridMeta, index: Index, level: int | Column) -> Column:
    """The cell of a level around indices known to be in the grid."""
    return cell_inside(meta, index, F.lit(level) if isinstance(level, int) else level)


def overlap_1d(a: Column, a_len: Column, b: Column, b_len: Column) -> Column:
    return (a < b + b_len) & (b < a + a_len)


def overlapping_dimensions(a: Index, a_len: Column, b: Index, b_len: Column) -> Column:
    return sum((overlap_1d(i, a_len, j, b_len).cast("int") for i, j in zip(a, b)), F.lit(0))


def indices_overlap(a: Index, a_len: Column, b: Index, b_len: Column) -> Column:
    return overlapping_dimensions(a, a_len, b, b_len) == 3


def is_neighbor(meta: GridMeta, a: Index, a_len: Column, b: Index, b_len: Column) -> Column:
    """Whether b would be in a's default neighborhood, from geometry alone; distances go around periodic dimensions."""
    gaps = []
    for i, j, n, around in zip(a, b, meta.extent, meta.periodic):
        gap = F.greatest(j - (i + a_len), i - (j + b_len), F.lit(0).cast("long"))
        if around:
            gap = F.least(gap, F.greatest(F.lit(n) - F.greatest(i + a_len, j + b_len) + F.least(i, j), F.lit(0).cast("long")))
        gaps.append(gap)
    if meta.hood == 0:
        return (F.greatest(*gaps) < a_len) & (overlapping_dimensions(a, a_len, b, b_len) >= 2)
    return F.greatest(*gaps) < a_len * meta.hood


#: Numbers of seven bits with two empty bits after each.
_SPREAD = [sum((v >> b & 1) << 3 * b for b in range(7)) for v in range(128)]


def z_order(index: Index) -> Column:
    """Morton key of indices below 2^21. Seven bits at a time from a table: shifting and masking in place would name each index 32 times, and with it all that it is computed from where Spark inlines it."""
    table = F.expr(f"array({', '.join(f'{v}L' for v in _SPREAD)})")

    def spread(v: Column) -> Column:
        # get gives null for null, where brackets would raise
        low, mid, high = (F.get(table, shr(v, k).bitwiseAND(_long(127))) for k in (0, 7, 14))
        return low.bitwiseOR(shl(mid, 21)).bitwiseOR(shl(high, 42))

    x, y, z = (spread(_long(c)) for c in index)
    return x.bitwiseOR(shl(y, 1)).bitwiseOR(shl(z, 2))
