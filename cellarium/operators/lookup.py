"""Finding cells: by id, point, indices, box and neighbor type."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import curve, geometry, mapping
from ..plans.grid import DEFAULT, Grid
from ..plans.shared import SMALL_ROWS, settle, small
from .neighbors import neighbors_of

#: Bits of a neighbor type: a cell in this one's neighborhood that is local, one that has this in its neighborhood and is local, and both for other owners.
LOCAL_OF, LOCAL_TO, REMOTE_OF, REMOTE_TO = 1, 2, 4, 8


def existing_at_indices(grid: Grid, points: DataFrame, index: tuple[Column, Column, Column], lo: int = 0, hi: int | None = None, name: str = "cell", tiled: bool = True, by: str | None = None) -> DataFrame:
    """points with the finest existing cell of levels lo to hi around the indices; 0 if there is none.

    by: "intervals" (see at_intervals) or "candidates"; default: candidates where the leaves are few enough to be broadcast, else intervals. Of candidates, where the leaves tile the grid
    and all levels are asked for, exactly one per point exists: an equi-join on exploded candidates; otherwise one left join per level, finest first."""
    hi = grid.meta.max_level if hi is None else hi
    if lo > hi:
        return points.withColumn(name, F.lit(0).cast("long"))
    ids = {k: F.coalesce(mapping.cell_at(grid.meta, index, F.lit(k)), F.lit(0).cast("long")) for k in range(lo, hi + 1)}
    if grid.uniform:
        return points.withColumn(name, ids[0] if lo == 0 else F.lit(0).cast("long"))
    if by not in (None, "intervals", "candidates"):
        raise ValueError(f"unknown way {by}")
    if goes_by_intervals(grid, by):
        return at_intervals(grid, points, index, lo, hi, name)
    leaf = grid.ids
    if tiled and lo == 0 and hi == grid.meta.max_level:
        # one more candidate, 0, stands for points outside the grid, so they need no branch of their own
        each = points.withColumn("__try", F.explode(F.when(ids[0] > 0, F.array(*ids.values())).otherwise(F.array(F.lit(0).cast("long")))))
        some = grid.cells.select("cell").unionByName(points.sparkSession.range(1).withColumnRenamed("id", "cell"))
        leaf = small(some, None if grid.leaves is None else grid.leaves + 1)
        return each.join(leaf.withColumnRenamed("cell", "__leaf"), F.col("__try") == F.col("__leaf")).withColumn(name, F.col("__leaf")).drop("__try", "__leaf")
    found = []
    for k in range(hi, lo - 1, -1):
        points = points.withColumn(f"__try{k}", ids[k]).join(leaf.withColumnRenamed("cell", f"__leaf{k}"), F.col(f"__try{k}") == F.col(f"__leaf{k}"), "left")
        found.append(f"__leaf{k}")
    out = points.withColumn(name, F.coalesce(*found, F.lit(0).cast("long")))
    return out.drop(*found, *[f"__try{k}" for k in range(lo, hi + 1)])


def goes_by_intervals(grid: Grid, by: str | None = None) -> bool:
    """Whether existing_at_indices goes by intervals, and so reads its points twice."""
    few = grid.leaves is not None and grid.leaves <= SMALL_ROWS
    return not grid.uniform and (by == "intervals" or by is None and not few and not curve.shift(grid.meta))


#: Points of one block from which on they are dealt to several tasks.
HOT_POINTS = 1_000_000


def at_intervals(grid: Grid, points: DataFrame, index: tuple[Column, Column, Column], lo: int = 0, hi: int | None = None, name: str = "cell", block_level: int = 0) -> DataFrame:
    """points with the existing cell of levels lo to hi around the indices; 0 if there is none.

    Leaves hold disjoint intervals of the space-filling curve, so a point's cell is that which starts last at or before its key, if it reaches as far. Leaves and points meet by
    blocks (cells of block_level, on which leaves of smaller levels are repeated) and are read once in the order of keys: one shuffle and one sort, however
    many levels there are. A block with more than HOT_POINTS points is dealt to several tasks, each with the block's leaves; points outside the grid are dealt out
    too. Points are read twice, first to count those of each block; settle them before where they are few but come from many rows."""
    meta = grid.meta
    hi = meta.max_level if hi is None else hi
    if curve.shift(meta):
        raise ValueError("indices of this grid are too long for keys; look candidates up instead")
    inside = F.lit(True)
    for i, n in zip(index, meta.extent):
        inside = inside & (i >= 0) & (i < n)
    down = 3 * (meta.max_level - block_level)
    row = F.monotonically_increasing_id()
    mine = points.withColumns({"__key": F.when(inside, curve.key(meta, index)), "__row": row}).withColumn("__block", mapping.shr(F.col("__key"), down))
    # blocks with many points, at most one per HOT_POINTS of them
    hot = settle(mine.groupBy("__block").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > HOT_POINTS).select("__block", F.ceil(F.col("n") / HOT_POINTS).alias("__deals")))
    # points outside have no block; a filter before settle would be pushed down to the rows that points are computed from, with the key and all in it
    hot = hot.filter("__block is not null")
    n = hot.count()
    hot = small(hot, n)
    leaf = grid.cells.filter(F.col("lvl").between(lo, hi)).select(F.col("cell").alias("__cell"), "lvl", curve.key(meta, (F.col("ix"), F.col("iy"), F.col("iz"))).alias("__key"))
    leaf = leaf.withColumn("__last", F.col("__key") + curve.keys_of_level(meta, F.col("lvl")) - 1)
    blocks = F.sequence(mapping.shr(F.col("__key"), down), mapping.shr(F.col("__last"), down))
    leaf = leaf.select("__cell", "__key", "__last", F.explode(blocks).alias("__block"))
    # a leaf that began in an earlier block begins anew in this one
    leaf = leaf.withColumn("__key", F.greatest("__key", mapping.shl(F.col("__block"), F.lit(down))))
    if n:
        mine = mine.join(hot, "__block", "left").withColumn("__deal", F.coalesce(F.pmod("__row", "__deals"), F.lit(0).cast("long")))
        leaf = leaf.join(hot, "__block", "left").withColumn("__deal", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("__deals", F.lit(1)) - 1))).drop("__deals")
        mine = mine.drop("__deals")
    else:
        mine, leaf = mine.withColumn("__deal", F.lit(0).cast("long")), leaf.withColumn("__deal", F.lit(0).cast("long"))
    mine = mine.withColumn("__block", F.coalesce("__block", -1 - F.pmod("__row", F.lit(1024)))).drop("__row")
    both = leaf.withColumn("__point", F.lit(0)).unionByName(mine.withColumn("__point", F.lit(1)), True)
    before = Window.partitionBy("__block", "__deal").orderBy("__key", "__point").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    last = F.last(F.when(F.col("__point") == 0, F.struct("__cell", "__last")), True).over(before)
    found = both.withColumn("__found", last).filter("__point = 1")
    cell = F.when(F.col("__key") <= F.col("__found.__last"), F.col("__found.__cell"))
    return found.withColumn("__cell", F.coalesce(cell, F.lit(0).cast("long"))).select(*[F.col(f"`{c}`") for c in points.columns if c != name], F.col("__cell").alias(name))


def existing_at_point(grid: Grid, points: DataFrame, x: str = "x", y: str = "y", z: str = "z", name: str = "cell") -> DataFrame:
    """points with the smallest existing cell around each; 0 outside the grid."""
    index = geometry.indices_at(grid.meta, (F.col(x), F.col(y), F.col(z)))
    indexed = points.withColumns({"__ix": index[0], "__iy": index[1], "__iz": index[2]})
    out = existing_at_indices(grid, indexed, (F.col("__ix"), F.col("__iy"), F.col("__iz")), name=name)
    return out.drop("__ix", "__iy", "__iz")


def cells_in_box(grid: Grid, low: tuple[int, int, int], high: tuple[int, int, int], lo: int = 0, hi: int | None = None) -> DataFrame:
    """Leaves of levels lo to hi that overlap a box of indices (both ends in it), each once; order by iz, iy, ix for the scan order. Where cells have their place on the curve (column key, see store.save_on_curve), the box is also given as ranges of it, so that a scan of a sorted table skips what is outside."""
    hi = grid.meta.max_level if hi is None else hi
    box = F.lit(False) if any(a > b for a, b in zip(low, high)) else F.col("lvl").between(lo, hi)
    if "key" in grid.cells.columns:
        box = curve.in_intervals(F.col("key"), curve.box_intervals(grid.meta, low, high)) & box
    for axis, a, b in zip(("ix", "iy", "iz"), low, high):
        box = box & (F.col(axis) <= b) & (F.col(axis) + F.col("len") > a)
    return grid.cells.filter(box)


def existing_parent(grid: Grid, ids: DataFrame, cell: str = "cell", name: str = "parent") -> DataFrame:
    """ids with the parent if it exists, else the cell if it exists, else 0."""
    return _existing(grid, ids, mapping.parent(grid.meta, F.col(cell)), cell, name)


def existing_child(grid: Grid, ids: DataFrame, cell: str = "cell", name: str = "child") -> DataFrame:
    """ids with the first child if it exists, else the cell if it exists, else 0."""
    return _existing(grid, ids, mapping.first_child(grid.meta, F.col(cell)), cell, name)


def _existing(grid: Grid, ids: DataFrame, other: Column, cell: str, name: str) -> DataFrame:
    leaf = grid.ids
    out = ids.withColumn("__other", other)
    out = out.join(leaf.withColumnRenamed("cell", "__a"), F.col("__other") == F.col("__a"), "left").join(leaf.withColumnRenamed("cell", "__b"), F.col(cell) == F.col("__b"), "left")
    return out.withColumn(name, F.coalesce("__a", "__b", F.lit(0).cast("long"))).drop("__other", "__a", "__b")


def owners(grid: Grid, ids: DataFrame, cell: str = "cell") -> DataFrame:
    """ids with the part that owns each cell; -1 for cells that don't exist."""
    own = small(grid.cells.select(F.col("cell").alias("__c"), F.col("part").alias("__p")), grid.leaves)
    return ids.join(own, F.col(cell) == F.col("__c"), "left").withColumn("part", F.coalesce("__p", F.lit(-1))).drop("__c", "__p")


def neighbor_types(grid: Grid, hood=DEFAULT) -> DataFrame:
    """cell, part, mask of neighbor types. One pass over the neighbor rows: each gives its bit to both of its ends, summed before the shuffle."""
    parts = small(grid.cells.select(F.col("cell").alias("nbr"), F.col("part").alias("n_part")), grid.leaves)
    near = neighbors_of(grid, hood, keep=("part",)).join(parts, "nbr")
    local = F.col("part") == F.col("n_part")
    both = F.array(F.struct(F.col("cell").alias("c"), F.when(local, LOCAL_OF).otherwise(REMOTE_OF).alias("bit")), F.struct(F.col("nbr").alias("c"), F.when(local, LOCAL_TO).otherwise(REMOTE_TO).alias("bit")))
    masks = near.select(F.explode(both).alias("e")).groupBy(F.col("e.c").alias("cell")).agg(F.bit_or("e.bit").alias("mask"))
    return grid.cells.join(masks, "cell", "left").select("cell", "part", F.coalesce("mask", F.lit(0)).alias("mask"))


def get_cells(grid: Grid, part: int | None = None, criteria: list[int] | None = None, exact: bool = False, hood=DEFAULT, ordered: bool = False) -> DataFrame:
    """Cells (of a part) whose neighbor type is one of criteria (exact), or shares a bit with any; all without criteria."""
    cells = grid.cells if part is None else grid.cells.filter(F.col("part") == part)
    if criteria:
        masks = neighbor_types(grid, hood)
        match = F.col("mask").isin(criteria) if exact else F.col("mask").bitwiseAND(F.lit(reduce(lambda a, b: a | b, criteria))) > 0
        cells = cells.join(masks.filter(match).select("cell"), "cell", "left_semi")
    return cells.orderBy("cell") if ordered else cells


def overlapping_part(grid: Grid, ids: DataFrame, part: int, level0: Grid, cell: str = "cell") -> DataFrame:
    """Those of ids whose ancestor of level 0 is the part's in level0."""
    own = level0.cells.filter(F.col("part") == part).select(F.col("cell").alias("__l0"))
    return ids.join(own, mapping.level0_parent(grid.meta, F.col(cell)) == F.col("__l0"), "left_semi")
