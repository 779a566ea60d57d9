"""Stencils over grids too large to broadcast, with one shuffle.

Space is cut into blocks of so many cells of level 0 to a side. Every leaf goes to its own block and, as a copy, to the blocks in which a leaf may list it
as a neighbor; all that a stencil needs then lies in its block. The leaves are shuffled once, by block, with the columns that stencils read, and written;
the joins of probes with leaves of the same size, of the next larger and of neighbors' columns, and the sums per cell are all by block and id, so they stay where the blocks are, for any number of stencils. Copies are as many as
the leaves near blocks' borders, so larger blocks mean fewer copies, smaller ones more tasks.

Spark joins on (block, id) without shuffling rows that are partitioned by block only if it may; settings are made for one job each, whose result is written.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import mapping
from ..plans.grid import DEFAULT, Grid
from ..plans.shared import settle
from .neighbors import neighbors_of, with_places

_AXES = ("ix", "iy", "iz")
BLOCK = "__block"


@contextmanager
def _set(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    before = spark.conf.get(key)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.set(key, before)


def joins_within_blocks(spark: SparkSession):
    """Plans made within it may join on (block, id) what is partitioned by block."""
    return _set(spark, "spark.sql.requireAllClusterKeysForCoPartition", "false")


def _sides(grid: Grid, side: int) -> list[int]:
    return [-(-n // side) for n in grid.meta.length]


def blocked(grid: Grid, columns: tuple[str, ...] = (), side: int = 8) -> DataFrame:
    """The leaves by block, shuffled once and written. The table keeps its partitioning only if it isn't changed at run time."""
    with _set(grid.cells.sparkSession, "spark.sql.adaptive.enabled", "false"):
        return settle(with_copies(grid, columns, side).repartition(BLOCK))


def with_copies(grid: Grid, columns: tuple[str, ...] = (), side: int = 8) -> DataFrame:
    """cell, lvl, ix, iy, iz, len, columns, __block and __own: leaves with their block, one row for the own block and one for each that may need a copy."""
    meta = grid.meta
    whole, counts = side << meta.max_level, _sides(grid, side)
    # whoever lists a leaf is at most twice as large
    reach = F.col("len") * (2 * max(1, meta.hood))
    spans = []
    for axis, n, extent, around in zip(_AXES, counts, meta.extent, meta.periodic):
        low, high = F.col(axis) - reach, F.col(axis) + F.col("len") - 1 + reach
        block = lambda i: mapping.div(i, whole)
        if around:
            first, last = F.pmod(low, F.lit(extent)), F.pmod(high, F.lit(extent))
            beyond = F.array_distinct(F.concat(F.sequence(block(first), F.lit(n - 1).cast("long")), F.sequence(F.lit(0).cast("long"), block(last))))
            everywhere = F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))
            spans.append(F.when(high - low + 1 >= extent, everywhere).when(first <= last, F.sequence(block(first), F.greatest(block(last), block(first)))).otherwise(beyond))
        else:
            spans.append(F.sequence(block(F.greatest(low, F.lit(0))), block(F.least(high, F.lit(extent - 1)))))
    rows = grid.cells.select("cell", "lvl", *_AXES, "len", *columns)
    for axis, span in zip(_AXES, spans):
        rows = rows.withColumn("__b" + axis, F.explode(span))
    x, y, _ = counts
    own = F.lit(True)
    for axis in _AXES:
        own = own & (F.col("__b" + axis) == mapping.div(F.col(axis), whole))
    block = F.col("__bix") + F.col("__biy") * x + F.col("__biz") * (x * y)
    return rows.select("cell", "lvl", *_AXES, "len", *columns, block.alias(BLOCK), own.alias("__own"))


def blocked_stencil(grid: Grid, aggregates: dict[str, Column], read: tuple[str, ...], hood=DEFAULT, own: tuple[str, ...] = (), side: int = 8) -> DataFrame:
    """What stencil gives (cell and aggregates over its neighbors), over blocks, written to the shared folder."""
    leaves = blocked(grid, tuple(dict.fromkeys((*read, *own))), side)
    with joins_within_blocks(grid.cells.sparkSession):
        return settle(stencil_in_blocks(grid, leaves, aggregates, read, hood, own))


def stencil_in_blocks(grid: Grid, leaves: DataFrame, aggregates: dict[str, Column], read: tuple[str, ...], hood=DEFAULT, own: tuple[str, ...] = ()) -> DataFrame:
    """The same over leaves that are blocked already, to be run within joins_within_blocks; nothing is shuffled."""
    local = Grid(grid.meta, leaves, grid.hoods, uniform=grid.uniform)
    near = neighbors_of(local, hood, cells=leaves.filter("__own"), keep=(*own, BLOCK), within=(BLOCK,))
    near = with_places(local, near, read, within=(BLOCK,))
    return near.groupBy(BLOCK, "cell").agg(*[v.alias(k) for k, v in aggregates.items()]).drop(BLOCK)
