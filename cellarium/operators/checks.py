"""Invariants of a grid as queries: each gives the rows that break it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import mapping
from ..plans.grid import DEFAULT, Grid
from .neighbors import neighbors_of, neighbors_to, with_places


def level_jumps(grid: Grid) -> DataFrame:
    """Neighbors whose levels differ by more than one."""
    return with_places(grid, neighbors_of(grid, keep=("lvl",))).filter(F.abs(F.col("lvl") - F.col("nlvl")) > 1)


def overlapping_leaves(grid: Grid) -> DataFrame:
    """Leaves that an ancestor of theirs also is."""
    index = (F.col("ix"), F.col("iy"), F.col("iz"))
    ups = F.array(*[F.when(F.col("lvl") > k, mapping.ancestor(grid.meta, index, k)) for k in range(max(1, grid.meta.max_level))])
    return grid.cells.select("cell", F.explode(ups).alias("up")).filter("up is not null").join(grid.cells.select(F.col("cell").alias("up")), "up", "left_semi")


def volume(grid: Grid) -> DataFrame:
    """volume and expected, in smallest possible cells: equal if the leaves tile the grid."""
    x, y, z = grid.meta.extent
    return grid.cells.agg(F.sum(F.col("len") * F.col("len") * F.col("len")).alias("volume")).withColumn("expected", F.lit(x * y * z).cast("long"))


def missing_neighbors(grid: Grid, hood=DEFAULT) -> DataFrame:
    """Listed neighbors that don't exist."""
    return neighbors_of(grid, hood).join(grid.cells.select(F.col("cell").alias("nbr")), "nbr", "left_anti")


def one_sided(grid: Grid, hood=DEFAULT) -> DataFrame:
    """Pairs in one of the two lists only; none if they agree."""
    of = neighbors_of(grid, hood).select("cell", "nbr").distinct()
    to = neighbors_to(grid, hood).select(F.col("nbr").alias("cell"), F.col("cell").alias("nbr"))
    return of.exceptAll(to).union(to.exceptAll(of))


def unmet_pins(grid: Grid) -> DataFrame:
    return grid.cells.filter("pin is not null and pin <> part")


def bad_places(grid: Grid) -> DataFrame:
    """Ids that are no cell's, or whose stored places are wrong."""
    ix, iy, iz = mapping.indices_of(grid.meta, F.col("cell"))
    return grid.cells.filter((mapping.level_of(grid.meta, F.col("cell")) != F.col("lvl")) | F.col("lvl").isNull() | (F.col("lvl") < 0) | (ix != F.col("ix")) | (iy != F.col("iy")) | (iz != F.col("iz")))
