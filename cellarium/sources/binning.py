"""From rows of any table to cells: lattice indices become the finest cell, or a leaf of a refined grid."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import mapping
from ..functions.meta import GridMeta
from ..operators.adapt import adapt
from ..operators.lookup import existing_at_indices, goes_by_intervals
from ..plans.grid import Grid
from ..plans.shared import settle

_INDEX = ("ix", "iy", "iz")


def binned(df: DataFrame, meta: GridMeta, index: tuple[Column, Column, Column], level: int | None = None, name: str = "cell") -> DataFrame:
    """df with the cell of a level (default: the finest) at lattice indices; 0 outside."""
    return df.withColumn(name, mapping.cell_at(meta, index, F.lit(meta.max_level if level is None else level)))


def to_leaves(grid: Grid, df: DataFrame, index: tuple[Column, Column, Column], name: str = "cell", by: str | None = None) -> DataFrame:
    return existing_at_indices(grid, df, index, name=name, by=by)


def sums_per_point(df: DataFrame, index: tuple[Column, Column, Column], sums: dict[str, Column]) -> DataFrame:
    """ix, iy, iz and sums over the rows of each lattice point. Settle them where several grids are counted by them, so the table is read once."""
    return df.groupBy(*[i.alias(n) for n, i in zip(_INDEX, index)]).agg(*[F.sum(v).alias(k) for k, v in sums.items()])


def point_sums_per_leaf(grid: Grid, points: DataFrame, by: str | None = None) -> DataFrame:
    """cell and sums over the points (see sums_per_point) of each leaf (cell 0: points outside the grid)."""
    sums = [c for c in points.columns if c not in _INDEX]
    return to_leaves(grid, points, tuple(F.col(n) for n in _INDEX), by=by).groupBy("cell").agg(*[F.sum(k).alias(k) for k in sums])


def sums_per_leaf(grid: Grid, df: DataFrame, index: tuple[Column, Column, Column], sums: dict[str, Column], by: str | None = None) -> DataFrame:
    """cell and sums over the rows of each leaf (cell 0: rows outside the grid). Rows are summed by lattice point before they are looked up, so what is joined does not grow with the table, and the table is read once."""
    points = sums_per_point(df, index, sums)
    return point_sums_per_leaf(grid, settle(points) if goes_by_intervals(grid, by) else points, by)


def refined_by_count(grid: Grid, df: DataFrame, index: tuple[Column, Column, Column], dense: Column) -> Grid:
    """grid with those leaves refined whose rows meet dense, a condition on n (rows of the leaf) and total."""
    return refined_by_sums(grid, sums_per_leaf(grid, df, index, {"n": F.lit(1)}), dense)


def refined_by_sums(grid: Grid, sums: DataFrame, dense: Column) -> Grid:
    """The same by rows per leaf (cell, n) that are there already."""
    counts = settle(sums.select("cell", "n"))
    total = counts.agg(F.sum("n")).first()[0] or 0
    return adapt(grid, refine=counts.withColumn("total", F.lit(total)).filter(dense).select("cell")).grid
