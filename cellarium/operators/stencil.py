"""Aggregates over neighborhoods and over the grid."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import mapping
from ..plans.grid import DEFAULT, Grid
from .neighbors import face_neighbors, neighbors_of, with_places


def stencil(grid: Grid, aggregates: dict[str, Column], read: tuple[str, ...], hood=DEFAULT, own: tuple[str, ...] = (), distinct: bool = False) -> DataFrame:
    """cell and aggregates over its neighbors. Expressions see n_<column> for read columns of the neighbor, own columns of the cell, ox, oy, oz, nlen, nlvl. distinct: count a larger neighbor once, not once per offset that reaches it."""
    near = neighbors_of(grid, hood, keep=own)
    if distinct:
        near = near.dropDuplicates(["cell", "nbr"])
    near = with_places(grid, near, read)
    return near.groupBy("cell").agg(*[v.alias(k) for k, v in aggregates.items()])


def face_stencil(grid: Grid, aggregates: dict[str, Column], read: tuple[str, ...], own: tuple[str, ...] = ()) -> DataFrame:
    """The same over face neighbors, with their direction."""
    return with_places(grid, face_neighbors(grid, keep=own), read).groupBy("cell").agg(*[v.alias(k) for k, v in aggregates.items()])


def max_difference(grid: Grid, column: str, threshold: float) -> DataFrame:
    """cell, max_diff: the largest relative difference to a face neighbor, |a - b| / (min(a, b) + threshold), with pairs seen from both sides."""
    a, b = F.col(column), F.col(f"n_{column}")
    return face_stencil(grid, {"max_diff": F.max(F.abs(a - b) / (F.least(a, b) + threshold))}, (column,), (column,))


def level0_stencil(grid: Grid, aggregates: dict[str, Column], read: tuple[str, ...], hood=DEFAULT) -> DataFrame:
    """Aggregates per ancestor of level 0 over its neighboring ancestors of level 0, each once: what a refined grid must give like the grid it was refined from. Expressions see n_<column>, of any leaf of the ancestor."""
    meta = grid.meta
    near = with_places(grid, neighbors_of(grid, hood), read)
    pairs = near.select(mapping.level0_parent(meta, F.col("cell")).alias("l0"), mapping.level0_parent(meta, F.col("nbr")).alias("nbr_l0"), *[f"n_{c}" for c in read])
    pairs = pairs.filter("l0 <> nbr_l0").groupBy("l0", "nbr_l0").agg(*[F.max(f"n_{c}").alias(f"n_{c}") for c in read])
    return pairs.groupBy("l0").agg(*[v.alias(k) for k, v in aggregates.items()])


def pyramid(grid: Grid, aggregates: dict[str, Column], level: int) -> DataFrame:
    """Aggregates of the leaves at or below a level, per cell of that level."""
    up = grid.cells.filter(F.col("lvl") >= level).withColumn("up", mapping.ancestor(grid.meta, (F.col("ix"), F.col("iy"), F.col("iz")), level))
    return up.groupBy(F.col("up").alias("cell")).agg(*[v.alias(k) for k, v in aggregates.items()])


def level_pyramid(grid: Grid, aggregates: dict[str, Column]) -> DataFrame:
    """Aggregates for every level: cell, lvl and aggregates over all leaves in the cell. One scan; a leaf counts in each of its ancestors and itself."""
    index = (F.col("ix"), F.col("iy"), F.col("iz"))
    ups = F.array(*[F.when(F.col("lvl") >= k, F.struct(F.lit(k).alias("up_lvl"), mapping.ancestor(grid.meta, index, k).alias("up"))) for k in range(grid.meta.max_level + 1)])
    each = grid.cells.withColumn("__up", F.explode(ups)).filter("__up is not null")
    return each.groupBy(F.col("__up.up").alias("cell"), F.col("__up.up_lvl").alias("lvl")).agg(*[v.alias(k) for k, v in aggregates.items()])


def p_norm(df: DataFrame, value: Column, p: float) -> DataFrame:
    """norm: (sum |value|^p)^(1/p)."""
    return df.agg(F.pow(F.sum(F.pow(F.abs(value), F.lit(float(p)))), F.lit(1.0 / p)).alias("norm"))


def neighbor_part_sums(grid: Grid, value: Column, hood=DEFAULT) -> DataFrame:
    """part, total: the sum of value over a part and the parts that it exchanges cells with."""
    from .boundary import neighbor_parts

    sums = grid.cells.groupBy("part").agg(F.sum(value).alias("s"))
    links = neighbor_parts(grid, hood).union(grid.cells.select("part", F.col("part").alias("nbr_part")).distinct())
    return links.join(sums.withColumnRenamed("part", "nbr_part"), "nbr_part").groupBy("part").agg(F.sum("s").alias("total"))


def balance(grid: Grid) -> DataFrame:
    """part, cells, weight."""
    return grid.cells.groupBy("part").agg(F.count(F.lit(1)).alias("cells"), F.sum("weight").alias("weight"))
