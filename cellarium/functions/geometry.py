"""Coordinates of cells and cells of coordinates, for the three geometries. Intervals are half-open: an inner edge belongs to the upper cell, the end of the grid to none."""

from __future__ import annotations

import json

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .mapping import Index, cell_at, div, indices_of, level_of, shl
from .meta import Cartesian, GridMeta, Stretched

Point = tuple[Column, Column, Column]


def _level0(meta: GridMeta) -> tuple[float, float, float]:
    return meta.geometry.level0_length if isinstance(meta.geometry, Cartesian) else (1.0, 1.0, 1.0)


#: Edges of a dimension from which on they are a table that a plan reads once, not part of its expressions.
MANY_EDGES = 64


def _edges(edges: tuple[float, ...]) -> Column:
    """The edges as an array: a literal if they are few, else the result of a scalar subquery, which is sent to tasks once and shown by name in plans."""
    if len(edges) < MANY_EDGES:
        return F.lit([float(e) for e in edges])
    table = SparkSession.active().createDataFrame(pa.table({"edges": pa.array([edges], pa.list_(pa.float64()))}))
    return table.select("edges").scalar()


def _edge(edges: tuple[float, ...], k: Column) -> Column:
    return F.get(_edges(edges), k.cast("int"))


def _halvings(edges: tuple[float, ...]) -> list[int]:
    return [1 << b for b in reversed(range(len(edges).bit_length()))]


def _up_to(edges: tuple[float, ...], c: Column) -> Column:
    """How many of ascending edges are at most c: bisection, one comparison for each halving. As one expression, so the edges are a constant of it; with_indices needs none."""
    array = F.lit([float(e) for e in edges]) if len(edges) < MANY_EDGES else F.from_json(F.lit(json.dumps(edges)), "array<double>")
    return F.aggregate(F.lit(_halvings(edges)), F.lit(0), lambda n, step: F.when(F.get(array, n + step - 1) <= c, n + step).otherwise(n))


def _start_of(meta: GridMeta, index: Index) -> tuple[list[Column], list[Column]]:
    """Coordinate of the indices, and how long a cell of level 0 is there."""
    m = 1 << meta.max_level
    if isinstance(meta.geometry, Stretched):
        at, size = [], []
        for e, i in zip(meta.geometry.edges, index):
            k = div(i, m)
            size.append(_edge(e, k + 1) - _edge(e, k))
            at.append(_edge(e, k) + (i % m) * size[-1] / m)
        return at, size
    one = _level0(meta)
    return [F.lit(float(s)) + i * F.lit(d / m) for s, i, d in zip(meta.start, index, one)], [F.lit(float(d)) for d in one]


def length_at(meta: GridMeta, index: Index, level: Column) -> Point:
    """Length of the cell of a level (null: none) at given indices."""
    return tuple(d / shl(1, level) for d in _start_of(meta, index)[1])


def middle_at(meta: GridMeta, index: Index, level: Column) -> Point:
    """Center of a cell known to be in the grid."""
    at, size = _start_of(meta, index)
    return tuple(a + d / shl(2, level) for a, d in zip(at, size))


def center_at(meta: GridMeta, level: Column, index: Index) -> Point:
    """Center of the cell of a level at given indices; null outside the grid or its levels."""
    ok = (level >= 0) & (level <= meta.max_level)
    for i, n in zip(index, meta.extent):
        ok = ok & (i >= 0) & (i < n)
    return tuple(F.when(ok, c) for c in middle_at(meta, index, level))


def _known(meta: GridMeta, cell: Column) -> tuple[Column, Index]:
    level = level_of(meta, cell)
    level = F.when(level >= 0, level)
    return level, indices_of(meta, cell, level)


def length(meta: GridMeta, cell: Column) -> Point:
    level, index = _known(meta, cell)
    return length_at(meta, index, level)


def center(meta: GridMeta, cell: Column) -> Point:
    level, index = _known(meta, cell)
    return middle_at(meta, index, level)


def minimum(meta: GridMeta, cell: Column) -> Point:
    return tuple(c - d / 2 for c, d in zip(center(meta, cell), length(meta, cell)))


def maximum(meta: GridMeta, cell: Column) -> Point:
    return tuple(c + d / 2 for c, d in zip(center(meta, cell), length(meta, cell)))


def real_coordinate(meta: GridMeta, point: Point) -> Point:
    """The point within the grid: wrapped around where periodic, null where outside."""
    out = []
    for c, a, b, around in zip(point, meta.start, meta.end, meta.periodic):
        wide = b - a
        inside = (c >= a) & (c <= b)
        if around:
            out.append(F.when(inside, c).when(c < a, c + wide * F.ceil((F.lit(a) - c) / wide)).when(c > b, c - wide * F.ceil((c - b) / wide)))
        else:
            out.append(F.when(inside, c))
    return tuple(out)


def indices_at(meta: GridMeta, point: Point) -> Index:
    """Indices of the smallest possible cell around a point; null outside. The end of the grid gives an index one past the last."""
    if isinstance(meta.geometry, Stretched):
        return tuple(_between(meta, e, c, _up_to(e, c)) for e, c in zip(meta.geometry.edges, real_coordinate(meta, point)))
    m = 1 << meta.max_level
    return tuple(F.floor((c - meta.start[d]) / (_level0(meta)[d] / m)).cast("long") for d, c in enumerate(real_coordinate(meta, point)))


def _between(meta: GridMeta, e: tuple[float, ...], c: Column, before: Column) -> Column:
    """The index of a coordinate of which so many edges are at most as large."""
    m, k = 1 << meta.max_level, before - 1
    low = _edge(e, k)
    inside = F.least(F.floor((c - low) / (_edge(e, k + 1) - low) * m), F.lit(m - 1).cast("long"))
    return F.when(c.isNotNull(), F.when(k < len(e) - 1, k.cast("long") * m + inside).otherwise(F.lit((len(e) - 1) * m).cast("long")))


def with_indices(df: DataFrame, meta: GridMeta, point: Point, names: tuple[str, str, str] = ("ix", "iy", "iz")) -> DataFrame:
    """df with indices_at as columns. Many edges are bisected in generated code, a column per halving, over a table that is read once."""
    if not isinstance(meta.geometry, Stretched):
        return df.withColumns(dict(zip(names, indices_at(meta, point))))
    inside = [f"__c{d}" for d in range(3)]
    out = df.withColumns(dict(zip(inside, real_coordinate(meta, point))))
    for d, (e, name) in enumerate(zip(meta.geometry.edges, names)):
        c = F.col(inside[d])
        if len(e) < MANY_EDGES:
            out = out.withColumn(name, _between(meta, e, c, _up_to(e, c)))
            continue
        array, n = _edges(e), F.col("__n")
        out = out.withColumn("__n", F.lit(0))
        for step in _halvings(e):
            out = out.withColumn("__n", F.when(F.get(array, n + step - 1) <= c, n + step).otherwise(n))
        out = out.withColumn(name, _between(meta, e, c, n)).drop("__n")
    return out.drop(*inside)


def cell_at_point(meta: GridMeta, level: Column, point: Point) -> Column:
    """The cell of a level around a point; 0 outside."""
    return F.coalesce(cell_at(meta, indices_at(meta, point), level), F.lit(0).cast("long"))


def level0_start_index(meta: GridMeta, cell: Column) -> Index:
    """Place, among the cells of level 0, of that which a cell is in."""
    _, index = _known(meta, cell)
    return tuple(div(i, 1 << meta.max_level) for i in index)
