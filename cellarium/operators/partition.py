"""Assigning cells to parts: by blocks, at random, along a space-filling curve, by recursive bisection, in two levels; with weights and pins. Pins win.

Graph and hypergraph partitioners have no counterpart here and are refused.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry, mapping
from ..plans.grid import Grid
from ..plans.shared import settle, small

METHODS = ("NONE", "BLOCK", "RANDOM", "RCB", "RIB", "HSFC", "HIER")
#: Option names that belong to the library.
RESERVED = ("method", "parts", "levels", "weights", "pins")


def _cut(cells: DataFrame, key: Column, parts: int, within: tuple[str, ...] = ()) -> DataFrame:
    """cells with __part: contiguous ranges of key (within groups) of about equal weight. The running sum has two steps: ranges of the key first, then rows within a range, so no task holds all cells."""
    spark = cells.sparkSession
    ranges = max(1, min(int(spark.conf.get("spark.sql.shuffle.partitions")), 4096))
    keyed = cells.withColumn("__key", key)
    order = [*within, "__key", "cell"]
    ranged = settle(keyed.repartitionByRange(ranges, *order).withColumn("__range", F.spark_partition_id()))
    sums = ranged.groupBy(*within, "__range").agg(F.sum("weight").alias("__sum"))
    before = Window.partitionBy(*within).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(*within, "__range", F.coalesce(F.sum("__sum").over(before), F.lit(0.0)).alias("__base"), F.sum("__sum").over(Window.partitionBy(*within)).alias("__all"))
    own = Window.partitionBy(*within, "__range").orderBy("__key", "cell").rowsBetween(Window.unboundedPreceding, -1)
    placed = ranged.withColumn("__run", F.coalesce(F.sum("weight").over(own), F.lit(0.0))).join(F.broadcast(sums), [*within, "__range"])  # a row per range and group
    middle = (F.col("__base") + F.col("__run") + F.col("weight") / 2) / F.col("__all") * parts
    return placed.withColumn("__part", F.least(F.floor(middle), F.lit(parts - 1)).cast("int")).drop("__key", "__range", "__run", "__base", "__all")


_AXES = ("__x", "__y", "__z")
_DIRECTION = ("__dx", "__dy", "__dz")


def _directions(boxes: DataFrame, inertial: bool) -> DataFrame:
    """__lo and the direction along which each box is cut: its longest side, the first of equal ones, or its axis of largest inertia. boxes: a row per box with its weight, extents and moments."""
    side = [F.col("hi" + a) - F.col("lo" + a) for a in _AXES]
    longest = F.when((side[0] >= side[1]) & (side[0] >= side[2]), 0).when(side[1] >= side[2], 1).otherwise(2)
    boxes = boxes.withColumns({d: (longest == i).cast("double") for i, d in enumerate(_DIRECTION)})
    if not inertial:
        return boxes.select("__lo", *_DIRECTION)

    def axes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = batch[["__lo", *_DIRECTION]].copy()
            for i, r in enumerate(batch.to_dict("records")):
                if r["w"]:
                    mean = np.array([r["m" + a] for a in _AXES]) / r["w"]
                    spread = np.array([[r["c" + min(a, b) + max(a, b)] for b in _AXES] for a in _AXES]) / r["w"] - np.outer(mean, mean)
                    vector = np.linalg.eigh(spread)[1][:, -1]
                    out.loc[out.index[i], list(_DIRECTION)] = vector * (1 if vector[np.abs(vector).argmax()] > 0 else -1)
            yield out

    return boxes.mapInPandas(axes, "__lo int, " + ", ".join(f"{d} double" for d in _DIRECTION))


def _bisect(grid: Grid, cells: DataFrame, parts: int, inertial: bool) -> DataFrame:
    """Recursive bisection: boxes are cut across their longest side (or their axis of largest inertia) at the weighted median, in proportion to the parts that each half gets. One aggregation per level for all boxes, whose directions are a table of a row per box."""
    x, y, z = geometry.center(grid.meta, F.col("cell"))
    cells = settle(cells.withColumns({"__x": x, "__y": y, "__z": z, "__lo": F.lit(0), "__n": F.lit(parts)}))
    for _ in range(max(0, math.ceil(math.log2(max(1, parts))))):
        w = F.col("weight")
        stats = cells.filter("__n > 1").groupBy("__lo", "__n").agg(
            F.sum(w).alias("w"), *[F.max(a).alias("hi" + a) for a in _AXES], *[F.min(a).alias("lo" + a) for a in _AXES], *[F.sum(w * F.col(a)).alias("m" + a) for a in _AXES], *[F.sum(w * F.col(a) * F.col(b)).alias("c" + a + b) for i, a in enumerate(_AXES) for b in _AXES[i:]]
        )
        directions = settle(_directions(stats, inertial))
        if not directions.limit(1).count():
            break
        along = sum((F.col(a) * F.col(d) for a, d in zip(_AXES, _DIRECTION)), F.lit(0.0))
        half = (F.col("__n") / 2).cast("int")
        boxed = cells.filter("__n > 1").join(small(directions, parts), "__lo").withColumn("__left", half)
        cut = _cut_in_boxes(boxed.withColumn("__along", along).drop(*_DIRECTION), F.col("__along"))
        rest = cells.filter("__n <= 1")
        cells = settle(cut.select(*rest.columns).unionByName(rest))
    return cells.withColumn("__part", F.col("__lo")).drop("__x", "__y", "__z", "__lo", "__n", "__left")


def _cut_in_boxes(cells: DataFrame, along: Column) -> DataFrame:
    share = _cut(cells.withColumn("__left_share", F.col("__left") / F.col("__n")), along, 1 << 20, ("__lo", "__n"))
    left = F.col("__part") < F.col("__left_share") * (1 << 20)
    return share.withColumn("__new_lo", F.when(left, F.col("__lo")).otherwise(F.col("__lo") + F.col("__left"))).withColumn("__n", F.when(left, F.col("__left")).otherwise(F.col("__n") - F.col("__left"))).drop("__lo", "__part", "__left_share").withColumnRenamed("__new_lo", "__lo")


def partition(grid: Grid, parts: int, method: str = "RCB", seed: int = 0, levels: tuple[tuple[int, str], ...] = (), options: Options | None = None) -> Grid:
    """grid with new owners. HIER: levels is ((groups, method), (parts in a group, method), ...); inner cuts follow the space-filling curve within each group. options: its levels, if it has any, make the method HIER, with the method that each names as LB_METHOD; its option RANDOM_SEED is the seed."""
    if options is not None:
        seed = int(options.options.get("RANDOM_SEED", seed))
        if options.levels:
            method, levels = "HIER", options.hierarchy(parts)
    method = method.upper()
    if method in ("GRAPH", "HYPERGRAPH"):
        raise NotImplementedError("graph and hypergraph partitioning are not offered; HSFC keeps neighbors together")
    if method not in METHODS:
        raise ValueError(f"unknown method {method}; there are {', '.join(METHODS)}")
    columns = grid.cells.columns
    key = mapping.z_order((F.col("ix"), F.col("iy"), F.col("iz")))
    if method == "NONE":
        placed = grid.cells.withColumn("__part", F.col("part"))
    elif method == "RANDOM":
        placed = grid.cells.withColumn("__part", F.pmod(F.xxhash64("cell", F.lit(seed)), F.lit(parts)).cast("int"))
    elif method == "BLOCK":
        placed = _cut(grid.cells, F.col("cell"), parts)
    elif method == "HSFC":
        placed = _cut(grid.cells, key, parts)
    elif method in ("RCB", "RIB"):
        placed = _bisect(grid, grid.cells, parts, method == "RIB")
    else:
        (outer, outer_method), *inner = levels
        if outer * math.prod(n for n, _ in inner) != parts:
            raise ValueError("the levels' parts don't make up all parts")
        free = Grid(grid.meta, grid.cells.withColumn("pin", F.lit(None).cast("int")), leaves=grid.leaves, uniform=grid.uniform)
        placed = partition(free, outer, outer_method, seed).cells.withColumn("__group", F.col("part"))
        for n, _ in inner:
            placed = _cut(placed, key, n, ("__group",)).withColumn("__group", F.col("__group") * n + F.col("__part")).drop("__part")
        pins = grid.cells.select("cell", F.col("pin").alias("__pin"))
        placed = placed.withColumnRenamed("__group", "__part").join(pins, "cell").withColumn("pin", F.col("__pin"))
    owner = F.coalesce(F.col("pin"), F.col("__part")).cast("int")
    return grid.with_cells(placed.withColumn("part", owner).select(*columns))


def balance_load(grid: Grid, parts: int, method: str = "RCB", seed: int = 0, levels: tuple = (), options: Options | None = None) -> Grid:
    """New owners; weights are used and then forgotten, pins stay."""
    return partition(grid, parts, method, seed, levels, options).with_columns({"weight": F.lit(1.0)}).settled()


def moved(before: Grid, after: Grid) -> DataFrame:
    """cell, from_part, to_part of cells that change owner: the plan of a balancing in stages."""
    new = after.cells.select("cell", F.col("part").alias("to_part"))
    return before.cells.select("cell", F.col("part").alias("from_part")).join(new, "cell").filter("from_part <> to_part")


def pin(grid: Grid, pins: DataFrame) -> Grid:
    """pins: cell, pin (a part; null: the present owner). Cells that don't exist are passed over."""
    asked = pins.select("cell", F.col("pin").cast("int").alias("__pin"), F.lit(True).alias("__asked"))
    new = F.when(F.col("__asked"), F.coalesce("__pin", "part")).otherwise(F.col("pin"))
    return grid.with_cells(grid.cells.join(asked, "cell", "left").withColumn("pin", new).select(*grid.cells.columns))


def unpin(grid: Grid, cells: DataFrame | None = None, part: int | None = None) -> Grid:
    """Without pins: of given cells, of a part's cells, or all."""
    none = F.lit(None).cast("int")
    if cells is not None:
        marked = grid.cells.join(cells.select("cell", F.lit(True).alias("__off")), "cell", "left")
        return grid.with_cells(marked.withColumn("pin", F.when(F.col("__off"), none).otherwise(F.col("pin"))).select(*grid.cells.columns))
    return grid.with_columns({"pin": none if part is None else F.when(F.col("part") == part, none).otherwise(F.col("pin"))})


def set_weights(grid: Grid, weights: DataFrame) -> Grid:
    """weights: cell, weight."""
    new = weights.select("cell", F.col("weight").cast("double").alias("__w"))
    return grid.with_cells(grid.cells.join(new, "cell", "left").withColumn("weight", F.coalesce("__w", "weight")).select(*grid.cells.columns))


class Options:
    """Settings of partitioning levels: parts per level and named options."""

    def __init__(self):
        self.options: dict[str, str] = {}
        self.levels: list[tuple[int, dict[str, str]]] = []

    @staticmethod
    def _check(name: str) -> None:
        if name.lower() in RESERVED:
            raise ValueError(f"{name} is set by the library")

    def set(self, name: str, value: str) -> None:
        self._check(name)
        self.options[name] = value

    def add_level(self, parts: int) -> None:
        if parts < 1:
            raise ValueError("a level has at least one part")
        self.levels.append((parts, {}))

    def remove_level(self, level: int) -> None:
        del self.levels[level]

    def set_in_level(self, level: int, name: str, value: str) -> None:
        self._check(name)
        self.levels[level][1][name] = value

    def remove_from_level(self, level: int, name: str) -> None:
        self.levels[level][1].pop(name, None)

    def hierarchy(self, parts: int) -> tuple[tuple[int, str], ...]:
        """((groups, method), (groups in each, method), ...) of so many parts: a level's number is how many parts it keeps together, the last level's the rest."""
        out, left = [], parts
        for size, named in self.levels:
            if left % size:
                raise ValueError(f"{left} parts can't be cut into groups of {size}")
            out.append((left // size, named.get("LB_METHOD", "RCB")))
            left = size
        return (*out, (left, "HSFC")) if left > 1 else tuple(out)

    def names(self, level: int) -> list[str]:
        return sorted(self.levels[level][1])

    def value(self, level: int, name: str) -> str | None:
        return self.levels[level][1].get(name)
