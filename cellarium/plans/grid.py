"""The grid: metadata and one DataFrame of leaf cells.

cells has cell, lvl, ix, iy, iz, len (in indices), part (owner), weight, pin and the user's columns. Levels and
indices are kept as columns, computed once, so later plans need no arithmetic to find them.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import mapping
from ..functions.meta import GridMeta, hood_offsets
from .shared import numbered, settle, small

#: Columns that every grid has.
CORE = ("cell", "lvl", "ix", "iy", "iz", "len", "part", "weight", "pin")
DEFAULT = None
Offset = tuple[int, int, int]


@dataclass(frozen=True)
class Grid:
    meta: GridMeta
    cells: DataFrame
    #: Named neighborhoods besides the default one.
    hoods: dict = field(default_factory=dict)
    #: Derived columns, evaluated whenever they are asked for: name -> expression over cells' columns.
    cell_items: dict = field(default_factory=dict)
    #: The same over neighbor rows.
    neighbor_items: dict = field(default_factory=dict)
    #: Number of leaves if it is known without looking.
    leaves: int | None = None
    #: True if all leaves are of level 0.
    uniform: bool = False

    # --- construction ----------------------------------------------------------------------------------------------

    @staticmethod
    def level0(spark: SparkSession, meta: GridMeta, parts: int = 1, order: str = "id") -> Grid:
        """All cells of level 0, in contiguous blocks per part of their ids or (order "curve") of their places on the space-filling curve; the first parts have one fewer if they can't be equal."""
        n = meta.level0_cells
        cells = spark.range(1, n + 1).select(F.col("id").alias("cell"))
        if order == "id":
            return Grid.of(meta, cells.withColumn("part", block_part(F.col("cell") - 1, n, parts)), leaves=n, uniform=True)
        if order != "curve":
            raise ValueError(f"unknown order {order}")
        key = mapping.z_order(tuple(mapping.shr(F.col(c), meta.max_level) for c in ("ix", "iy", "iz")))
        placed = numbered(mapping.with_place(cells, meta), key, F.col("cell"))
        return Grid.of(meta, placed.select("cell", block_part(F.col("n"), n, parts).alias("part")), leaves=n, uniform=True)

    @staticmethod
    def of(meta: GridMeta, cells: DataFrame, leaves: int | None = None, uniform: bool = False) -> Grid:
        """A grid of existing cells; cells has at least a column cell. Missing owners are part 0, missing weights 1."""
        have, names = set(cells.columns), cells.columns
        new = {"part": F.col("part").cast("int") if "part" in have else F.lit(0), "weight": F.col("weight").cast("double") if "weight" in have else F.lit(1.0), "pin": F.col("pin").cast("int") if "pin" in have else F.lit(None).cast("int")}
        user = [c for c in names if c not in CORE]
        placed = mapping.with_place(cells.select(F.col("cell").cast("long").alias("cell"), *[v.alias(k) for k, v in new.items()], *user), meta)
        return Grid(meta, placed.select(*CORE, *user), leaves=leaves, uniform=uniform or meta.max_level == 0)

    def with_cells(self, cells: DataFrame, **changes) -> Grid:
        return _replace(self, cells=cells, **changes)

    def with_columns(self, columns: dict[str, Column]) -> Grid:
        return self.with_cells(self.cells.withColumns(columns))

    def copy_structure(self, columns: dict[str, Column] | None = None) -> Grid:
        """The same cells, owners, weights and neighborhoods with other data: defaults given as expressions."""
        return self.with_cells(self.cells.select(*CORE, *[v.alias(k) for k, v in (columns or {}).items()]))

    def settled(self) -> Grid:
        return self.with_cells(settle(self.cells))

    def counted(self) -> Grid:
        """The same grid with its number of leaves known, so that small leaf tables can be broadcast."""
        return self if self.leaves is not None else _replace(self, leaves=self.cells.count())

    # --- neighborhoods ---------------------------------------------------------------------------------------------

    def offsets(self, hood=DEFAULT) -> list[Offset]:
        if hood is DEFAULT:
            return hood_offsets(self.meta.hood)
        return list(self.hoods[hood])

    def add_hood(self, name, offsets: list[Offset]) -> Grid:
        """The grid with a further neighborhood. Its offsets must lie in the default one; names can't be used twice."""
        offsets = [tuple(map(int, o)) for o in offsets]
        allowed = set(hood_offsets(self.meta.hood))
        if name is DEFAULT or name in self.hoods:
            raise ValueError(f"there is a neighborhood {name!r} already")
        if any(o not in allowed for o in offsets):
            raise ValueError("offsets must be part of the default neighborhood, without (0, 0, 0)")
        return _replace(self, hoods={**self.hoods, name: tuple(offsets)})

    def remove_hood(self, name) -> Grid:
        return _replace(self, hoods={k: v for k, v in self.hoods.items() if k != name})

    # --- cells -----------------------------------------------------------------------------------------------------

    @cached_property
    def ids(self) -> DataFrame:
        """Ids of the leaves, marked for broadcast if they are known to be few."""
        return small(self.cells.select("cell"), self.leaves)

    def all_cells(self, ordered: bool = False) -> DataFrame:
        out = self.cells.select("*", *[v.alias(k) for k, v in self.cell_items.items()])
        return out.orderBy("cell") if ordered else out

    def __getitem__(self, cell: int) -> DataFrame:
        return self.cells.filter(F.col("cell") == cell)

    def with_items(self, cell_items: dict[str, Column] | None = None, neighbor_items: dict[str, Column] | None = None) -> Grid:
        return _replace(self, cell_items={**self.cell_items, **(cell_items or {})}, neighbor_items={**self.neighbor_items, **(neighbor_items or {})})


def _replace(grid: Grid, **changes) -> Grid:
    values = {f: getattr(grid, f) for f in ("meta", "cells", "hoods", "cell_items", "neighbor_items", "leaves", "uniform")}
    return Grid(**{**values, **changes})


def block_part(at: Column, n: int, parts: int) -> Column:
    """Owner of the cell at a place (from 0) in an order of n cells cut into blocks; the first blocks have one fewer where sizes differ."""
    big = -(-n // parts)
    fewer = parts * big - n
    if big == 1:
        return (at + fewer).cast("int")
    edge = fewer * (big - 1)
    return F.when(at < edge, mapping.div(at, big - 1)).otherwise(fewer + mapping.div(at - edge, big)).cast("int")
