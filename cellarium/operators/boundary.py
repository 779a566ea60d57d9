"""What parts of a grid share: boundaries, halos and the data that an update would move. The owner of a cell is its column part."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.grid import DEFAULT, Grid
from ..plans.shared import small
from .neighbors import neighbors_of


def across(grid: Grid, hood=DEFAULT) -> DataFrame:
    """cell, part, nbr, n_part of neighbor rows that cross parts (each pair once, seen from the cell whose neighborhood it is)."""
    parts = small(grid.cells.select(F.col("cell").alias("nbr"), F.col("part").alias("n_part")), grid.leaves)
    return neighbors_of(grid, hood, keep=("part",)).join(parts, "nbr").filter("part <> n_part").select("cell", "part", "nbr", "n_part").distinct()


def remote_neighbors_of(grid: Grid, hood=DEFAULT) -> DataFrame:
    return across(grid, hood).select("cell", "nbr", F.col("n_part").alias("nbr_part"))


def remote_neighbors_to(grid: Grid, hood=DEFAULT) -> DataFrame:
    return across(grid, hood).select(F.col("nbr").alias("cell"), F.col("cell").alias("nbr"), F.col("part").alias("nbr_part"))


def exchange(grid: Grid, hood=DEFAULT) -> DataFrame:
    """cell, part (its owner), to_part: each cell once for each part that needs a copy of it. A part needs the neighbors of its cells, and the cells whose neighbors they are."""
    rows = across(grid, hood)
    both = F.array(F.struct(F.col("nbr").alias("cell"), F.col("n_part").alias("part"), F.col("part").alias("to_part")), F.struct(F.col("cell").alias("cell"), F.col("part").alias("part"), F.col("n_part").alias("to_part")))
    return rows.select(F.explode(both).alias("e")).select("e.*").distinct()


def _sorted(df: DataFrame, ordered: bool, *by: str) -> DataFrame:
    return df.orderBy(*by) if ordered else df


def boundary_local(grid: Grid, hood=DEFAULT, ordered: bool = False) -> DataFrame:
    """Cells with a neighbor (either way) in another part. ordered: by id, as in the others below."""
    return _sorted(grid.cells.join(exchange(grid, hood).select("cell"), "cell", "left_semi"), ordered, "cell")


def inner_cells(grid: Grid, hood=DEFAULT, ordered: bool = False) -> DataFrame:
    return _sorted(grid.cells.join(exchange(grid, hood).select("cell"), "cell", "left_anti"), ordered, "cell")


outer_cells = boundary_local


def boundary_remote(grid: Grid, hood=DEFAULT, ordered: bool = False) -> DataFrame:
    """to_part and the cells of other parts at its boundary."""
    return _sorted(exchange(grid, hood).select("to_part", "cell"), ordered, "to_part", "cell")


def local_cells(grid: Grid, part: int, ordered: bool = False) -> DataFrame:
    return _sorted(grid.cells.filter(F.col("part") == part), ordered, "cell")


def send_lists(grid: Grid, hood=DEFAULT, as_read: bool = True, ordered: bool = False) -> DataFrame:
    """from_part, to_part, cell. as_read: only the cells in a neighborhood of the receiver's cells, which is what an update of copies sends. ordered: by sender and receiver, then id, the order in which both ends go through a list."""
    rows = across(grid, hood).select(F.col("nbr").alias("cell"), F.col("n_part").alias("from_part"), F.col("part").alias("to_part")).distinct()
    rows = rows if as_read else exchange(grid, hood).select("cell", F.col("part").alias("from_part"), "to_part")
    return _sorted(rows, ordered, "from_part", "to_part", "cell")


def update_counts(grid: Grid, hood=DEFAULT) -> DataFrame:
    """part, n_send, n_receive: cells that an update of copies sends and receives."""
    if hood is not DEFAULT and hood not in grid.hoods:
        raise KeyError(f"there is no neighborhood {hood!r}")
    lists = send_lists(grid, hood)
    ends = F.array(F.struct(F.col("from_part").alias("part"), F.lit(1).alias("s"), F.lit(0).alias("r")), F.struct(F.col("to_part").alias("part"), F.lit(0).alias("s"), F.lit(1).alias("r")))
    return lists.select(F.explode(ends).alias("e")).groupBy("e.part").agg(F.sum("e.s").alias("n_send"), F.sum("e.r").alias("n_receive"))


def neighbor_parts(grid: Grid, hood=DEFAULT) -> DataFrame:
    """part, nbr_part of parts that exchange cells."""
    rows = across(grid, hood).select("part", F.col("n_part").alias("nbr_part")).distinct()
    return rows.union(rows.select("nbr_part", "part")).distinct()
