"""Streams of points as running aggregates per cell: the same column functions, under Structured Streaming. A stream's time can be a grid axis, whose cells are then tumbling buckets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geometry, mapping
from ..functions.meta import GridMeta


def cell_stream(stream: DataFrame, meta: GridMeta, point: tuple[Column, Column, Column], level: int = 0) -> DataFrame:
    """stream with the cell of a level around each point; rows outside the grid are dropped. No state."""
    return stream.withColumn("cell", geometry.cell_at_point(meta, F.lit(level), point)).filter("cell <> 0")


def windowed_cells(stream: DataFrame, meta: GridMeta, point: tuple[Column, Column, Column], time: str, window: str, late: str, aggregates: dict[str, Column], level: int = 0) -> DataFrame:
    """Aggregates per tumbling window and cell; rows later than `late` behind the newest are dropped, and state older than that is freed."""
    cells = cell_stream(stream.withWatermark(time, late), meta, point, level)
    return cells.groupBy(F.window(time, window).alias("window"), "cell").agg(*[v.alias(k) for k, v in aggregates.items()])


def coarser(cells: DataFrame, meta: GridMeta, level: int) -> DataFrame:
    """Cells of a stream of cells, moved up to a level."""
    return cells.withColumn("cell", mapping.ancestor(meta, mapping.indices_of(meta, F.col("cell")), level))
