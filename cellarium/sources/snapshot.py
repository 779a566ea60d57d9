"""Snapshots of flow grids (`.dc` files): a text header, what the grid is, then one record of fixed size per cell. Written by tasks at their places, read by ranges of records, and turned into VTK."""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow.fs import FileSystem
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.meta import Cartesian, GridMeta
from ..plans.grid import Grid
from ..plans.shared import settle
from . import gridfile, store

# fixed values: the layout of the file
END = b"end of header\n"
MAGIC = 0x1234567890ABCDEF
HEAD = "<Q3d3d3QB"
VALUES = ("density", "max_diff", "vx", "vy", "vz")
RECORD = np.dtype([("cell", "<u8"), ("part", "<u4"), *[(v, "<f8") for v in VALUES]])


def write_snapshot(grid: Grid, path: str, header: str = "cells of a grid\n") -> None:
    """cells with columns density, max_diff, vx, vy and vz; ids ascend. header: text before the line that ends it."""
    if not isinstance(grid.meta.geometry, Cartesian):
        raise ValueError("a snapshot holds a start and lengths of cells of level 0: the geometry must be Cartesian")
    spark, g = grid.cells.sparkSession, grid.meta.geometry
    start = header.encode() + END + struct.pack(HEAD, MAGIC, *g.start, *g.level0_length, *grid.meta.length, grid.meta.max_level)
    values = [F.coalesce(F.col(v).cast("double"), F.lit(float("nan"))).alias(v) for v in VALUES]
    rows = settle(grid.cells.select("cell", "part", *values).repartitionByRange("cell").sortWithinPartitions("cell").withColumn("__p", F.spark_partition_id()))
    counts = rows.groupBy("__p").agg(F.count(F.lit(1)).alias("n"))
    base = settle(counts.select("__p", "n", F.coalesce(F.sum("n").over(Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("rank")))
    n = base.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    first = len(start)

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = None
        for batch in batches:
            if not batch.num_rows:
                continue
            at = first + RECORD.itemsize * batch.column("rank")[0].as_py() if at is None else at
            out = np.empty(batch.num_rows, RECORD)
            for c in RECORD.names:
                out[c] = np.asarray(batch.column(c))
            yield pa.RecordBatch.from_pydict({"at": [at], "bytes": [out.tobytes()]})
            at += out.nbytes

    # a row per partition is broadcast; partitions stay where they are
    placed = rows.join(F.broadcast(base.select("__p", "rank")), "__p").select(*RECORD.names, "rank")
    pieces = placed.mapInArrow(records, "at long, bytes binary").unionByName(spark.createDataFrame([(0, bytearray(start))], "at long, bytes binary"))
    gridfile.register(spark)
    pieces.write.format(gridfile.NAME).option("path", store._qualified(spark, path)).option("length", first + RECORD.itemsize * n).option("token", uuid.uuid4().hex).mode("overwrite").save()


def read_snapshot(spark: SparkSession, path: str) -> tuple[Grid, str]:
    """The grid of a snapshot and the text of its header. Records may come in any order."""
    name = store._qualified(spark, path)
    fs, at = FileSystem.from_uri(name)
    with fs.open_input_file(at) as f:
        size, content = f.size(), b""
        while END not in content:
            more = f.read_at(min(1 << 16, size - len(content)), len(content))
            if not more:
                raise ValueError("the file has no line that ends its header")
            content += more
        text, begin = content[: content.index(END)].decode(), content.index(END) + len(END)
        magic, x, y, z, dx, dy, dz, nx, ny, nz, level = struct.unpack(HEAD, f.read_at(struct.calcsize(HEAD), begin))
    if magic != MAGIC:
        raise ValueError("wrong byte order, or no snapshot")
    first = begin + struct.calcsize(HEAD)
    n = (size - first) // RECORD.itemsize
    if first + n * RECORD.itemsize != size:
        raise ValueError("the file ends within a record")
    meta = GridMeta((nx, ny, nz), level, geometry=Cartesian((x, y, z), (dx, dy, dz)))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, at = FileSystem.from_uri(name)
        with fs.open_input_file(at) as f:
            for batch in batches:
                for a in batch.column("id").to_pylist():
                    rows = np.frombuffer(f.read_at(RECORD.itemsize * min(gridfile.RANGE, n - a), first + RECORD.itemsize * a), RECORD)
                    kinds = {"cell": np.int64, "part": np.int32}
                    yield pa.RecordBatch.from_pydict({c: np.ascontiguousarray(rows[c]).astype(kinds.get(c, np.float64)) for c in RECORD.names})

    starts: DataFrame = spark.range(0, n, gridfile.RANGE, max(1, -(-n // gridfile.RANGE)))
    return Grid.of(meta, starts.mapInArrow(read, "cell long, part int, " + ", ".join(f"{v} double" for v in VALUES)), n), text


def snapshot_to_vtk(spark: SparkSession, source: str, target: str) -> None:
    """A snapshot as VTK, with owners and values as cell data."""
    store.write_vtk(read_snapshot(spark, source)[0], target, ("part", *VALUES))
