"""Saving and loading grids: Parquet with the metadata beside it, the binary file of one cell after another, and VTK text."""

from __future__ import annotations

import json
import re
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow.fs import FileSystem
from pyspark.sql import Column, DataFrame, DataFrameWriter, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import curve, geometry
from ..functions.meta import GridMeta
from ..plans.grid import Grid
from ..plans.shared import numbered, settle
from . import gridfile
from .layout import parse_preamble, preamble, read_head

# --- Parquet -------------------------------------------------------------------------------------------------------


def save(grid: Grid, path: str, header: str = "", mode: str = "errorifexists") -> None:
    """cells as Parquet in path/cells, metadata, neighborhoods and a free header as one JSON row in path/meta."""
    _save(grid, grid.cells.write, path, header, mode)


def _save(grid: Grid, cells: DataFrameWriter, path: str, header: str, mode: str) -> None:
    cells.mode(mode).parquet(f"{path}/cells")
    hoods = {str(k): list(v) for k, v in grid.hoods.items()}
    row = [(grid.meta.to_json(), json.dumps(hoods), header)]
    grid.cells.sparkSession.createDataFrame(row, "meta string, hoods string, header string").coalesce(1).write.mode(mode).json(f"{path}/meta")


def save_on_curve(grid: Grid, path: str, header: str = "", mode: str = "errorifexists", files: int | None = None, group_bytes: int = 1 << 25) -> None:
    """Like save, with cells in the order of the space-filling curve and their place on it as column key: files and row groups then hold compact regions, and a box reads those it meets. Row groups are smaller than usual for that reason."""
    keyed = grid.cells.withColumn("key", curve.key(grid.meta, (F.col("ix"), F.col("iy"), F.col("iz"))))
    ordered = keyed.repartitionByRange(files, "key") if files else keyed.repartitionByRange("key")
    _save(grid, ordered.sortWithinPartitions("key").write.option("parquet.block.size", group_bytes), path, header, mode)


def load(spark: SparkSession, path: str) -> tuple[Grid, str]:
    row = spark.read.schema("meta string, hoods string, header string").json(f"{path}/meta").first()
    meta = GridMeta.from_json(row["meta"])
    hoods = {k: tuple(map(tuple, v)) for k, v in json.loads(row["hoods"]).items()}
    return Grid(meta, spark.read.parquet(f"{path}/cells"), hoods, uniform=meta.max_level == 0), row["header"] or ""


# --- binary --------------------------------------------------------------------------------------------------------

def _packer(code: str):
    def pack(*columns: pd.Series) -> pd.Series:
        return pd.Series([struct.pack("<" + code, *row) for row in zip(*columns)])

    return F.pandas_udf(pack, "binary")


def packed(columns: dict[str, str]) -> Column:
    """Cell data as bytes. columns: name -> code of the struct module (q: 64-bit integer, d: double, i: 32-bit integer)."""
    return _packer("".join(columns.values()))(*[F.col(c) for c in columns])


def _pieces(rows: DataFrame, table: int, first: int) -> DataFrame:
    """at, bytes: pieces of the table of cells and of the data. rows: cell and data in the file's order within partitions, and for each partition how many cells (rank) and bytes (base) are before it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rank = at = None
        for batch in batches:
            if not batch.num_rows:
                continue
            if rank is None:
                rank, at = batch.column("rank")[0].as_py(), first + batch.column("base")[0].as_py()
            data = batch.column("data").to_pylist()
            ends = at + np.cumsum([len(x) for x in data])
            entries = np.stack([np.asarray(batch.column("cell")), np.append([at], ends[:-1])], 1).astype("<u8")
            yield pa.RecordBatch.from_pydict({"at": [table + 16 * rank], "bytes": [entries.tobytes()]})
            yield pa.RecordBatch.from_pydict({"at": [int(at)], "bytes": [b"".join(data)]})
            rank, at = rank + len(data), int(ends[-1])

    return rows.select("cell", "data", "rank", "base").mapInArrow(run, "at long, bytes binary")


def write_binary(grid: Grid, path: str, columns: dict[str, str] | None = None, data: Column | None = None, header: bytes = b"", cells: DataFrame | None = None, offset: int = 0) -> None:
    """One file: preamble, number of cells, (id, offset) of each, data. Cells ascend. Data is columns, packed, or a binary expression of any length per cell. cells: write only these. offset: where the grid starts at least; a shorter header is padded with zeros.

    Offsets come from a prefix sum in two steps; tasks then write the bytes of their rows at their places (see gridfile), so nothing but a row per partition reaches the driver."""
    spark = grid.cells.sparkSession
    source = grid.cells if cells is None else grid.cells.join(cells.select("cell").distinct(), "cell", "left_semi")
    body = data if data is not None else packed(columns) if columns else F.lit(b"")
    rows = settle(source.select("cell", F.coalesce(body, F.lit(b"")).alias("data")).repartitionByRange("cell").sortWithinPartitions("cell").withColumn("__p", F.spark_partition_id()))
    sums = rows.groupBy("__p").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("data")).alias("bytes"))
    before = Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
    base = settle(sums.select("__p", "n", "bytes", *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(k) for c, k in (("n", "rank"), ("bytes", "base"))]))
    n, size = base.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("bytes"), F.lit(0))).first()
    start = preamble(grid.meta, header.ljust(offset, b"\0")) + struct.pack("<Q", n)
    first = len(start) + 16 * n
    # a row per partition is broadcast; partitions stay where they are
    pieces = _pieces(rows.join(F.broadcast(base.drop("n", "bytes")), "__p"), len(start), first)
    pieces = pieces.unionByName(spark.createDataFrame([(0, bytearray(start))], "at long, bytes binary"))
    gridfile.register(spark)
    name = _qualified(spark, path)
    pieces.write.format(gridfile.NAME).option("path", name).option("length", first + size).option("token", uuid.uuid4().hex).mode("overwrite").save()


def _qualified(spark: SparkSession, path: str) -> str:
    """The name that tasks open: one without a scheme is of the default file system, for reading as for writing."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return re.sub("^file:/+", "file:///", at.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(at).toUri().toString())


@dataclass(frozen=True)
class BinaryFile:
    """An opened binary file: what its preamble says. Cells and data are read by tasks, range by range, when a plan asks for them."""

    spark: SparkSession
    path: str
    meta: GridMeta
    header: bytes
    #: Cells in the file.
    cells: int
    #: Whether ids ascend, as in files written here; only then do filters on ids spare ranges.
    ascending: bool = True

    def rows(self, columns: dict[str, str] | None = None, names: tuple[str, ...] | None = None) -> DataFrame:
        """cell and columns unpacked or, without them, data as bytes. names: only these of them; without any but cell no data is read."""
        reader = self.spark.read.format(gridfile.NAME).option("headerLength", len(self.header)).option("sorted", str(self.ascending).lower())
        if columns:
            reader = reader.option("columns", ",".join(f"{c}:{k}" for c, k in columns.items()))
        if names is not None:
            kinds = {"cell": "long", "data": "binary", **{c: gridfile.KIND[k] for c, k in (columns or {}).items()}}
            reader = reader.schema(", ".join(f"`{c}` {kinds[c]}" for c in names))
        return reader.load(self.path)

    def structure(self) -> Grid:
        """The grid without data, from the table of cells alone."""
        return Grid.of(self.meta, self.rows(names=("cell",)), self.cells)

    def load(self, columns: dict[str, str] | None = None, where: Column | None = None) -> Grid:
        """The grid with columns unpacked or, without them, data as bytes. where: a condition on the rows; one on the cell's id decides which ranges of the file are read."""
        rows = self.rows(columns)
        return Grid.of(self.meta, rows if where is None else rows.filter(where), self.cells if where is None else None)


def open_binary(spark: SparkSession, path: str, header_length: int = 0, ascending: bool = True) -> BinaryFile:
    """Reads the preamble, however many edges a stretched geometry has; cells and data stay in the file. Tasks open the file by its qualified name, so it must be in a store that all executors reach by pyarrow's file systems."""
    gridfile.register(spark)
    name = _qualified(spark, path)
    fs, at = FileSystem.from_uri(name)
    with fs.open_input_file(at) as f:
        meta, header, n, _ = read_head(lambda k: f.read_at(k, 0), f.size(), header_length)
    return BinaryFile(spark, name, meta, header, n, ascending)


def read_binary(spark: SparkSession, path: str, columns: dict[str, str] | None = None, header_length: int = 0) -> tuple[Grid, bytes]:
    """The grid of a binary file and the header before it."""
    file = open_binary(spark, path, header_length)
    return file.load(columns), file.header


# --- VTK -----------------------------------------------------------------------------------------------------------


def vtk_lines(grid: Grid, scalars: tuple[str, ...] = ()) -> DataFrame:
    """section, n, k, line of a legacy VTK file; in their order the lines are the file. Eight points and a voxel (type 11) per cell, cells by id; scalars are columns written as cell data."""
    # scalars may have any name, also those of columns made here
    cells = numbered(grid.cells.select("cell", *[F.col(f"`{s}`").cast("string").alias(f"__s{i}") for i, s in enumerate(scalars)]), F.col("cell"))
    low, high = geometry.minimum(grid.meta, F.col("cell")), geometry.maximum(grid.meta, F.col("cell"))
    cells = cells.withColumns({**{"a" + c: v for c, v in zip("xyz", low)}, **{"b" + c: v for c, v in zip("xyz", high)}})
    total = cells.count()
    number = lambda c: F.regexp_replace(F.col(c).cast("string"), r"\.0$", "")
    points = F.array(*[F.concat_ws(" ", *[number(("b" if k >> d & 1 else "a") + c) for d, c in enumerate("xyz")]) for k in range(8)])
    sections = [
        cells.select(F.lit(1).alias("section"), "n", F.posexplode(points).alias("k", "line")),
        cells.select(F.lit(3).alias("section"), "n", F.lit(0).alias("k"), F.concat_ws(" ", F.lit("8"), *[(F.col("n") * 8 + i).cast("string") for i in range(8)]).alias("line")),
        cells.select(F.lit(5).alias("section"), "n", F.lit(0).alias("k"), F.lit("11").alias("line")),
    ]
    heads = [(0, f"# vtk DataFile Version 2.0\nleaf cells as voxels\nASCII\nDATASET UNSTRUCTURED_GRID\nPOINTS {total * 8} float"), (2, f"CELLS {total} {total * 9}"), (4, f"CELL_TYPES {total}")]
    for i, s in enumerate(scalars):
        heads.append((6 + 2 * i, (f"CELL_DATA {total}\n" if i == 0 else "") + f"SCALARS {s} float 1\nLOOKUP_TABLE default"))
        sections.append(cells.select(F.lit(7 + 2 * i).alias("section"), "n", F.lit(0).alias("k"), F.col(f"__s{i}").alias("line")))
    spark = grid.cells.sparkSession
    out = spark.createDataFrame([(s, 0, i, line) for s, text in heads for i, line in enumerate(text.split("\n"))], "section int, n long, k int, line string")
    for s in sections:
        out = out.unionByName(s.select("section", F.col("n").cast("long").alias("n"), "k", "line"))
    return out


def write_vtk(grid: Grid, path: str, scalars: tuple[str, ...] = ()) -> None:
    """A folder with one text file: the format is one sequence of lines."""
    lines = vtk_lines(grid, scalars)
    lines.repartitionByRange(1, "section", "n", "k").sortWithinPartitions("section", "n", "k").select("line").write.text(path)


def binary_to_vtk(spark: SparkSession, source: str, target: str, columns: dict[str, str], header_length: int = 0, scalars: tuple[str, ...] | None = None) -> None:
    """A binary file as VTK, its columns as cell data."""
    grid, _ = read_binary(spark, source, columns, header_length)
    write_vtk(grid, target, tuple(columns) if scalars is None else scalars)
