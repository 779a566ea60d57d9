"""Snapshots: exact bytes, round trips, files in any order, broken ones, VTK."""

import struct

import pytest
from pyspark.sql import functions as F

from cellarium.functions.meta import Cartesian, GridMeta
from cellarium.operators import adapt as A
from cellarium.plans.grid import Grid
from cellarium.sources import snapshot as S

META = GridMeta((4, 3, 1), 2, geometry=Cartesian((0.5, 1.0, -2.0), (0.25, 0.5, 1.0)))


def record(r):
    return struct.pack("<QI5d", r["cell"], r["part"], *[r[v] for v in S.VALUES])


def test_snapshot(spark, tmp_path):
    grid = A.adapt(Grid.level0(spark, META), refine=[2, 7]).grid
    grid = grid.with_columns({"part": (F.col("cell") % 3).cast("int"), **{v: F.col("cell") / (k + 2) for k, v in enumerate(S.VALUES)}}).settled()
    path = str(tmp_path / "a.dc")
    S.write_snapshot(grid, path, "two lines\nof text\n")
    rows = [r.asDict() for r in grid.cells.orderBy("cell").collect()]
    start = b"two lines\nof text\nend of header\n" + struct.pack("<Q6d3QB", 0x1234567890ABCDEF, 0.5, 1.0, -2.0, 0.25, 0.5, 1.0, 4, 3, 1, 2)
    with open(path, "rb") as f:
        assert f.read() == start + b"".join(map(record, rows))
    again, text = S.read_snapshot(spark, path)
    assert text == "two lines\nof text\n" and again.meta == META and again.leaves == len(rows)
    pick = lambda g: sorted(map(tuple, g.cells.select("cell", "lvl", "ix", "part", *S.VALUES).collect()))
    assert pick(again) == pick(grid)
    (tmp_path / "b.dc").write_bytes(start + b"".join(map(record, rows[::-1])))  # as several writers may leave them
    assert pick(S.read_snapshot(spark, str(tmp_path / "b.dc"))[0]) == pick(grid)
    S.snapshot_to_vtk(spark, path, str(tmp_path / "vtk"))
    lines = [r[0] for r in spark.read.text(str(tmp_path / "vtk")).collect()]
    assert f"CELLS {len(rows)} {9 * len(rows)}" in lines and sum(x.startswith("SCALARS ") for x in lines) == 6
    S.write_snapshot(grid.with_cells(grid.cells.filter("cell < 0")), path)
    assert S.read_snapshot(spark, path)[0].cells.count() == 0


def test_broken_snapshots(spark, tmp_path):
    for content, what in ((b"no end", "ends its header"), (b"x\nend of header\n" + bytes(100), "byte order"), (b"end of header\n" + struct.pack("<Q6d3QB", S.MAGIC, *range(3), 1, 1, 1, 1, 1, 1, 0) + b"abc", "within a record")):
        (tmp_path / "c").write_bytes(content)
        with pytest.raises(ValueError, match=what):
            S.read_snapshot(spark, str(tmp_path / "c"))
    with pytest.raises(ValueError, match="Cartesian"):
        S.write_snapshot(Grid.level0(spark, GridMeta((1, 1, 1))), str(tmp_path / "d"))
