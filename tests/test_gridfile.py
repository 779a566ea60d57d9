"""Grid files as a data source: planning, pruning, exact bytes, commits."""

import os
import struct

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from cellarium.functions.meta import GridMeta
from cellarium.operators import adapt as A
from cellarium.plans.grid import Grid
from cellarium.sources import gridfile, store
from cellarium.sources.layout import preamble

META = GridMeta((6, 4, 2), 2)
COLUMNS = {"n": "q", "d": "d", "i": "i"}


@pytest.fixture(scope="module")
def grid(spark):
    grid = A.adapt(Grid.level0(spark, META), refine=[1, 20, 48]).grid
    return grid.with_columns({"n": F.col("cell") * 3, "d": F.col("cell") / 8, "i": (F.col("cell") % 7).cast("int")}).settled()


@pytest.fixture(scope="module")
def file(spark, grid, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("grids") / "g")
    store.write_binary(grid, path, COLUMNS, header=b"head")
    return path


def plain(grid, header, columns, codes):
    """The file's bytes, put together cell by cell."""
    rows = sorted(tuple(r) for r in grid.cells.select("cell", *columns).collect())
    start = preamble(grid.meta, header) + struct.pack("<Q", len(rows))
    at, table, data = len(start) + 16 * len(rows), b"", b""
    for c, *values in rows:
        table += struct.pack("<2Q", c, at + len(data))
        data += struct.pack("<" + codes, *values)
    return start + table + data


def test_bytes(grid, file):
    with open(file, "rb") as f:
        assert f.read() == plain(grid, b"head", COLUMNS, "qdi")
    assert os.listdir(os.path.dirname(file)) == ["g"]


def test_empty_and_overwritten(spark, grid, tmp_path):
    path = str(tmp_path / "e")
    for g in (grid, grid.with_cells(grid.cells.filter("cell < 0"))):
        store.write_binary(g, path, COLUMNS)
    found = store.open_binary(spark, path)
    assert found.cells == 0 and found.load(COLUMNS).cells.count() == 0


def reader(spark, file, monkeypatch=None):
    return store.open_binary(spark, file, 4).rows(COLUMNS)


CONDITIONS = ["cell between 30 and 60", "cell = 49", "cell in (3, 5, 48, 400, -1)", "cell > 40 and n < 200", "cell >= 10 and cell < 10", "cell < 0", "cell > 9000000000000", "cell in (2, 9) or cell = 11", "d > 5.5", "cell is not null and i = 3"]


@pytest.mark.parametrize("condition", CONDITIONS)
def test_filters(spark, grid, file, monkeypatch, condition):
    want = sorted(map(tuple, grid.cells.filter(condition).select("cell", "n", "d", "i").collect()))
    assert sorted(map(tuple, reader(spark, file).filter(condition).collect())) == want


def planned(file, filters, names=("cell", "n")):
    r = gridfile.GridReader({"path": file, "headerLength": "4", "columns": "n:q,d:d,i:i"}, StructType([StructField(n, LongType()) for n in names]))
    left = list(r.pushFilters(filters))
    return r, left, r.partitions()


def test_ranges_that_are_read(grid, file, monkeypatch):
    """The planner gives ranges of rows; those that can't hold wanted ids are in none."""
    cells = sorted(r[0] for r in grid.cells.select("cell").collect())
    monkeypatch.setattr(gridfile, "RANGE", 8)
    count = lambda parts: sum(b - a for p in parts for a, b in p.ranges)
    _, _, whole = planned(file, [])
    assert count(whole) == len(cells) and len(whole) == -(-len(cells) // 8)
    kept, left, some = planned(file, [gridfile.GreaterThanOrEqual(("cell",), 30), gridfile.LessThan(("cell",), 60), gridfile.GreaterThan(("n",), 5)])
    assert [f.attribute for f in left] == [("n",)] and count(some) == sum(30 <= c < 60 for c in cells) and len(some) < len(whole)
    assert sorted(c for p in some for batch in kept.read(p) for c in batch.column("cell").to_pylist()) == [c for c in cells if 30 <= c < 60]
    _, _, none = planned(file, [gridfile.In(("cell",), (-5, 10**9))])
    assert count(none) == 0
    monkeypatch.setattr(gridfile, "RANGES", 2)
    r, _, three = planned(file, [gridfile.In(("cell",), (2, 3, 48, 400))])
    assert sorted(c for p in three for batch in r.read(p) for c in batch.column("cell").to_pylist()) == [c for c in cells if c in (2, 3, 48, 400)]


def test_scan_in_the_plan(spark, file):
    """Spark's own plan has fewer partitions under a filter, and the filter is gone from it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    df = reader(spark, file).filter("cell between 30 and 60")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Filter (" not in plan.replace("PushedFilters", "")
    only = store.open_binary(spark, file, 4).rows(COLUMNS, ("cell", "i"))
    assert only.columns == ["cell", "i"] and only.filter("i = 3").count() == sum(c % 7 == 3 for c, *_ in reader(spark, file).collect())


def test_unsorted_files(spark, grid, tmp_path):
    """Ids in any order: refused by default, whole with the option."""
    rows = [(40, 1), (3, 2), (17, 3)]
    start = preamble(META) + struct.pack("<Q", len(rows))
    first = len(start) + 16 * len(rows)
    path = tmp_path / "u"
    path.write_bytes(start + b"".join(struct.pack("<2Q", c, first + 8 * k) for k, (c, _) in enumerate(rows)) + b"".join(struct.pack("<q", v) for _, v in rows))
    loose = store.open_binary(spark, str(path), ascending=False)
    assert sorted(map(tuple, loose.rows({"n": "q"}).collect())) == sorted(rows) and [tuple(r) for r in loose.rows({"n": "q"}).filter("cell = 3").collect()] == [(3, 2)]
    with pytest.raises(Exception, match="ascend"):
        store.open_binary(spark, str(path)).rows({"n": "q"}).collect()


class Elsewhere:
    """A file system that isn't mounted: only streams, no places."""

    def __init__(self):
        from pyarrow.fs import LocalFileSystem

        self.of = LocalFileSystem()

    def __getattr__(self, name):
        return getattr(self.of, name)


def test_parts_are_joined_where_tasks_cannot_write_at_places(grid, tmp_path, monkeypatch):
    import pyarrow as pa
    from pyspark import TaskContext

    class Attempt:
        def __init__(self, n):
            self.n = n

        def taskAttemptId(self):
            return self.n

    content = plain(grid, b"", COLUMNS, "qdi")
    pieces = [(a, content[a : a + 100]) for a in range(0, len(content), 100)]
    path = str(tmp_path / "x")
    monkeypatch.setattr(gridfile, "_place", lambda p: (Elsewhere(), p))
    writer = gridfile.GridWriter(path, len(content), "t", True)
    messages = []
    for k, mine in enumerate((pieces[::2], pieces[1::2], [])):
        monkeypatch.setattr(TaskContext, "get", staticmethod(lambda k=k: Attempt(k)))
        batches = [pa.RecordBatch.from_pydict({"at": [a], "bytes": [b]}) for a, b in mine]
        messages.append(writer.write(iter(batches)))
    with pytest.raises(OSError):
        writer.commit(messages[:1])
    writer.commit([*messages, None])
    with open(path, "rb") as f:
        assert f.read() == content
    assert os.listdir(tmp_path) == ["x"]


def test_failed_write_leaves_nothing(spark, grid, tmp_path):
    with pytest.raises(Exception):
        store.write_binary(grid, str(tmp_path / "f"), data=F.when(F.col("cell") == 21, F.raise_error(F.lit("no")).cast("binary")).otherwise(F.lit(b"x")))
    assert not os.path.exists(tmp_path / "f")


def test_intervals():
    assert gridfile.within([(0, 5), (8, 9)], [(-3, 0), (4, 8)]) == [(0, 0), (4, 5), (8, 8)]
    assert gridfile.fewer([(0, 1), (3, 4), (10, 11), (12, 12)], 2) == [(0, 4), (10, 12)]
