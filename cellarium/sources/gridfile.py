"""Binary grid files as a Spark data source, `cellgrid`, for reading and writing.

Reading. The planner reads the preamble and, with filters on the cell's id, a few entries of the table of cells, by
bisection; partitions are ranges of that table that can hold wanted ids, packed up to RANGE cells. A task reads its ranges' table and the
bytes of their data. Columns that the schema doesn't name are not unpacked, and without any data column the data isn't read.
Filters on the id (comparisons with values, in, and both joined by and) are evaluated here, exactly; others are left to Spark.

Writing. Rows are pieces of the file: where they start and their bytes. Where the path is of a mounted file system, tasks write
at their places in one new file; elsewhere each writes a file of pieces, which the commit joins. A piece that a retried task writes again
has the same place and bytes. The file gets its name at the commit, once all bytes are accounted for, so readers never see a part of it.

Options of both: path. Reading: columns (`name:code,...` in the order of a cell's data, codes q, d and i of the struct module;
without it the data is one binary column), headerLength, sorted (false for a file whose ids don't ascend: no range is left out then).
Writing: length (of the file), token (a name for this write).
"""

from __future__ import annotations

import bisect
import os
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow.fs import FileSystem, FileType, LocalFileSystem
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, LessThan, LessThanOrEqual, WriterCommitMessage
from pyspark.sql.types import StructType

from .layout import read_head

NAME = "cellgrid"
#: Cells of one partition, ranges that one scan bisects for at most (nearer ones are joined and filtered in tasks), and bytes that a task handles at once.
RANGE, RANGES, PIECE = 1 << 17, 1024, 1 << 22
LAST = 2**63 - 1
#: Struct codes of cell data by Spark type, numpy's and Arrow's names of them.
KIND = {"q": "long", "d": "double", "i": "int"}
_NUMPY = {"q": "<i8", "d": "<f8", "i": "<i4"}
_ARROW = {"q": pa.int64(), "d": pa.float64(), "i": pa.int32()}

Interval = tuple[int, int]


def register(spark: SparkSession) -> None:
    """Make the format known to a session, and let it see filters."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(GridSource)


def columns_of(option: str | None) -> dict[str, str]:
    out = dict(c.strip().rsplit(":", 1) for c in option.split(",")) if option else {}
    if any(k not in KIND for k in out.values()):
        raise ValueError(f"columns are name:code with codes {', '.join(KIND)}")
    return out


def _place(path: str) -> tuple[FileSystem, str]:
    return FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (LocalFileSystem(), os.path.abspath(path))


def _flag(value: str | None, default: bool) -> bool:
    return default if value is None else value.lower() == "true"


class GridSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        columns = columns_of(self.options.get("columns"))
        return "cell long" + ("".join(f", `{c}` {KIND[k]}" for c, k in columns.items()) if columns else ", data binary")

    def reader(self, schema: StructType) -> DataSourceReader:
        return GridReader(dict(self.options.items()), schema)

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        return GridWriter(self.options["path"], int(self.options["length"]), self.options["token"], overwrite)


# --- reading -------------------------------------------------------------------------------------------------------------


def within(intervals: list[Interval], others: list[Interval]) -> list[Interval]:
    """What two lists of ascending intervals (both ends in them) have in common."""
    out, i, j = [], 0, 0
    while i < len(intervals) and j < len(others):
        low, high = max(intervals[i][0], others[j][0]), min(intervals[i][1], others[j][1])
        if low <= high:
            out.append((low, high))
        if intervals[i][1] < others[j][1]:
            i += 1
        else:
            j += 1
    return out


def fewer(intervals: list[Interval], most: int) -> list[Interval]:
    """At most so many intervals that cover ascending ones: the smallest gaps are closed."""
    if len(intervals) <= most:
        return intervals
    gaps = sorted(range(1, len(intervals)), key=lambda i: intervals[i][0] - intervals[i - 1][1], reverse=True)
    starts = [0, *sorted(gaps[: most - 1])]
    return [(intervals[a][0], intervals[b - 1][1]) for a, b in zip(starts, [*starts[1:], len(intervals)])]


@dataclass
class Rows(InputPartition):
    """Ranges (start, end) of the table of cells."""

    ranges: list[Interval]

    def __post_init__(self):
        super().__init__(self.ranges)


class GridReader(DataSourceReader):
    def __init__(self, options: dict[str, str], schema: StructType):
        low = {k.lower(): v for k, v in options.items()}
        self.path, self.header_length, self.sorted = low["path"], int(low.get("headerlength", 0)), _flag(low.get("sorted"), True)
        self.columns, self.names = columns_of(low.get("columns")), schema.names
        unknown = set(self.names) - {"cell", *(self.columns or ("data",))}
        if unknown:
            raise ValueError(f"the file's columns don't include {', '.join(sorted(unknown))}")
        self.wanted: list[Interval] = [(-LAST - 1, LAST)]

    # planning

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            found = self._interval(f)
            if found is None:
                yield f
            else:
                self.wanted = within(self.wanted, found)

    @staticmethod
    def _interval(f: Filter) -> list[Interval] | None:
        if getattr(f, "attribute", None) != ("cell",):
            return None
        if isinstance(f, IsNotNull):
            return [(-LAST - 1, LAST)]
        if isinstance(f, In):
            return [(v, v) for v in sorted({v for v in f.value if v is not None})]
        kinds = ((EqualTo, lambda v: (v, v)), (GreaterThanOrEqual, lambda v: (v, LAST)), (GreaterThan, lambda v: (v + 1, LAST)), (LessThanOrEqual, lambda v: (-LAST - 1, v)), (LessThan, lambda v: (-LAST - 1, v - 1)))
        for kind, interval in kinds:
            if isinstance(f, kind):
                return [interval(f.value)] if interval(f.value)[0] <= interval(f.value)[1] else []
        return None

    def partitions(self) -> list[Rows]:
        fs, name = _place(self.path)
        with fs.open_input_file(name) as f:
            _, _, n, table = read_head(lambda k: f.read_at(k, 0), f.size(), self.header_length)
            if self.sorted and self.wanted != [(-LAST - 1, LAST)]:
                # the place of the first id that is at least so much
                place = lambda v: bisect.bisect_left(range(n), v, key=lambda i: int.from_bytes(f.read_at(8, table + 16 * i), "little"))
                rows = [(place(a), n if b == LAST else place(b + 1)) for a, b in fewer(self.wanted, RANGES)]
            else:
                rows = [(0, n)] if self.wanted else []
        out, held, size = [], [], 0
        for a, b in rows:
            while a < b:
                end = min(b, a + RANGE - size)
                held.append((a, end))
                size += end - a
                a = end
                if size == RANGE:
                    out.append(Rows(held))
                    held, size = [], 0
        return [*out, Rows(held)] if held or not out else out

    # reading, in tasks

    def read(self, partition: Rows) -> Iterator[pa.RecordBatch]:
        fs, name = _place(self.path)
        with fs.open_input_file(name) as f:
            length = f.size()
            _, _, n, table = read_head(lambda k: f.read_at(k, 0), length, self.header_length)
            for a, b in partition.ranges:
                yield from self._range(f, a, b, n, table, length)

    def _range(self, f, a: int, b: int, n: int, table: int, length: int) -> Iterator[pa.RecordBatch]:
        more = 1 if b < n else 0  # where the next cell's data starts
        entries = np.frombuffer(f.read_at(16 * (b - a + more), table + 16 * a), "<u8").reshape(-1, 2).astype(np.int64)
        ids, at = entries[: b - a, 0], np.append(entries[:, 1], [] if more else [length]).astype(np.int64)
        if self.sorted and (np.diff(entries[:, 0]) <= 0).any():
            raise ValueError("ids of this file don't ascend: read it with option sorted = false")
        low, high = np.array([w[0] for w in self.wanted]), np.array([w[1] for w in self.wanted])
        k = np.searchsorted(low, ids, "right") - 1
        keep = np.flatnonzero((k >= 0) & (ids <= high[k]))
        # at most about a piece of data at once
        size = np.dtype([(c, _NUMPY[k]) for c, k in self.columns.items()]).itemsize if self.columns else 0
        sizes = np.full(len(keep), size) if self.columns else at[keep + 1] - at[keep]
        cuts = np.flatnonzero(np.diff(np.cumsum(sizes) // PIECE)) + 1 if self.names != ["cell"] else []
        for rows in np.split(keep, cuts):
            if len(rows):
                yield self._batch(f, ids[rows], at[rows], at[rows + 1])

    def _batch(self, f, ids: np.ndarray, begin: np.ndarray, end: np.ndarray) -> pa.RecordBatch:
        columns = {"cell": pa.array(ids)}
        if self.names == ["cell"]:
            pass
        elif self.columns:
            kind = np.dtype([(c, _NUMPY[k]) for c, k in self.columns.items()])
            first, last = int(begin.min()), int(begin.max()) + kind.itemsize
            if last - first == kind.itemsize * len(ids) and (np.diff(begin) == kind.itemsize).all():
                values = np.frombuffer(f.read_at(last - first, first), kind)
            else:
                values = np.frombuffer(b"".join(f.read_at(kind.itemsize, int(x)) for x in begin), kind)
            columns |= {c: pa.array(np.ascontiguousarray(values[c]), _ARROW[k]) for c, k in self.columns.items() if c in self.names}
        else:
            columns["data"] = pa.array([f.read_at(int(b - a), int(a)) for a, b in zip(begin, end)], pa.binary())
        return pa.RecordBatch.from_arrays([columns[c] for c in self.names], names=self.names)


# --- writing -------------------------------------------------------------------------------------------------------------


@dataclass
class Written(WriterCommitMessage):
    bytes: int
    #: The task's file of pieces and where each piece belongs (start, length), if it has a file of its own.
    part: str | None = None
    pieces: tuple[tuple[int, int], ...] = ()


class GridWriter(DataSourceArrowWriter):
    def __init__(self, path: str, length: int, token: str, overwrite: bool):
        self.path, self.length, self.token, self.overwrite = path, length, token, overwrite

    def _target(self) -> tuple[FileSystem, str, str]:
        fs, name = _place(self.path)
        return fs, name, f"{os.path.dirname(name)}/.{os.path.basename(name)}.{self.token}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        from pyspark import TaskContext

        fs, _, unnamed = self._target()
        return self._at_places(unnamed, iterator) if isinstance(fs, LocalFileSystem) else self._apart(fs, f"{unnamed}.{TaskContext.get().taskAttemptId()}", iterator)

    @staticmethod
    def _pieces(iterator: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, memoryview]]:
        for batch in iterator:
            for at, content in zip(batch.column("at"), batch.column("bytes")):
                yield at.as_py(), memoryview(content.as_buffer())

    def _at_places(self, unnamed: str, iterator: Iterator[pa.RecordBatch]) -> Written:
        os.makedirs(os.path.dirname(unnamed), exist_ok=True)
        total, file = 0, os.open(unnamed, os.O_WRONLY | os.O_CREAT, 0o644)
        try:
            for at, content in self._pieces(iterator):
                total += len(content)
                while content:
                    done = os.pwrite(file, content, at)
                    at, content = at + done, content[done:]
            os.fsync(file)
        finally:
            os.close(file)
        return Written(total)

    def _apart(self, fs: FileSystem, part: str, iterator: Iterator[pa.RecordBatch]) -> Written:
        pieces = []
        with fs.open_output_stream(part) as out:
            for at, content in self._pieces(iterator):
                out.write(content)
                pieces.append((at, len(content)))
        return Written(sum(n for _, n in pieces), part, tuple(pieces))

    def commit(self, messages: list[Written | None]) -> None:
        fs, name, unnamed = self._target()
        done = [m for m in messages if m is not None]
        total = sum(m.bytes for m in done)
        if total != self.length:
            raise OSError(f"{total} bytes were written of {self.length}")
        if not self.overwrite and fs.get_file_info(name).type != FileType.NotFound:
            raise FileExistsError(name)
        parts = [m.part for m in done if m.part is not None]
        if parts:
            self._join(fs, unnamed, done)
        fs.move(unnamed, name)
        for p in parts:
            fs.delete_file(p)

    @staticmethod
    def _join(fs: FileSystem, target: str, done: list[Written]) -> None:
        places = []
        for m in done:
            at = 0
            for start, n in m.pieces:
                places.append((start, n, m.part, at))
                at += n
        opened = {m.part: fs.open_input_file(m.part) for m in done if m.part is not None}
        try:
            with fs.open_output_stream(target) as out:
                for _, n, part, at in sorted(places):
                    out.write(opened[part].read_at(n, at))
        finally:
            for f in opened.values():
                f.close()

    def abort(self, messages: list[Written | None]) -> None:
        fs, _, unnamed = self._target()
        for name in (unnamed, *(m.part for m in messages if m is not None and m.part is not None)):
            if fs.get_file_info(name).type == FileType.File:
                fs.delete_file(name)
