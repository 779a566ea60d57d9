"""Sums per cell of every level, kept up to date by deltas: what a batch adds or takes away, summed per ancestor, beside what was there.

A batch costs what it holds: its rows are summed by lattice point, points meet leaves, leaf sums go up the levels, and the sums of the batch become a folder of
their own. Totals are the sums over all folders, so nothing is recounted. A folder is named by its batch's number and counts once Spark has finished it, so a
batch that is sent again, as a stream does after a failure, replaces itself. Compaction folds all batches up to a number into one base; batches up to that number that are sent
again are passed over. Numbers ascend, and one writer sends batches, as foreachBatch does.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions import mapping
from ..plans.grid import Grid
from ..sources.binning import sums_per_leaf


class DeltaPyramid:
    """In a folder that driver and executors share. index: lattice indices of a row. sums: name -> what a row counts for, a whole number. Rows outside the grid are passed over."""

    def __init__(self, spark: SparkSession, path: str, grid: Grid, index: tuple[Column, Column, Column], sums: dict[str, Column]):
        self.spark, self.path, self.grid, self.index, self.sums = spark, path.rstrip("/"), grid, index, sums
        self.schema = "cell long, lvl int, " + ", ".join(f"`{k}` long" for k in sums)
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def _finished(self, kind: str) -> list[int]:
        at = self._path(f"{self.path}/{kind}")
        if not self._fs.exists(at):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(at)]
        return sorted(int(n) for n in names if n.isdigit() and self._fs.exists(self._path(f"{self.path}/{kind}/{n}/_SUCCESS")))

    def _base(self) -> int:
        """The last batch that the newest base holds; -1 without one."""
        return max(self._finished("base"), default=-1)

    def delta(self, rows: DataFrame, sign: Column | int = 1) -> DataFrame:
        """cell, lvl and sums that rows add. sign: -1 for rows that go, also by row."""
        sign = sign if isinstance(sign, Column) else F.lit(sign)
        meta = self.grid.meta
        leaves = sums_per_leaf(self.grid, rows, self.index, {k: (sign * v).cast("long") for k, v in self.sums.items()}).filter("cell <> 0")
        placed = mapping.with_place(leaves, meta)
        index = (F.col("ix"), F.col("iy"), F.col("iz"))
        ups = F.array(*[F.when(F.col("lvl") >= k, F.struct(mapping.ancestor(meta, index, k).alias("cell"), F.lit(k).alias("lvl"))) for k in range(meta.max_level + 1)])
        each = placed.select(F.explode(F.array_compact(ups)).alias("__up"), *self.sums)
        return each.groupBy("__up.cell", "__up.lvl").agg(*[F.sum(k).alias(k) for k in self.sums])

    def apply(self, rows: DataFrame, batch: int, sign: Column | int = 1) -> bool:
        """Add a batch; False if a base holds it already."""
        if batch <= self._base():
            return False
        self.delta(rows, sign).write.mode("overwrite").parquet(f"{self.path}/batch/{batch}")
        return True

    def follow(self, stream: DataFrame, checkpoint: str, sign: Column | int = 1, **trigger) -> StreamingQuery:
        """Add what a stream brings, batch by batch. trigger: as of DataStreamWriter.trigger."""
        writer = stream.writeStream.foreachBatch(lambda rows, batch: self.apply(rows, batch, sign) and None).option("checkpointLocation", checkpoint)
        return (writer.trigger(**trigger) if trigger else writer).start()

    def _listed(self) -> tuple[int, list[int]]:
        base = self._base()
        return base, [b for b in self._finished("batch") if b > base]

    def _summed(self, base: int, batches: list[int]) -> DataFrame:
        folders = ([f"{self.path}/base/{base}"] if base >= 0 else []) + [f"{self.path}/batch/{b}" for b in batches]
        rows = self.spark.read.schema(self.schema).parquet(*folders) if folders else self.spark.createDataFrame([], self.schema)
        out = rows.groupBy("cell", "lvl").agg(*[F.sum(k).alias(k) for k in self.sums])
        some = F.lit(False)
        for k in self.sums:
            some = some | (F.col(f"`{k}`") != 0)
        return out.filter(some)

    def totals(self) -> DataFrame:
        """cell, lvl and sums; cells whose sums are all 0 are left out."""
        return self._summed(*self._listed())

    def compact(self) -> bool:
        """Fold all finished batches into a new base, then delete what it holds. A compaction that dies leaves an unfinished base, which nobody reads."""
        base, batches = self._listed()
        if not batches:
            return False
        self._summed(base, batches).write.mode("overwrite").parquet(f"{self.path}/base/{batches[-1]}")
        for b in batches:
            self._fs.delete(self._path(f"{self.path}/batch/{b}"), True)
        if base >= 0:
            self._fs.delete(self._path(f"{self.path}/base/{base}"), True)
        return True
