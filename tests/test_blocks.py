"""Stencils over blocks against stencils by joins, and the shuffles of their plans; pyramids kept by deltas."""

import random

import pytest
from pyspark.sql import functions as F

from cellarium.functions.meta import GridMeta
from cellarium.operators import adapt as A
from cellarium.operators import blocks, stencil
from cellarium.plans.grid import Grid
from cellarium.streaming.pyramid import DeltaPyramid

def sums():
    return {"n": F.count(F.lit(1)), "s": F.sum("n_v"), "x": F.max("ox"), "y": F.min("oy"), "z": F.sum("oz"), "o": F.max("w")}


def refined(spark, meta, seed):
    r = random.Random(seed)
    grid = A.adapt(Grid.level0(spark, meta), refine=r.sample(range(1, meta.level0_cells + 1), meta.level0_cells // 3)).grid
    if meta.max_level > 1:
        grid = A.adapt(grid, refine=grid.cells.filter(f"lvl = 1 and cell % 4 = {seed % 4}").select("cell")).grid
    return grid.with_columns({"v": F.col("cell") * 3 % 101, "w": F.col("cell") % 7}).settled()


CASES = [((7, 5, 3), 1, (False, False, False), 1, 2), ((7, 5, 3), 2, (True, False, True), 1, 2), ((5, 4, 3), 1, (True, True, True), 2, 3), ((6, 3, 2), 2, (False, True, False), 0, 1), ((4, 3, 2), 1, (True, True, True), 1, 8), ((3, 2, 1), 1, (True, True, False), 2, 1)]


@pytest.mark.parametrize("length,level,periodic,hood,side", CASES)
def test_blocks_give_what_joins_give(spark, length, level, periodic, hood, side):
    grid = refined(spark, GridMeta(length, level, periodic, hood), side + level)
    want = stencil.stencil(grid, sums(), ("v",), own=("w",))
    got = blocks.blocked_stencil(grid, sums(), ("v",), own=("w",), side=side)
    assert sorted(map(tuple, got.select("cell", *sums()).collect())) == sorted(map(tuple, want.select("cell", *sums()).collect()))


def test_one_shuffle(spark):
    grid = refined(spark, GridMeta((8, 8, 4), 1), 1)
    unknown = Grid(grid.meta, grid.cells)
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        shuffled = plan(blocks.with_copies(unknown, ("v",), 2).repartition(blocks.BLOCK))
        leaves = blocks.blocked(unknown, ("v",), 2)
        with blocks.joins_within_blocks(spark):
            within = plan(blocks.stencil_in_blocks(unknown, leaves, {"s": F.sum("n_v")}, ("v",)))
        usual = plan(stencil.stencil(unknown, {"s": F.sum("n_v")}, ("v",)))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert shuffled.count("Exchange") == 1 and within.count("Exchange") == 0 and within.count("Join") == 3 and usual.count("Exchange hashpartitioning") > 5


def test_copies_of_borders_only(spark):
    grid = refined(spark, GridMeta((16, 16, 8), 0), 3)
    rows = blocks.with_copies(grid, (), 8)
    assert rows.filter("__own").count() == 16 * 16 * 8 and rows.filter("__own").groupBy("cell").count().filter("count > 1").count() == 0
    assert rows.filter(F.col("__own") & (F.col("ix") < 8) & (F.col("iy") < 8)).select(blocks.BLOCK).distinct().count() == 1


def recount(grid, rows, pyramid):
    return sorted(map(tuple, pyramid.delta(rows).filter("n <> 0 or v <> 0").collect()))


def test_pyramid_of_random_batches(spark, tmp_path):
    """Inserts and deletes, a batch sent again with other rows before the next, one sent again after it was folded, and compactions: always the sums of a recount."""
    grid = refined(spark, GridMeta((4, 3, 2), 2), 2)
    pyramid = DeltaPyramid(spark, f"file://{tmp_path}/p", grid, (F.col("x"), F.col("y"), F.col("z")), {"n": F.lit(1), "v": F.col("v")})
    assert pyramid.totals().count() == 0 and not pyramid.compact()
    r = random.Random(4)
    schema = "x long, y long, z long, v long, sign int"
    make = lambda n: [(r.randint(-1, 16), r.randint(0, 11), r.randint(0, 7), r.randint(-5, 5), 1) for _ in range(n)]
    kept, df = [], lambda rows: spark.createDataFrame(rows, schema)
    for batch in range(6):
        gone = r.sample(kept, len(kept) // 3)
        new = make(60)
        if batch == 2:  # a first attempt with other rows, as after a failure
            assert pyramid.apply(df(make(10)), batch)
        assert pyramid.apply(df(new + [(*g[:4], -1) for g in gone]), batch, F.col("sign"))
        for g in gone:
            kept.remove(g)
        kept += new
        assert sorted(map(tuple, pyramid.totals().collect())) == recount(grid, df(kept), pyramid)
        if batch in (1, 4):
            assert pyramid.compact() and not pyramid.apply(df(make(5)), batch)
            assert sorted(map(tuple, pyramid.totals().collect())) == recount(grid, df(kept), pyramid)


def test_unfinished_folders_are_not_read(spark, tmp_path):
    import os

    grid = Grid.level0(spark, GridMeta((4, 3, 2), 1))
    pyramid = DeltaPyramid(spark, f"file://{tmp_path}/p", grid, (F.col("x"), F.col("x"), F.col("x")), {"n": F.lit(1)})
    rows = spark.createDataFrame([(i,) for i in range(4)], "x long")
    assert pyramid.apply(rows, 0) and pyramid.apply(rows, 1)
    os.remove(tmp_path / "p/batch/1/_SUCCESS")
    assert pyramid.totals().filter("lvl = 0").agg(F.sum("n")).first()[0] == 4
    assert pyramid.apply(rows, 1) and pyramid.totals().filter("lvl = 0").agg(F.sum("n")).first()[0] == 8


def test_stream_that_is_resumed(spark, tmp_path):
    grid = refined(spark, GridMeta((4, 3, 2), 1), 1)
    pyramid = DeltaPyramid(spark, f"file://{tmp_path}/p", grid, (F.col("x"), F.col("y"), F.col("z")), {"n": F.lit(1), "v": F.col("v")})
    r, schema = random.Random(5), "x long, y long, z long, v long"
    rows = []
    for part in range(3):
        new = [(r.randint(0, 7), r.randint(0, 5), r.randint(0, 3), r.randint(0, 9)) for _ in range(40)]
        rows += new
        spark.createDataFrame(new, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(schema).parquet(f"{tmp_path}/in")
        pyramid.follow(stream, f"file://{tmp_path}/c", availableNow=True).awaitTermination()
        if part == 1:
            pyramid.compact()
        assert sorted(map(tuple, pyramid.totals().collect())) == recount(grid, spark.createDataFrame(rows, schema), pyramid)
