"""Boxes and points by intervals of the space-filling curve."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from cellarium.functions import curve
from cellarium.functions.meta import GridMeta
from cellarium.operators import adapt as A
from cellarium.operators import lookup as L
from cellarium.plans import queries
from cellarium.plans.grid import Grid
from cellarium.sources import binning, store

META = GridMeta((5, 3, 2), 2)


@pytest.fixture(scope="module")
def grid(spark):
    grid = A.adapt(Grid.level0(spark, META), refine=[1, 8, 30]).grid
    return A.adapt(grid, refine=grid.cells.filter("lvl = 1 and ix < 4").select("cell")).grid.settled()


@pytest.mark.parametrize("most", [0, 1, 5, 64, 1000])
def test_intervals_hold_all_cells_of_a_box(grid, most):
    cells = [r.asDict() for r in grid.cells.select("cell", "lvl", "ix", "iy", "iz", "len", curve.key(META, (F.col("ix"), F.col("iy"), F.col("iz"))).alias("k"), curve.keys_of_level(META, F.col("lvl")).alias("n")).collect()]
    taken = sorted((c["k"], c["k"] + c["n"] - 1) for c in cells)
    assert all(b < c for (_, b), (c, _) in zip(taken, taken[1:]))  # leaves hold disjoint intervals
    r = random.Random(most)
    for _ in range(60):
        low = tuple(r.randint(-2, n) for n in META.extent)
        high = tuple(a + r.randint(0, 9) for a in low)
        found = curve.box_intervals(META, low, high, most)
        assert all(b + 1 < c for (_, b), (c, _) in zip(found, found[1:]))
        want = {c["cell"] for c in cells if all(c[i] <= b and c[i] + c["len"] > a for i, a, b in zip(("ix", "iy", "iz"), low, high))}
        hit = {c["cell"] for c in cells if any(a <= c["k"] <= b for a, b in found)}
        assert want <= hit
        if most == 1000:  # nothing is left unsplit: only leaves that start where a split block (of eight keys or more) starts may be too many
            assert all(c["k"] % 8 == 0 for c in cells if c["cell"] in hit - want)


def scanned(df):
    """Rows that the scans of a plan gave, after it has run."""
    df.collect()
    nodes, out = [df._jdf.queryExecution().executedPlan()], 0
    while nodes:
        node = nodes.pop()
        if node.getClass().getSimpleName() == "AdaptiveSparkPlanExec":
            nodes.append(node.executedPlan())
            continue
        if node.getClass().getSimpleName() == "FileSourceScanExec":
            out += node.metrics().apply("numOutputRows").value()
        kids = node.children()
        nodes += [kids.apply(i) for i in range(kids.size())]
        if node.getClass().getSimpleName().endswith("QueryStageExec"):
            nodes.append(node.plan())
    return out


def test_row_groups_are_skipped(spark, grid, tmp_path):
    store.save_on_curve(grid, str(tmp_path / "g"), files=12)
    again, _ = store.load(spark, str(tmp_path / "g"))
    for low, high in [((0, 0, 0), (3, 2, 1)), ((9, 5, 3), (12, 9, 6)), ((0, 0, 0), (19, 11, 7)), ((40, 0, 0), (50, 2, 2)), ((3, 3, 3), (2, 5, 5))]:
        box = L.cells_in_box(again, low, high)
        assert sorted(r["cell"] for r in box.collect()) == sorted(r["cell"] for r in L.cells_in_box(grid, low, high).collect())
    total = again.cells.count()
    assert scanned(again.cells) == total
    few = L.cells_in_box(again, (9, 5, 3), (12, 9, 6))
    assert 0 < few.count() <= scanned(few.select("cell")) < total / 3


@pytest.mark.parametrize("block_level,hot", [(0, 10**6), (1, 10**6), (2, 50), (0, 20)])
def test_points_by_intervals(spark, grid, monkeypatch, block_level, hot):
    """Each point's leaf as candidates give it, with hot blocks dealt out, points outside, nulls, repeats and clashing names."""
    monkeypatch.setattr(L, "HOT_POINTS", hot)
    r = random.Random(7)
    rows = [(i, *(r.randint(-1, n) for n in META.extent), "x") for i in range(300)] + [(900, 0, 0, 0, "x")] * 90 + [(901, None, 1, 1, None)]
    points = spark.createDataFrame(rows, "id long, ix long, iy long, iz long, cell string")
    at = (F.col("ix"), F.col("iy"), F.col("iz"))
    pick = lambda df: sorted(map(tuple, df.select("id", "ix", "iy", "iz", "cell").collect()), key=repr)
    want = L.existing_at_indices(grid, points.drop("cell"), at, by="candidates")
    got = L.at_intervals(grid, points, at, block_level=block_level)
    assert pick(got) == pick(want)
    for lo, hi in itertools.product(range(3), range(3)):
        a = L.existing_at_indices(grid, points.drop("cell"), at, lo, hi, by="candidates")
        b = L.existing_at_indices(grid, points.drop("cell"), at, lo, hi, by="intervals")
        assert pick(a) == pick(b)


@pytest.fixture
def settled_plans(monkeypatch):
    """Optimized plans of what at_intervals settles."""
    plans, settle = [], L.settle

    def kept(df):
        plans.append(df._jdf.queryExecution().optimizedPlan().toString())
        return settle(df)

    monkeypatch.setattr(L, "settle", kept)
    return plans


def costly(spark, n):
    """Rows with indices that take a while to compute, of which no index names another."""
    return spark.range(n).select(F.col("id"), *[F.round(F.col("id") % k / 10 * 10).cast("long").alias(c) for c, k in (("ix", 23), ("iy", 13), ("iz", 9))])


def test_keys_name_indices_a_few_times(spark, settled_plans, grid):
    """The pass for hot blocks computes costly indices of rows a few times, not once for each step of the key, also where points are distinct rows."""
    at = (F.col("ix"), F.col("iy"), F.col("iz"))
    for points in (costly(spark, 300), costly(spark, 300).select("ix", "iy", "iz").distinct()):
        L.at_intervals(grid, points, at)
    assert len(settled_plans) == 2 and all(3 <= plan.count("round(") <= 20 for plan in settled_plans)


@pytest.mark.parametrize("name", ["stencil_by_blocks", "bin_points_adaptive", "existing_cell_in_levels"])
def test_hot_blocks_are_counted_without_the_table(spark, sf_dir, settled_plans, name):
    """Lattice points of rows are written before they are looked up, so the table isn't read once more for the pass over blocks."""
    queries.QUERIES[name](spark, sf_dir)
    assert settled_plans and not any("Relation" in plan for plan in settled_plans)


@pytest.mark.parametrize("name", ["bin_points_adaptive", "existing_cell_in_levels", "stencil_by_blocks", "stencil_sum"])
def test_refining_and_counting_read_the_table_once(spark, sf_dir, monkeypatch, name):
    plans, settle = [], L.settle

    def kept(df):
        plans.append(df._jdf.queryExecution().optimizedPlan().toString())
        return settle(df)

    for module in (A, L, binning, queries):
        monkeypatch.setattr(module, "settle", kept)
    kept(queries.QUERIES[name](spark, sf_dir))
    assert sum(plan.count("Relation [") for plan in plans) == 1


def test_keys_against_bits(spark):
    r = random.Random(3)
    rows = [tuple(r.randrange(1 << r.randint(0, curve.BITS)) for _ in range(3)) for _ in range(500)] + [(0, 0, 0), ((1 << curve.BITS) - 1,) * 3, (0, 127, 128)]
    out = spark.createDataFrame([*rows, (None, 1, 2)], "ix long, iy long, iz long").select("*", curve.key(META, (F.col("ix"), F.col("iy"), F.col("iz"))).alias("k"))
    assert all(x["k"] == (None if x["ix"] is None else curve.interleaved(x["ix"], x["iy"], x["iz"])) for x in out.collect())


def test_many_leaves_are_looked_up_by_intervals(spark, grid):
    """Where leaves aren't known to be few there is one shuffle, whatever the number of levels."""
    unknown = Grid(META, grid.cells)
    points = spark.range(100).select(F.col("id"), (F.col("id") % 20).alias("ix"), (F.col("id") % 12).alias("iy"), (F.col("id") % 8).alias("iz"))
    out = L.existing_at_indices(unknown, points, (F.col("ix"), F.col("iy"), F.col("iz")))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan


def test_long_indices():
    deep = GridMeta((1, 1, 1), 20)
    wide = GridMeta((1 << 10, 1, 1), 12)
    assert curve.shift(deep) == 0 and curve.shift(wide) == 1
    assert curve.box_intervals(wide, (0, 0, 0), (wide.extent[0], 0, 0), 3)[0][0] == 0
