"""Small exact cases, a plain walk as an oracle for neighbors, and files."""

import math
import random

import pytest
from pyspark.sql import functions as F

from cellarium.functions import geometry, mapping
from cellarium.functions.meta import Cartesian, GridMeta, Stretched, hood_offsets
from cellarium.operators import adapt as A
from cellarium.operators import boundary as B
from cellarium.operators import checks, lookup, neighbors, partition, workloads
from cellarium.plans.grid import Grid
from cellarium.sources import store


def ids(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect()) if len(columns) > 1 else sorted(r[0] for r in df.select(*columns).collect())


class Plain:
    """Cell arithmetic with Python integers."""

    def __init__(self, meta):
        self.m = meta

    def place(self, c):
        level = next(k for k in range(self.m.max_level + 1) if c <= self.m.cells_before(k + 1))
        r, (x, y, _), f = c - 1 - self.m.cells_before(level), self.m.length, 1 << (self.m.max_level - level)
        w, h = x << level, y << level
        return level, (r % w * f, r // w % h * f, r // (w * h) * f), f

    def at(self, i, level):
        f, (x, y, _) = 1 << (self.m.max_level - level), self.m.length
        return 1 + self.m.cells_before(level) + i[0] // f + i[1] // f * (x << level) + i[2] // f * (x << level) * (y << level)

    def neighbors(self, leaves):
        """By looking for the leaf around every smallest cell of every target box."""
        owner = {}
        for c in leaves:
            _, (x, y, z), n = self.place(c)
            owner.update({(x + a, y + b, z + d): c for a in range(n) for b in range(n) for d in range(n)})
        out = set()
        for c in leaves:
            _, i, n = self.place(c)
            for k, h in enumerate(hood_offsets(self.m.hood)):
                t = [a + b * n for a, b in zip(i, h)]
                if any(not p and not 0 <= v < e for v, e, p in zip(t, self.m.extent, self.m.periodic)):
                    continue
                w = [v % e for v, e in zip(t, self.m.extent)]
                for nbr in {owner[w[0] + a, w[1] + b, w[2] + d] for a in range(n) for b in range(n) for d in range(n)}:
                    o = self.place(nbr)[1]
                    out.add((c, k, nbr, *(tv - iv + ov - wv for tv, iv, ov, wv in zip(t, i, o, w))))
        return out


@pytest.mark.parametrize("seed,hood", [(1, 0), (2, 1), (3, 2)])
def test_neighbors_against_walk(spark, seed, hood):
    r = random.Random(seed)
    meta = GridMeta(tuple(r.randint(2, 3) for _ in range(3)), 2, tuple(r.random() < 0.5 for _ in range(3)), hood)
    grid = Grid.level0(spark, meta)
    for _ in range(2):
        leaves = ids(grid.cells, "cell")
        grid = A.adapt(grid, refine=r.sample(leaves, max(1, len(leaves) // 6))).grid
    leaves = ids(grid.cells, "cell")
    got = {tuple(x) for x in neighbors.neighbors_of(grid).select("cell", "ord", "nbr", "ox", "oy", "oz").collect()}
    assert got == Plain(meta).neighbors(leaves)
    for broken in (checks.level_jumps, checks.overlapping_leaves, checks.missing_neighbors, checks.one_sided, checks.bad_places):
        assert broken(grid).count() == 0
    v = checks.volume(grid).first()
    assert v["volume"] == v["expected"]


def test_metadata_limits():
    assert GridMeta((2, 1, 1), -1).max_level == 20 and GridMeta((15, 15, 1), -1).max_level == 18 and GridMeta((100, 100, 100), -1).max_level == 14
    for bad in (lambda: GridMeta((0, 1, 1)), lambda: GridMeta((1, 1, 1), 22), lambda: Cartesian((0, 0, 0), (1, 0, 1)), lambda: Stretched(((0, 0), (0, 1), (0, 1))), lambda: GridMeta((2, 1, 1), geometry=Stretched())):
        with pytest.raises(ValueError):
            bad()
    meta = GridMeta((2, 1, 1), 3, (True, False, True), 2, Stretched(((0.0, 1.0, 3.0), (0.0, 1.0), (0.0, 1.0))))
    assert GridMeta.from_json(meta.to_json()) == meta


def test_periodic_single_cell_has_itself_on_all_sides(spark):
    for periodic, faces in (((True,) * 3, 6), ((True, True, False), 4), ((False,) * 3, 0)):
        grid = Grid.level0(spark, GridMeta((1, 1, 1), 0, periodic))
        assert neighbors.face_neighbors(grid).count() == faces
        cache = neighbors.face_cache(grid).first()
        assert sum(v == 1 for k, v in cache.asDict().items() if k != "cell") == faces


def test_stencil_sizes_in_periodic_cube(spark):
    grid = Grid.level0(spark, GridMeta((10, 10, 10), 0, (True,) * 3, 2)).add_hood("corner", [(-2, -2, -2)])
    assert neighbors.neighbors_of(grid).count() == 124 * 1000 and neighbors.neighbors_to(grid).count() == 124 * 1000
    assert neighbors.neighbors_of(grid, "corner").count() == 1000
    for bad in ([(3, 0, 0)], [(0, 0, 0)]):
        with pytest.raises(ValueError):
            grid.add_hood("bad", bad)
    with pytest.raises(ValueError):
        grid.add_hood("corner", [(1, 0, 0)])
    assert "corner" not in grid.remove_hood("corner").hoods


def test_neighbor_types_of_seven_cells(spark):
    owners = spark.createDataFrame(list(enumerate([0, 0, 1, 0, 1, 0, 0], 1)), "cell long, part int")
    grid = Grid.of(GridMeta((7, 1, 1), 0, hood=2), owners, 7).add_hood("right", [(2, 0, 0)]).add_hood("off", [(0, 1, 0), (0, 0, 1)])
    got = {c: ids(lookup.get_cells(grid, 0, [m], True, "right"), "cell") for c, m in (("local_of", 1), ("local_to", 2), ("remote_of", 4), ("remote_to", 8), ("local_both", 3))}
    assert got == {"local_of": [2], "local_to": [6], "remote_of": [1], "remote_to": [7], "local_both": [4]}
    assert ids(lookup.get_cells(grid, 1, [6], True, "right"), "cell") == [5] and ids(lookup.get_cells(grid, 1, [9], True, "right"), "cell") == [3]
    assert ids(lookup.get_cells(grid, 1, [lookup.REMOTE_OF | lookup.LOCAL_TO], False, "right"), "cell") == [5]
    assert lookup.get_cells(grid, None, [15], False, "off").count() == 0
    assert ids(B.inner_cells(grid, "off"), "cell") == list(range(1, 8))


def test_veto_keeps_cell_whole(spark):
    grid = Grid.level0(spark, GridMeta((3, 1, 1), 3))
    for asked in ([1, 2], [6, 7], [3, 8]):
        grid = A.adapt(grid, refine=asked, dont_refine=[1]).grid
        assert 1 in ids(grid.cells, "cell") and 4 not in ids(grid.cells, "cell")


def test_refine_and_merge_back(spark):
    grid = Grid.level0(spark, GridMeta((2, 1, 1), 2)).with_columns({"v": F.col("cell").cast("double")})
    fine = A.adapt(grid, refine=[1], prolong={"v": F.col("v") / 8})
    assert fine.new.count() == 8 and ids(fine.refined_data, "cell", "v") == [(1, 1.0)]
    one = ids(fine.new, "cell")[:1]
    back = A.adapt(fine.grid, unrefine=one, restrict={"v": F.sum("v")})
    assert ids(back.grid.cells, "cell", "v") == [(1, 1.0), (2, 2.0)] and back.removed.count() == 8
    assert A.adapt(fine.grid, unrefine=one, dont_unrefine=one).removed.count() == 0
    assert A.adapt(fine.grid, unrefine=one, refine=one).removed.count() == 0
    assert A.adapt(Grid.level0(spark, GridMeta((2, 1, 1), 0)), refine=[1]).new.count() == 0


@pytest.mark.parametrize("hood,periodic,seed", [(1, (True, False, True), 1), (2, (True, False, True), 3), (0, (False, True, False), 4)])
def test_pairs_kept_by_deltas(spark, hood, periodic, seed):
    """After each of a sequence of refinements, vetoes and merges the kept pairs are those of a rebuild, and the grids are those without kept pairs."""
    r = random.Random(seed)
    grid = Grid.level0(spark, GridMeta((4, 3, 3), 3, periodic, hood))
    pairs = spark.createDataFrame([], "coarse long, fine long")
    for turn in range(3):
        cells = ids(grid.cells, "cell")
        ask = {"refine": r.sample(cells, min(len(cells), 5)), "dont_refine": r.sample(cells, 2)}
        if turn > 1:
            ask["unrefine"] = r.sample(cells, len(cells) // 2)
        done = A.adapt(grid, pairs=pairs, **ask)
        if turn > 1:
            plain = A.adapt(grid, **ask)
            assert ids(done.grid.cells, "cell") == ids(plain.grid.cells, "cell") and plain.pairs is None
        assert ids(done.pairs, "coarse", "fine") == ids(A.level_pairs(done.grid), "coarse", "fine")
        grid, pairs = done.grid, done.pairs


def test_load_cells(spark):
    wanted = [9001, 10600, 73000, 37_449_001]
    grid = A.load_cells(Grid.level0(spark, GridMeta((10, 10, 10), 5, hood=2)), wanted)
    assert ids(grid.cells.filter(F.col("cell").isin(wanted)), "cell") == wanted[:3]
    assert checks.level_jumps(grid).count() == 0


def test_geometries_agree(spark):
    shape = Cartesian((-1.0, 2.0, 0.5), (0.5, 0.25, 2.0))
    a = GridMeta((3, 2, 4), 2, (True, False, True), geometry=shape)
    b = a.with_(geometry=Stretched.of(shape, a.length))
    df = spark.range(0, a.last_cell + 2).withColumnRenamed("id", "cell")
    for f in (geometry.center, geometry.minimum, geometry.maximum, geometry.length):
        x, y = (ids(df.select("cell", *[c.alias(n) for c, n in zip(f(m, F.col("cell")), "xyz")]).na.fill(-99.0), "cell", "x", "y", "z") for m in (a, b))
        assert len(x) == len(y) and all(p[0] == q[0] and all(abs(u - v) < 1e-12 for u, v in zip(p[1:], q[1:])) for p, q in zip(x, y))
    points = spark.createDataFrame([(x, y, z) for x in (-1.0, -0.3, 0.5, 7.2, -4.1) for y in (2.0, 2.4, 2.5, 1.9) for z in (0.5, 3.3, 8.5, 9.0)], "x double, y double, z double")
    at = lambda m: ids(points.select("x", "y", "z", geometry.cell_at_point(m, F.lit(2), (F.col("x"), F.col("y"), F.col("z"))).alias("c")), "x", "y", "z", "c")
    assert at(a) == at(b)
    assert {r[3] for r in at(a) if r[1] in (2.5, 1.9)} == {0}


@pytest.mark.parametrize("n", [1, 2, 3, 40, 200])
def test_edges_by_bisection(spark, monkeypatch, n):
    """The cell between a point's edges for any number of them, as literals and as a table: edges, ends, outside, null and NaN."""
    r = random.Random(n)
    edges = tuple(sorted({r.uniform(-5, 5) for _ in range(n + 1)}))
    meta = GridMeta((len(edges) - 1, 1, 1), 1, geometry=Stretched((edges, (0.0, 1.0), (0.0, 1.0))))
    xs = [*edges, *[(a + b) / 2 for a, b in zip(edges, edges[1:])], edges[0] - 1, edges[-1] + 1, None, float("nan")]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(xs)], "i long, x double")

    def want(x):
        if x is None or math.isnan(x) or x < edges[0] or x > edges[-1]:
            return None
        k = sum(e <= x for e in edges) - 1
        return 2 * k + (math.floor((x - edges[k]) / (edges[k + 1] - edges[k]) * 2) if k < len(edges) - 1 else 0)

    for many in (1, 10**6):
        monkeypatch.setattr(geometry, "MANY_EDGES", many)
        point = (F.col("x"), F.lit(0.5), F.lit(0.5))
        for got in (df.select("i", geometry.indices_at(meta, point)[0].alias("ix")), geometry.with_indices(df, meta, point)):
            assert {r["i"]: r["ix"] for r in got.collect()} == {i: want(x) for i, x in enumerate(xs)}


def test_stretched_geometry_is_set_back():
    meta = GridMeta((2, 3, 1), 1, geometry=Stretched(((0.0, 5.0, 6.0), (1.0, 2.0, 3.0, 9.0), (0.0, 0.5))))
    again = meta.stretched_again()
    assert again.geometry == Stretched.of(Cartesian(), (2, 3, 1)) and again.start == (0.0, 0.0, 0.0) and again.end == (2.0, 3.0, 1.0)
    assert again.length == meta.length and again.max_level == 1


def test_ordered_lists(spark):
    """Lists that are asked for in order come in it: cells by id, flags by id, both ends of an exchange by sender, receiver and id."""
    grid = A.adapt(Grid.level0(spark, GridMeta((4, 3, 2), 1)), refine=[3, 9]).grid
    grid = grid.with_columns({"part": (F.col("cell") % 3).cast("int")}).settled()
    grid = grid.with_cells(grid.cells.repartition(5, "ix"))
    cells = [r["cell"] for r in grid.all_cells(ordered=True).collect()]
    assert cells == sorted(cells) and len(cells) == 24 + 14
    for df in (B.boundary_local(grid, ordered=True), B.inner_cells(grid, ordered=True), B.local_cells(grid, 1, ordered=True), lookup.get_cells(grid, 1, [lookup.LOCAL_OF], ordered=True)):
        got = [r["cell"] for r in df.collect()]
        assert got == sorted(got)
    remote = [tuple(r) for r in B.boundary_remote(grid, ordered=True).collect()]
    assert remote == sorted(remote) and remote
    for as_read in (True, False):
        sent = [(r["from_part"], r["to_part"], r["cell"]) for r in B.send_lists(grid, as_read=as_read, ordered=True).collect()]
        assert sent == sorted(sent) and len(set(sent)) == len(sent) > 0


def test_is_neighbor_predicate(spark):
    meta = GridMeta((4, 4, 4), 0, (True, False, False))
    pairs = spark.range(1, 65).withColumnRenamed("id", "a").join(spark.range(1, 65).withColumnRenamed("id", "b"), F.col("a") != F.col("b"))
    one = F.lit(1).cast("long")
    by = mapping.is_neighbor(meta, mapping.indices_of(meta, F.col("a")), one, mapping.indices_of(meta, F.col("b")), one)
    assert ids(pairs.filter(by), "a", "b") == sorted({x for x in ids(neighbors.neighbors_of(Grid.level0(spark, meta)), "cell", "nbr") if x[0] != x[1]})


def test_files(spark, tmp_path):
    meta = GridMeta((3, 2, 1), 2, (True, False, False), 2, Cartesian((1.0, 2.0, 3.0), (0.5, 0.5, 0.5)))
    grid = A.adapt(Grid.level0(spark, meta).with_columns({"a": F.col("cell") * 2, "d": F.col("cell") / 4}), refine=[2]).grid.add_hood("up", [(0, 1, 0)])
    want = ids(grid.cells, "cell", "a", "d")
    store.save(grid, str(tmp_path / "g"), "note")
    again, header = store.load(spark, str(tmp_path / "g"))
    assert header == "note" and again.meta == meta and again.hoods == {"up": ((0, 1, 0),)} and ids(again.cells, "cell", "a", "d") == want
    store.write_binary(grid, str(tmp_path / "b"), {"a": "q", "d": "d"}, header=b"12345678")
    again, header = store.read_binary(spark, str(tmp_path / "b"), {"a": "q", "d": "d"}, 8)
    assert header == b"12345678" and again.meta == meta and ids(again.cells, "cell", "a", "d") == want
    data = F.encode(F.repeat(F.lit("x"), (F.col("cell") % 5).cast("int")), "UTF-8")
    store.write_binary(grid, str(tmp_path / "v"), data=data)
    assert {r["cell"]: len(r["data"]) for r in store.read_binary(spark, str(tmp_path / "v"))[0].cells.collect()} == {c: c % 5 for c, _, _ in want}
    some = grid.cells.filter("cell % 2 = 0")
    store.write_binary(grid, f"file://{tmp_path}/s", {"a": "q"}, header=b"abc", cells=some, offset=40)
    file = store.open_binary(spark, f"file://{tmp_path}/s", 40)
    assert file.header == b"abc".ljust(40, b"\0") and file.cells == some.count()
    assert {r["cell"] for r in file.structure().cells.collect()} == {c for c, _, _ in want if c % 2 == 0}
    assert {(r["cell"], r["a"]) for r in file.load({"a": "q"}).cells.collect()} == {(c, a) for c, a, _ in want if c % 2 == 0}
    store.binary_to_vtk(spark, str(tmp_path / "b"), str(tmp_path / "vtk"), {"a": "q", "d": "d"}, 8)
    lines = spark.read.text(str(tmp_path / "vtk")).collect()
    n = len(want)
    assert lines[4][0] == f"POINTS {8 * n} float" and lines[5][0] == "1 2 3" and sum(x[0] == "11" for x in lines) == n and len(lines) == 5 + 8 * n + 2 * (n + 1) + 1 + 2 * (n + 2)
    with pytest.raises(ValueError):
        store.parse_preamble(b"\0" * 100)


def test_partition_refuses_and_options(spark):
    grid = Grid.level0(spark, GridMeta((4, 4, 1)))
    with pytest.raises(NotImplementedError):
        partition.partition(grid, 2, "HYPERGRAPH")
    with pytest.raises(ValueError):
        partition.partition(grid, 2, "X")
    o = partition.Options()
    o.add_level(12)
    o.set_in_level(0, "IMBALANCE_TOL", "1.1")
    assert o.names(0) == ["IMBALANCE_TOL"] and o.value(0, "IMBALANCE_TOL") == "1.1" and o.value(0, "x") is None
    with pytest.raises(ValueError):
        o.set("method", "x")
    assert o.hierarchy(24) == ((2, "RCB"), (12, "HSFC"))
    with pytest.raises(ValueError):
        o.hierarchy(13)
    parts = ids(partition.partition(grid, 4, "RCB").cells.groupBy("part").count(), "part", "count")
    assert parts == [(0, 4), (1, 4), (2, 4), (3, 4)]


def test_random_partition(spark):
    """The same seed gives the same parts, another other ones; all parts are there and none is twice as large as it should be."""
    grid = Grid.level0(spark, GridMeta((10, 10, 10)))
    parts = lambda seed: ids(partition.partition(grid, 4, "RANDOM", seed).cells, "cell", "part")
    one = parts(1)
    assert one == parts(1) != parts(2)
    sizes = [sum(p == k for _, p in one) for k in range(4)]
    assert sum(sizes) == 1000 and all(150 < n < 350 for n in sizes)


def test_weights_are_used_and_forgotten(spark):
    grid = Grid.level0(spark, GridMeta((8, 1, 1)))
    heavy = partition.set_weights(grid, grid.cells.select("cell", F.when(F.col("cell") == 1, 7.0).otherwise(1.0).alias("weight")))
    done = partition.balance_load(heavy, 2, "BLOCK")
    assert ids(done.cells, "cell", "part", "weight") == [(c, int(c > 1), 1.0) for c in range(1, 9)]


def test_inertial_bisection(spark):
    """Cells along a slanted line are cut across it, in order; without weight the longest side counts."""
    grid = Grid.level0(spark, GridMeta((12, 12, 1)))
    line = grid.with_cells(grid.cells.filter("ix = iy"))
    got = partition.partition(line, 4, "RIB").cells.select("ix", "part").collect()
    order = [r["part"] for r in sorted(got)]
    assert order in ([0] * 3 + [1] * 3 + [2] * 3 + [3] * 3, [3] * 3 + [2] * 3 + [1] * 3 + [0] * 3)


def test_life_patterns(spark):
    meta = GridMeta((15, 15, 1))
    on = {198, 199, 200, 47, 48, 62, 63}  # a blinker and a block
    grid = Grid.level0(spark, meta).with_columns({"alive": F.col("cell").isin(list(on)).cast("int")})
    one = ids(workloads.life(grid, 1).cells.filter("alive = 1"), "cell")
    assert one == sorted({47, 48, 62, 63, 184, 199, 214})
    assert ids(workloads.life(grid, 2).cells.filter("alive = 1"), "cell") == sorted(on)


def test_poisson_with_boundary_and_skipped(spark):
    """A line from 0 to 5 between fixed ends; what lies beyond a skipped cell isn't linked."""
    meta = GridMeta((8, 1, 1), 0, (False,) * 3, 0)
    grid = Grid.level0(spark, meta).with_columns({"rhs": F.lit(0.0), "solution": F.when(F.col("cell") == 6, 5.0).otherwise(F.lit(0.0))})
    one = lambda *c: spark.createDataFrame([(x,) for x in c], "cell long")
    system = workloads.poisson_system(grid, one(2, 3, 4, 5), one(7))
    solution, residual, _ = workloads.poisson_solve(system, 20, stop_residual=1e-10)
    got = dict(ids(solution, "cell", "solution"))
    assert residual < 1e-8 and all(abs(got[c] - (c - 1)) < 1e-6 for c in range(1, 7)) and 8 not in got
    swept, change, _ = workloads.poisson_failsafe(system, 3)
    assert change > 0 and swept.count() == 6


@pytest.mark.parametrize("n", (1, 2, 7, 3000))
def test_poisson_line(spark, n):
    """The periodic second difference is the right side less its mean; the last cell is 0."""
    rhs = [math.sin(3.0 * i) + i % 5 for i in range(n)]
    line = spark.createDataFrame(list(enumerate(rhs)), "index long, rhs double").repartition(3)
    u = [x for _, x in ids(workloads.poisson_line(line, 0.5), "index", "solution")]
    mean = sum(rhs) / n
    assert len(u) == n and u[-1] == 0
    assert all(abs(u[(i + 1) % n] - 2 * u[i] + u[i - 1] - 0.25 * (rhs[i] - mean)) < 1e-7 for i in range(n))
    assert workloads.poisson_line(line.filter("false"), 0.5).count() == 0


def test_poisson_line_as_iterated(spark):
    meta = GridMeta((8, 1, 1), 0, (True, False, False), 0)
    grid = Grid.level0(spark, meta).with_columns({"rhs": F.sin(F.col("cell") * (math.pi / 4)), "solution": F.lit(0.0)})
    solution, _, _ = workloads.poisson_solve(workloads.poisson_system(grid), 20, stop_residual=1e-12)
    got = [x for _, x in ids(solution, "cell", "solution")]
    line = workloads.poisson_line(grid.cells.select((F.col("cell") - 1).alias("index"), "rhs"), 1.0)
    assert all(abs(a - got[-1] - b) < 1e-6 for a, (_, b) in zip(got, ids(line, "index", "solution")))


def test_stream_of_points(spark, tmp_path):
    from cellarium.streaming.binned import cell_stream, windowed_cells

    meta = GridMeta((4, 1, 1))
    data = spark.createDataFrame([(float(i % 5), i) for i in range(20)], "x double, t long").withColumn("at", F.timestamp_seconds("t"))
    data.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(data.schema).parquet(str(tmp_path / "in"))
    point = (F.col("x"), F.lit(0.5), F.lit(0.5))
    for name, df, mode in (("cells_now", cell_stream(stream, meta, point), "append"), ("cells_by_window", windowed_cells(stream, meta, point, "at", "10 seconds", "1 minute", {"n": F.count(F.lit(1))}), "complete")):
        df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start().awaitTermination(60)
    assert spark.table("cells_now").count() == 16
    assert ids(spark.table("cells_by_window").select("window.start", "cell", "n").drop("start"), "cell", "n") == [(c, 2) for c in range(1, 5) for _ in range(2)]
