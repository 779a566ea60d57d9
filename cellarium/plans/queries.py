"""A query per family of operators, on grids derived from the test tables, with the SQL that gives the same rows."""

from __future__ import annotations

import math
import tempfile
import uuid
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import geometry, mapping
from ..functions.meta import Cartesian, GridMeta, Stretched
from ..operators import adapt as A
from ..operators import boundary as B
from ..operators import checks
from ..operators import lookup as L
from ..operators import neighbors as N
from ..operators import partition as P
from ..operators import stencil as S
from ..operators import workloads as W
from ..operators.blocks import blocked_stencil
from ..sources import snapshot, store
from ..sources.binning import binned, point_sums_per_leaf, refined_by_count, refined_by_sums, sums_per_leaf, sums_per_point
from ..streaming.pyramid import DeltaPyramid
from . import oracle as O
from .grid import Grid
from .shared import settle

QUERIES: dict = {}
SQL: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


# --- grids over lineitem: quantity, discount and tax as a lattice of up to 52 x 12 x 12 ------------------------------

LENGTH = (13, 3, 3)
M0, M1, M2 = (GridMeta(LENGTH, k) for k in range(3))
ROUND = GridMeta(LENGTH, 1, (True, True, False))


def items(spark, sf_dir: str, meta: GridMeta) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_quantity", "l_discount", "l_tax", "l_linenumber", "l_orderkey", "l_returnflag")
    step = 1 << (2 - meta.max_level)
    at = [F.col("l_quantity").cast("long") - 1, F.round(F.col("l_discount") * 100).cast("long"), F.round(F.col("l_tax") * 100).cast("long")]
    return df.select(*[mapping.div(c, step).alias(n) for c, n in zip(at, ("ix", "iy", "iz"))], F.col("l_quantity").cast("long").alias("qty"), F.col("l_linenumber").cast("long").alias("line"), F.col("l_orderkey").alias("okey"), F.col("l_returnflag").alias("flag"))


def items_sql(meta: GridMeta) -> str:
    step = 1 << (2 - meta.max_level)
    return f"SELECT (CAST(l_quantity AS BIGINT) - 1) // {step} AS ix, CAST(round(l_discount * 100) AS BIGINT) // {step} AS iy, CAST(round(l_tax * 100) AS BIGINT) // {step} AS iz, CAST(l_quantity AS BIGINT) AS qty, CAST(l_linenumber AS BIGINT) AS line, l_orderkey AS okey FROM lineitem"





def at() -> tuple:
    return F.col("ix"), F.col("iy"), F.col("iz")


def flat_grid(spark, meta: GridMeta) -> Grid:
    return Grid.level0(spark, meta)


def lattice(spark, sf_dir: str, meta: GridMeta) -> DataFrame:
    """Rows and quantity per lattice point, written, so that refining and counting by them read the table once."""
    return settle(sums_per_point(items(spark, sf_dir, meta), at(), {"n": F.lit(1), "qty": F.col("qty")}))


def one_level(spark, sf_dir: str, meta: GridMeta = M1, points: DataFrame | None = None) -> Grid:
    """Cells of level 0 with over a hundredth of the rows are refined; owner: id modulo 3. points: the lattice if it is at hand."""
    level0, dense = Grid.level0(spark, meta), F.col("n") * 100 > F.col("total")
    grid = refined_by_count(level0, items(spark, sf_dir, meta), at(), dense) if points is None else refined_by_sums(level0, point_sums_per_leaf(level0, points), dense)
    return grid.with_columns({"part": (F.col("cell") % 3).cast("int")})


def leaves_sql(meta: GridMeta = M1) -> str:
    """CTEs pts, leaf (with places and part)."""
    rows = f"pts AS ({items_sql(meta)}), r0 AS (SELECT cell FROM (SELECT {O.cell(meta, ('ix', 'iy', 'iz'), '0')} AS cell FROM pts) GROUP BY cell HAVING count(*) * 100 > (SELECT count(*) FROM pts))"
    ids = f"SELECT range AS cell FROM range(1, {meta.level0_cells + 1}) WHERE range NOT IN (SELECT cell FROM r0) UNION ALL SELECT cell FROM ({O.children(meta, 'SELECT cell FROM r0')})"
    return f"{rows}, ids AS ({ids}), leaf AS ({O.placed(meta, 'SELECT cell FROM ids', ', CAST(cell % 3 AS INTEGER) AS part')})"


def with_counts(grid: Grid, points: DataFrame, by: str | None = None) -> Grid:
    """Rows and quantity of the lattice per leaf, 0 where there are none."""
    sums = point_sums_per_leaf(grid, points, by)
    joined = grid.cells.join(sums, "cell", "left")
    return grid.with_cells(settle(joined.withColumns({"n": F.coalesce("n", F.lit(0)), "qty": F.coalesce("qty", F.lit(0))})))


def counted_level(spark, sf_dir: str, by: str | None = None) -> Grid:
    """one_level with rows and quantity per leaf."""
    points = lattice(spark, sf_dir, M1)
    return with_counts(one_level(spark, sf_dir, M1, points), points, by)


COUNTS = "sums AS (SELECT l.cell, count(*) AS n, sum(p.qty)::BIGINT AS qty FROM pts p JOIN leaf l ON p.ix >= l.ix AND p.ix < l.ix + l.len AND p.iy >= l.iy AND p.iy < l.iy + l.len AND p.iz >= l.iz AND p.iz < l.iz + l.len GROUP BY l.cell), cells AS (SELECT leaf.*, coalesce(n, 0) AS n, coalesce(qty, 0) AS qty FROM leaf LEFT JOIN sums USING (cell))"


def leaf_counts_sql(meta: GridMeta = M1) -> str:
    return f"WITH {leaves_sql(meta)}, {COUNTS}"


# --- A, B: cells and scalar functions --------------------------------------------------------------------------------

IDS = GridMeta((5, 4, 3), 3)


@query(f"WITH c AS ({O.placed(M1, 'SELECT range AS cell FROM range(1, 118)')}), r AS (SELECT {O.cell(M1, ('ix', 'iy', 'iz'), '0')} AS cell, count(*) AS n FROM ({items_sql(M1)}) GROUP BY 1) SELECT c.*, CAST(CASE WHEN c.cell - 1 < 32 THEN (c.cell - 1) // 16 ELSE 2 + (c.cell - 33) // 17 END AS INTEGER) AS part, coalesce(n, 0) AS n FROM c LEFT JOIN r ON r.cell = c.cell")
def grid_level0_cells(spark, sf_dir):
    """Cells of level 0 in blocks, each with its rows."""
    rows = binned(items(spark, sf_dir, M1), M1, at(), 0).groupBy("cell").agg(F.count(F.lit(1)).alias("n"))
    return Grid.level0(spark, M1, 7).cells.join(rows, "cell", "left").select("cell", "lvl", "ix", "iy", "iz", "len", "part", F.coalesce("n", F.lit(0)).alias("n"))


def _ids(spark, sf_dir: str, meta: GridMeta) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").alias("okey"), (F.col("o_orderkey") * 7 % (meta.last_cell + 3)).alias("cell"))


def _ids_sql(meta: GridMeta) -> str:
    return f"SELECT o_orderkey AS okey, o_orderkey * 7 % {meta.last_cell + 3} AS cell FROM orders"


_X, _Y, _Z = O.index(IDS, "cell", "nullif(lvl, -1)")


@query(f"WITH i AS (SELECT *, {O.level(IDS, 'cell')} AS lvl FROM ({_ids_sql(IDS)})), x AS (SELECT *, {_X} AS ix, {_Y} AS iy, {_Z} AS iz, {O.length(IDS, 'nullif(lvl, -1)')} AS len FROM i) SELECT okey, cell, lvl, ix, iy, iz, len, CASE WHEN lvl < 0 THEN 0 ELSE {O.cell(IDS, ('ix', 'iy', 'iz'), 'lvl')} END AS back FROM x")
def cell_indices_roundtrip(spark, sf_dir):
    ids = _ids(spark, sf_dir, IDS)
    lvl = mapping.level_of(IDS, F.col("cell"))
    ix, iy, iz = mapping.indices_of(IDS, F.col("cell"), lvl)
    out = ids.select("okey", "cell", lvl.alias("lvl"), ix.alias("ix"), iy.alias("iy"), iz.alias("iz"), mapping.length_in_indices(IDS, lvl).alias("len"))
    return out.withColumn("back", mapping.cell_at(IDS, at(), F.col("lvl")))


def _family(kind: str) -> str:
    places = O.index(IDS, "cell", "lvl")
    half = f"(1 << ({IDS.max_level} - lvl - 1))"
    kids = [O.cell(IDS, tuple(f"({c} + {k >> d & 1} * {half})" for d, c in enumerate(places)), "(lvl + 1)") for k in range(8)]
    return {
        "parent": f"CASE WHEN lvl > 0 THEN {O.cell(IDS, places, '(lvl - 1)')} WHEN lvl = 0 THEN cell ELSE 0 END",
        "child": f"CASE WHEN lvl BETWEEN 0 AND {IDS.max_level - 1} THEN {O.cell(IDS, places, '(lvl + 1)')} WHEN lvl >= 0 THEN cell ELSE 0 END",
        "l0": f"CASE WHEN lvl >= 0 THEN {O.cell(IDS, places, '0')} ELSE 0 END",
        "children": f"CASE WHEN lvl BETWEEN 0 AND {IDS.max_level - 1} THEN concat_ws(',', {', '.join(kids)}) ELSE '0,0,0,0,0,0,0,0' END",
    }[kind]


def _with_level(body: str) -> str:
    return f"WITH i AS (SELECT *, {O.level(IDS, 'cell')} AS lvl FROM ({_ids_sql(IDS)})) {body}"


@query(_with_level(f"SELECT okey, {_family('parent')} AS parent, {_family('child')} AS child, {_family('l0')} AS l0, {_family('children')} AS children FROM i"))
def cell_parent_children(spark, sf_dir):
    ids, c = _ids(spark, sf_dir, IDS), F.col("cell")
    return ids.select("okey", mapping.parent(IDS, c).cast("long").alias("parent"), mapping.first_child(IDS, c).cast("long").alias("child"), mapping.level0_parent(IDS, c).cast("long").alias("l0"), F.concat_ws(",", mapping.children(IDS, c).cast("array<string>")).alias("children"))


@query(
    _with_level(
        f", p AS (SELECT okey, CASE WHEN lvl > 0 THEN {_family('parent')} ELSE 0 END AS cell, cell AS own, lvl - 1 AS lvl, lvl AS was FROM i) SELECT okey, CASE WHEN was > 0 THEN {_family('children')} WHEN was = 0 THEN concat_ws(',', own, '0,0,0,0,0,0,0') ELSE '0,0,0,0,0,0,0,0' END AS siblings FROM p"
    )
)
def cell_siblings(spark, sf_dir):
    return _ids(spark, sf_dir, IDS).select("okey", F.concat_ws(",", mapping.siblings(IDS, F.col("cell")).cast("array<string>")).alias("siblings"))


DYADIC = GridMeta((5, 4, 3), 3, geometry=Cartesian((-1.5, 0.25, 2.0), (0.5, 2.0, 0.125)))
_C = O.center(DYADIC, (_X, _Y, _Z), "nullif(lvl, -1)")
_H = [f"({d!r}::DOUBLE / (1 << CAST(nullif(lvl, -1) AS INTEGER)))" for d in DYADIC.geometry.level0_length]


@query(_with_level("SELECT okey, " + ", ".join(f"{c} AS c{a}, {c} - {h} / 2 AS lo{a}, {c} + {h} / 2 AS hi{a}, {h} AS len{a}" for a, c, h in zip("xyz", _C, _H)) + " FROM i"))
def cell_geometry_center_min_max(spark, sf_dir):
    c = F.col("cell")
    cols = []
    for a, mid, lo, hi, n in zip("xyz", geometry.center(DYADIC, c), geometry.minimum(DYADIC, c), geometry.maximum(DYADIC, c), geometry.length(DYADIC, c)):
        cols += [mid.alias("c" + a), lo.alias("lo" + a), hi.alias("hi" + a), n.alias("len" + a)]
    return _ids(spark, sf_dir, IDS).select("okey", *cols)


EDGES = ((0.0, 1.0, 4.0, 16.0, 32.0, 64.0), (0.0, 0.5, 2.0, 4.0, 8.0), (-8.0, 0.0, 1.0, 8.0))
STRETCHED = GridMeta((5, 4, 3), 3, (True, False, False), geometry=Stretched(EDGES))


def _bucket(edges, c: str) -> tuple[str, str]:
    whens = " ".join(f"WHEN {c} >= {a} AND {c} < {b} THEN {i * 8} + CAST(floor(({c} - ({a})) / {b - a} * 8) AS BIGINT)" for i, (a, b) in enumerate(zip(edges, edges[1:])))
    mids = " ".join(f"WHEN {c} >= {a} AND {c} < {b} THEN {a} + (floor(({c} - ({a})) / {b - a} * 8) + 0.5) * {(b - a) / 8}" for a, b in zip(edges, edges[1:]))
    return f"(CASE {whens} END)", f"(CASE {mids} END)"


_SB = [_bucket(e, c) for e, c in zip(EDGES, ("x", "y", "z"))]


@query(f"SELECT okey, line, {', '.join(f'{b} AS i{a}, {m} AS c{a}' for a, (b, m) in zip('xyz', _SB))} FROM (SELECT l_orderkey AS okey, CAST(l_linenumber AS BIGINT) AS line, l_quantity AS x, CAST(l_linenumber AS DOUBLE) AS y, CAST(l_linenumber AS DOUBLE) * 2 - 8 AS z FROM lineitem)")
def stretched_geometry(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(F.col("l_orderkey").alias("okey"), F.col("l_linenumber").cast("long").alias("line"), F.col("l_quantity").alias("x"), F.col("l_linenumber").cast("double").alias("y"), (F.col("l_linenumber").cast("double") * 2 - 8).alias("z"))
    i = geometry.indices_at(STRETCHED, (F.col("x"), F.col("y"), F.col("z")))
    df = df.withColumns({"ix": i[0], "iy": i[1], "iz": i[2]})
    c = geometry.center_at(STRETCHED, F.lit(3), at())
    return df.select("okey", "line", "ix", "iy", "iz", *[v.alias("c" + a) for a, v in zip("xyz", c)])


#: Prices up to 50 000 by one, up to 150 000 by two: 100 001 edges.
PRICES = GridMeta((100_000, 1, 1), 0, geometry=Stretched((tuple(float(i if i <= 50_000 else 2 * i - 50_000) for i in range(100_001)), (0.0, 1.0), (0.0, 1.0))))


@query("SELECT okey, line, CASE WHEN x < 50000 THEN CAST(floor(x) AS BIGINT) WHEN x <= 150000 THEN 50000 + CAST(floor((x - 50000) / 2) AS BIGINT) END AS ix, CASE WHEN x < 50000 THEN floor(x) + 0.5 WHEN x < 150000 THEN 50001 + 2 * floor((x - 50000) / 2) END AS cx FROM (SELECT l_orderkey AS okey, CAST(l_linenumber AS BIGINT) AS line, l_extendedprice AS x FROM lineitem)")
def stretched_many_edges(spark, sf_dir):
    """Every price between its edges, found by bisection."""
    df = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(F.col("l_orderkey").alias("okey"), F.col("l_linenumber").cast("long").alias("line"), F.col("l_extendedprice").alias("x"))
    df = geometry.with_indices(df, PRICES, (F.col("x"), F.lit(0.5), F.lit(0.5)))
    return df.select("okey", "line", "ix", geometry.center_at(PRICES, F.lit(0), (F.col("ix"), F.lit(0).cast("long"), F.lit(0).cast("long")))[0].alias("cx"))


WRAP = GridMeta((4, 4, 4), 0, (True, False, True), geometry=Cartesian((1000.0, -999.0, 0.0), (2500.0, 2500.0, 0.5)))


def _wrapped(c: str, a: float, b: float, around: bool) -> str:
    w = b - a
    rest = f" WHEN {c} < {a} THEN {c} + {w} * ceil(({a} - {c}) / {w}) ELSE {c} - {w} * ceil(({c} - {b}) / {w}) END" if around else " END"
    return f"CASE WHEN {c} >= {a} AND {c} <= {b} THEN {c}{rest}"


@query("SELECT c_custkey, " + ", ".join(f"{_wrapped(c, a, b, p)} AS {n}" for n, c, a, b, p in zip("xyz", ("c_acctbal::DOUBLE", "c_acctbal::DOUBLE", "(c_custkey::DOUBLE / 8)"), WRAP.start, WRAP.end, WRAP.periodic)) + " FROM customer")
def periodic_wrap(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/customer.parquet")
    wrapped = geometry.real_coordinate(WRAP, (F.col("c_acctbal"), F.col("c_acctbal"), F.col("c_custkey").cast("double") / 8))
    return df.select("c_custkey", *[v.alias(n) for n, v in zip("xyz", wrapped)])


@query(
    "WITH p AS (SELECT c_custkey % 20 AS a, c_custkey * 3 % 20 AS b, 1 + c_custkey % 4 AS la, 1 + c_custkey % 3 AS lb, c_custkey FROM customer) "
    "SELECT c_custkey, CAST(CAST(a < b + lb AND b < a + la AS INTEGER) + CAST(b < a + lb AND a < b + la AS INTEGER) + 1 AS BIGINT) AS dims, a < b + lb AND b < a + la AND b < a + lb AND a < b + la AS overlap FROM p"
)
def overlap_predicate(spark, sf_dir):
    k = F.col("c_custkey")
    df = spark.read.parquet(f"{sf_dir}/customer.parquet").select(k, (k % 20).alias("a"), (k * 3 % 20).alias("b"), (1 + k % 4).alias("la"), (1 + k % 3).alias("lb"))
    one, two = (F.col("a"), F.col("b"), F.col("a")), (F.col("b"), F.col("a"), F.col("a"))
    return df.select("c_custkey", mapping.overlapping_dimensions(one, F.col("la"), two, F.col("lb")).cast("long").alias("dims"), mapping.indices_overlap(one, F.col("la"), two, F.col("lb")).alias("overlap"))


@query(f"WITH {leaves_sql()} SELECT DISTINCT a.cell, b.cell AS nbr FROM leaf a JOIN leaf b ON a.cell <> b.cell WHERE greatest(b.ix - a.ix - a.len, a.ix - b.ix - b.len, 0) < a.len AND greatest(b.iy - a.iy - a.len, a.iy - b.iy - b.len, 0) < a.len AND greatest(b.iz - a.iz - a.len, a.iz - b.iz - b.len, 0) < a.len")
def neighbors_by_predicate(spark, sf_dir):
    """The stencil join gives what the geometric predicate says, without its theta join."""
    return N.neighbors_of(one_level(spark, sf_dir)).select("cell", "nbr").filter("cell <> nbr").distinct()


# --- C: lookups and joins --------------------------------------------------------------------------------------------


@query(f"SELECT {O.cell(M0, ('ix', 'iy', 'iz'), '0')} AS cell, count(*) AS n, sum(qty)::BIGINT AS qty FROM ({items_sql(M0)}) GROUP BY 1")
def bin_points_to_cells(spark, sf_dir):
    return binned(items(spark, sf_dir, M0), M0, at()).groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.sum("qty").alias("qty"))


@query(f"{leaf_counts_sql()} SELECT cell, lvl, n, qty FROM cells WHERE n > 0")
def bin_points_adaptive(spark, sf_dir):
    """Points meet leaves as intervals of the space-filling curve."""
    return counted_level(spark, sf_dir, "intervals").cells.filter("n > 0").select("cell", "lvl", "n", "qty")


@query(f"WITH {leaves_sql()} SELECT x, y, z, CAST(coalesce(l.cell, 0) AS BIGINT) AS cell FROM (SELECT DISTINCT CAST(l_linenumber AS DOUBLE) * 2 AS x, CAST(l_linenumber AS DOUBLE) / 2 AS y, CAST(l_linenumber AS DOUBLE) / 4 AS z FROM lineitem) p LEFT JOIN leaf l ON p.x * 2 >= l.ix AND p.x * 2 < l.ix + l.len AND p.y * 2 >= l.iy AND p.y * 2 < l.iy + l.len AND p.z * 2 >= l.iz AND p.z * 2 < l.iz + l.len")
def existing_cell_at_point(spark, sf_dir):
    n = F.col("l_linenumber").cast("double")
    points = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select((n * 2).alias("x"), (n / 2).alias("y"), (n / 4).alias("z")).distinct()
    return L.existing_at_point(one_level(spark, sf_dir), points)


@query(f"WITH {leaves_sql()} SELECT p.ix, p.iy, p.iz, CAST(coalesce(max(l.cell), 0) AS BIGINT) AS cell FROM (SELECT DISTINCT ix, iy, iz FROM pts) p LEFT JOIN leaf l ON l.lvl = 1 AND p.ix >= l.ix AND p.ix < l.ix + l.len AND p.iy >= l.iy AND p.iy < l.iy + l.len AND p.iz >= l.iz AND p.iz < l.iz + l.len GROUP BY 1, 2, 3")
def existing_cell_in_levels(spark, sf_dir):
    points = lattice(spark, sf_dir, M1)
    return L.existing_at_indices(one_level(spark, sf_dir, M1, points), points.select(*at()), at(), 1, 1, by="intervals")


@query(f"WITH {leaves_sql()} SELECT cell, lvl FROM leaf WHERE ix <= 9 AND ix + len > 4 AND iy <= 3 AND iy + len > 1 AND iz <= 5 AND iz + len > 0 AND lvl BETWEEN 0 AND 1")
def box_query(spark, sf_dir):
    return L.cells_in_box(one_level(spark, sf_dir), (4, 1, 0), (9, 3, 5)).select("cell", "lvl")


@query(f"{leaf_counts_sql()} SELECT cell, lvl, n FROM cells WHERE ix <= 17 AND ix + len > 12 AND iy <= 4 AND iy + len > 2 AND iz <= 1 AND iz + len > 0")
def box_query_on_curve(spark, sf_dir):
    """The same over a grid that is saved along the space-filling curve: only files and row groups that can meet the box are read."""
    path = _folder(spark)
    store.save_on_curve(counted_level(spark, sf_dir), path, files=8)
    return L.cells_in_box(store.load(spark, path)[0], (12, 2, 0), (17, 4, 1)).select("cell", "lvl", "n")


@query(f"WITH {leaves_sql()} SELECT p.okey, p.line, CAST(coalesce(l.cell, 0) AS BIGINT) AS cell FROM (SELECT *, ix * 2 - 6 AS jx FROM pts) p LEFT JOIN leaf l ON p.jx >= l.ix AND p.jx < l.ix + l.len AND p.iy >= l.iy AND p.iy < l.iy + l.len AND p.iz >= l.iz AND p.iz < l.iz + l.len")
def leaves_of_rows(spark, sf_dir):
    """The leaf of every row itself, hot leaves and rows outside the grid included."""
    rows = items(spark, sf_dir, M1).withColumn("ix", F.col("ix") * 2 - 6)
    return L.at_intervals(one_level(spark, sf_dir), rows, at(), block_level=1).select("okey", "line", "cell")


@query(
    f"WITH {leaves_sql()}, i AS (SELECT range AS cell FROM range(0, 1100)), p AS (SELECT cell, nullif({O.level(M1, 'cell')}, -1) AS lvl FROM i) SELECT p.cell, CAST(CASE WHEN p.lvl = 1 AND {O.cell(M1, O.index(M1, 'p.cell', 'p.lvl'), '0')} IN (SELECT cell FROM ids) THEN {O.cell(M1, O.index(M1, 'p.cell', 'p.lvl'), '0')} WHEN p.cell IN (SELECT cell FROM ids) THEN p.cell ELSE 0 END AS BIGINT) AS parent, CAST(CASE WHEN p.lvl = 0 AND {O.cell(M1, O.index(M1, 'p.cell', '0'), '1')} IN (SELECT cell FROM ids) THEN {O.cell(M1, O.index(M1, 'p.cell', '0'), '1')} WHEN p.cell IN (SELECT cell FROM ids) THEN p.cell ELSE 0 END AS BIGINT) AS child, CAST(coalesce((SELECT part FROM leaf WHERE leaf.cell = p.cell), -1) AS INTEGER) AS part FROM p"
)
def existing_parent_child_owner(spark, sf_dir):
    grid = one_level(spark, sf_dir)
    ids = spark.range(0, 1100).withColumnRenamed("id", "cell")
    return L.owners(grid, L.existing_child(grid, L.existing_parent(grid, ids))).select("cell", "parent", "child", "part")


FLAT = GridMeta(LENGTH, 0)
FLAT_LEAF = f"WITH leaf AS ({O.placed(FLAT, 'SELECT range AS cell FROM range(1, 118)')})"


@query(f"{FLAT_LEAF}, r AS (SELECT {O.cell(M0, ('ix', 'iy', 'iz'), '0')} AS nbr, count(*) AS n FROM ({items_sql(M0)}) GROUP BY 1) SELECT x.*, coalesce(n, 0) AS n FROM ({O.near(FLAT)}) x LEFT JOIN r USING (nbr)")
def neighbors_of_uniform(spark, sf_dir):
    """Neighbor rows of an unrefined grid with the rows in each neighbor."""
    rows = binned(items(spark, sf_dir, M0), M0, at()).groupBy(F.col("cell").alias("nbr")).agg(F.count(F.lit(1)).alias("n"))
    return N.neighbors_of(flat_grid(spark, FLAT)).join(rows, "nbr", "left").select("cell", "ord", "nbr", "ox", "oy", "oz", F.coalesce("n", F.lit(0)).alias("n"))


WIDE = GridMeta((4, 2, 1), 0, (True, True, True), 2)


@query(f"WITH leaf AS ({O.placed(WIDE, 'SELECT range AS cell FROM range(1, 9)')}), r AS (SELECT 1 + c_custkey % 8 AS cell, count(*) AS n FROM customer GROUP BY 1), m AS ({O.near(WIDE)}) SELECT m.cell, m.ord, m.nbr, m.ox, m.oy, m.oz, coalesce(r.n, 0) AS n FROM m LEFT JOIN r ON r.cell = m.nbr")
def neighbors_of_periodic(spark, sf_dir):
    """A neighborhood of length two, wider than the grid that wraps around, with the customers in each neighbor."""
    rows = spark.read.parquet(f"{sf_dir}/customer.parquet").groupBy((1 + F.col("c_custkey") % 8).alias("nbr")).agg(F.count(F.lit(1)).alias("n"))
    return N.neighbors_of(flat_grid(spark, WIDE)).join(rows, "nbr", "left").select("cell", "ord", "nbr", "ox", "oy", "oz", F.coalesce("n", F.lit(0)).alias("n"))


@query(f"WITH {leaves_sql()} {O.near(M1)}")
def neighbors_of_amr(spark, sf_dir):
    return N.neighbors_of(one_level(spark, sf_dir))


@query(f"WITH {leaves_sql(ROUND)} {O.near(ROUND)}")
def neighbors_of_amr_periodic(spark, sf_dir):
    return N.neighbors_of(one_level(spark, sf_dir, ROUND))


@query(f"WITH {leaves_sql()} SELECT DISTINCT nbr AS cell, cell AS nbr FROM ({O.near(M1)})")
def neighbors_to(spark, sf_dir):
    return N.neighbors_to(one_level(spark, sf_dir))


CROSS = [(1, 0, 0), (-1, 0, 0), (0, 1, 1)]


@query(f"WITH {leaves_sql()} {O.near(M1, offsets=CROSS)}")
def neighbors_user_hood(spark, sf_dir):
    """A neighborhood whose name was another's before that was removed."""
    grid = one_level(spark, sf_dir).add_hood("cross", ALONG).remove_hood("cross")
    return N.neighbors_of(grid.add_hood("cross", CROSS), "cross")


FACES_SQL = f"n AS ({O.near(M1, offsets=[(0, 0, -1), (0, -1, 0), (-1, 0, 0), (1, 0, 0), (0, 1, 0), (0, 0, 1)])}), f AS (SELECT DISTINCT n.cell, n.nbr, n.ox, n.oy, n.oz, a.len AS len, b.len AS nlen, CASE WHEN ox = a.len THEN 1 WHEN ox = -b.len THEN -1 WHEN oy = a.len THEN 2 WHEN oy = -b.len THEN -2 WHEN oz = a.len THEN 3 WHEN oz = -b.len THEN -3 END AS direction FROM n JOIN leaf a ON a.cell = n.cell JOIN leaf b ON b.cell = n.nbr WHERE CAST(ox > -b.len AND ox < a.len AS INTEGER) + CAST(oy > -b.len AND oy < a.len AS INTEGER) + CAST(oz > -b.len AND oz < a.len AS INTEGER) = 2 AND (ox IN (a.len, -b.len) OR oy IN (a.len, -b.len) OR oz IN (a.len, -b.len)))"


@query(f"WITH {leaves_sql()}, {FACES_SQL} SELECT cell, nbr, direction FROM f")
def face_neighbors(spark, sf_dir):
    return N.face_neighbors(one_level(spark, sf_dir)).select("cell", "nbr", "direction")


@query(
    f"WITH {leaves_sql()}, {FACES_SQL} SELECT leaf.cell, "
    + ", ".join(f"CAST(coalesce(arg_min(f.nbr, l2.iz * 10000 + l2.iy * 100 + l2.ix) FILTER (direction = {d}), 0) AS BIGINT) AS {n}" for n, d in (("x_neg", -1), ("x_pos", 1), ("y_neg", -2), ("y_pos", 2), ("z_neg", -3), ("z_pos", 3)))
    + " FROM leaf LEFT JOIN f ON f.cell = leaf.cell LEFT JOIN leaf l2 ON l2.cell = f.nbr GROUP BY leaf.cell"
)
def face_cache(spark, sf_dir):
    return N.face_cache(one_level(spark, sf_dir))


@query(f"WITH {leaves_sql()}, n AS ({O.near(M1)}) SELECT n.cell, n.nbr FROM n JOIN leaf USING (cell) WHERE ox = len AND oy = 0 AND oz = -len")
def neighbors_at_offset(spark, sf_dir):
    return N.neighbors_at_offset(one_level(spark, sf_dir), 1, 0, -1)


@query(f"WITH {leaves_sql()}, n AS ({O.near(M1, offsets=CROSS)}), p AS (SELECT DISTINCT cell, nbr FROM n), q AS (SELECT nbr AS cell, cell AS nbr FROM p) SELECT kind, count(*) AS n, CAST(sum(far) AS BIGINT) AS far FROM (SELECT coalesce(abs(ox) + abs(oy) + abs(oz), 0) AS far, CASE WHEN q.cell IS NULL THEN 'only_of' WHEN n.cell IS NULL THEN 'only_to' ELSE 'both' END AS kind FROM n FULL JOIN q ON n.cell = q.cell AND n.nbr = q.nbr) GROUP BY kind")
def neighbor_table(spark, sf_dir):
    grid = one_level(spark, sf_dir).add_hood("cross", CROSS).with_items(neighbor_items={"far": F.abs("ox") + F.abs("oy") + F.abs("oz")})
    return N.neighbor_table(grid, "cross").groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.sum("far").alias("far"))


NEAR_PARTS = f"WITH {leaves_sql()}, n AS ({O.near(M1)}), x AS (SELECT DISTINCT n.cell, a.part, n.nbr, b.part AS n_part FROM n JOIN leaf a ON a.cell = n.cell JOIN leaf b ON b.cell = n.nbr WHERE a.part <> b.part)"


@query(f"{NEAR_PARTS} SELECT cell, part FROM leaf WHERE cell IN (SELECT cell FROM x UNION SELECT nbr FROM x)")
def boundary_local(spark, sf_dir):
    return B.boundary_local(one_level(spark, sf_dir)).select("cell", "part")


ALONG = [(1, 0, 0)]
BLOCKS = f"WITH {leaves_sql()}, own AS (SELECT * EXCLUDE (part), CAST(({O.ancestor(M1, 'cell', '0')} - 1) // 40 AS INTEGER) AS part FROM leaf), n AS (SELECT n.cell, n.nbr FROM ({O.near(M1, offsets=ALONG)}) n JOIN own a ON a.cell = n.cell JOIN own b ON b.cell = n.nbr WHERE a.part <> b.part)"


@query(f"{BLOCKS} SELECT cell, part FROM own WHERE cell NOT IN (SELECT cell FROM n UNION SELECT nbr FROM n)")
def boundary_inner(spark, sf_dir):
    """Cells that no other part needs, of three blocks of a refined grid."""
    grid = one_level(spark, sf_dir).with_columns({"part": mapping.div(mapping.level0_parent(M1, F.col("cell")) - 1, 40).cast("int")})
    return B.inner_cells(grid.add_hood("along", ALONG), "along").select("cell", "part")


@query(f"{NEAR_PARTS} SELECT DISTINCT to_part, cell FROM (SELECT part AS to_part, nbr AS cell FROM x UNION SELECT n_part, cell FROM x)")
def boundary_remote(spark, sf_dir):
    return B.boundary_remote(one_level(spark, sf_dir))


@query(f"{NEAR_PARTS} SELECT cell, nbr, n_part AS nbr_part, 'of' AS kind FROM x UNION ALL SELECT nbr, cell, part, 'to' FROM x")
def remote_neighbors(spark, sf_dir):
    grid = one_level(spark, sf_dir)
    return B.remote_neighbors_of(grid).withColumn("kind", F.lit("of")).unionByName(B.remote_neighbors_to(grid).withColumn("kind", F.lit("to")))


MASKS = f"WITH {leaves_sql()}, n AS ({O.near(M1, offsets=CROSS)}), e AS (SELECT n.cell AS c, CASE WHEN a.part = b.part THEN 1 ELSE 4 END AS bit FROM n JOIN leaf a ON a.cell = n.cell JOIN leaf b ON b.cell = n.nbr UNION ALL SELECT n.nbr, CASE WHEN a.part = b.part THEN 2 ELSE 8 END FROM n JOIN leaf a ON a.cell = n.cell JOIN leaf b ON b.cell = n.nbr), m AS (SELECT c AS cell, bit_or(bit) AS mask FROM e GROUP BY c)"


@query(f"{MASKS} SELECT leaf.cell, leaf.part, CAST(coalesce(mask, 0) AS INTEGER) AS mask FROM leaf LEFT JOIN m USING (cell)")
def neighbor_type_mask(spark, sf_dir):
    return L.neighbor_types(one_level(spark, sf_dir).add_hood("cross", CROSS), "cross")


@query(f"{MASKS} SELECT cell, part FROM leaf JOIN m USING (cell) WHERE part = 1 AND mask & 5 > 0")
def cells_by_neighbor_type(spark, sf_dir):
    grid = one_level(spark, sf_dir).add_hood("cross", CROSS)
    return L.get_cells(grid, 1, [L.LOCAL_OF, L.REMOTE_OF], hood="cross").select("cell", "part")


@query(f"{NEAR_PARTS}, s AS (SELECT DISTINCT nbr AS cell, n_part AS f, part AS t FROM x) SELECT part, CAST(sum(a) AS BIGINT) AS n_send, CAST(sum(b) AS BIGINT) AS n_receive FROM (SELECT f AS part, 1 AS a, 0 AS b FROM s UNION ALL SELECT t, 0, 1 FROM s) GROUP BY part")
def halo_send_counts(spark, sf_dir):
    return B.update_counts(one_level(spark, sf_dir))


@query(f"{NEAR_PARTS} SELECT DISTINCT part, n_part AS nbr_part FROM x UNION SELECT n_part, part FROM x")
def neighbor_parts(spark, sf_dir):
    return B.neighbor_parts(one_level(spark, sf_dir))


# --- D: aggregates -------------------------------------------------------------------------------------------------


@query(f"{leaf_counts_sql()}, n AS ({O.near(M1)}) SELECT n.cell, count(*) AS neighbors, CAST(sum(c.n) AS BIGINT) AS rows_around, CAST(sum(c.qty) AS BIGINT) AS qty_around, CAST(sum(n.ox) AS BIGINT) AS shift FROM n JOIN cells c ON c.cell = n.nbr GROUP BY n.cell")
def stencil_sum(spark, sf_dir):
    grid = counted_level(spark, sf_dir)
    return S.stencil(grid, {"neighbors": F.count(F.lit(1)), "rows_around": F.sum("n_n"), "qty_around": F.sum("n_qty"), "shift": F.sum("ox")}, ("n", "qty"))


@query(f"{leaf_counts_sql(ROUND)}, n AS ({O.near(ROUND)}) SELECT n.cell, count(*) AS neighbors, CAST(sum(c.n) AS BIGINT) AS rows_around, max(n.oz) AS above FROM n JOIN cells c ON c.cell = n.nbr GROUP BY n.cell")
def stencil_by_blocks(spark, sf_dir):
    """Leaves are shuffled once, by block, with copies of those at borders; all joins and sums stay within blocks."""
    points = lattice(spark, sf_dir, ROUND)
    grid = with_counts(Grid(ROUND, one_level(spark, sf_dir, ROUND, points).cells), points)
    return blocked_stencil(grid, {"neighbors": F.count(F.lit(1)), "rows_around": F.sum("n_n"), "above": F.max("oz")}, ("n",), side=2)


@query(f"{leaf_counts_sql()}, {FACES_SQL} SELECT f.cell, max(abs(a.n - b.n)::DOUBLE / (least(a.n, b.n) + 8)) AS max_diff FROM f JOIN cells a ON a.cell = f.cell JOIN cells b ON b.cell = f.nbr GROUP BY f.cell")
def stencil_max_diff(spark, sf_dir):
    grid = counted_level(spark, sf_dir)
    return S.max_difference(grid, "n", 8)


LIFE = GridMeta(LENGTH, 1)


@query(f"{FLAT_LEAF}, a AS (SELECT leaf.*, CAST(cell IN (SELECT 1 + p_partkey * 7 % 117 FROM part GROUP BY 1 HAVING count(*) % 2 = 1) AS INTEGER) AS alive FROM leaf), n AS ({O.near(FLAT)}), s AS (SELECT n.cell, sum(b.alive) AS around FROM n JOIN a b ON b.cell = n.nbr GROUP BY n.cell) SELECT a.cell, CASE WHEN around = 3 THEN 1 WHEN around = 2 THEN alive ELSE 0 END AS alive FROM a JOIN s USING (cell)")
def life_step(spark, sf_dir):
    return W.life_step(_alive(spark, sf_dir, Grid.level0(spark, FLAT))).cells.select("cell", "alive")


def _alive(spark, sf_dir: str, grid: Grid) -> Grid:
    """Alive is a cell that an odd number of parts falls into."""
    on = spark.read.parquet(f"{sf_dir}/part.parquet").groupBy((1 + F.col("p_partkey") * 7 % 117).alias("l0")).agg(F.count(F.lit(1)).alias("n")).filter("n % 2 = 1").select("l0", F.lit(1).alias("on"))
    cells = grid.cells.withColumn("l0", mapping.level0_parent(grid.meta, F.col("cell"))).join(on, "l0", "left")
    return grid.with_cells(cells.withColumn("alive", F.coalesce("on", F.lit(0))).drop("l0", "on"))


@query(
    f"WITH flat AS ({O.placed(FLAT, 'SELECT range AS cell FROM range(1, 118)')}), a AS (SELECT flat.*, CAST(cell IN (SELECT 1 + p_partkey * 7 % 117 FROM part GROUP BY 1 HAVING count(*) % 2 = 1) AS INTEGER) AS alive FROM flat), n AS ({O.near(FLAT, 'flat')}), s AS (SELECT n.cell, sum(b.alive) AS around FROM n JOIN a b ON b.cell = n.nbr GROUP BY n.cell), r AS (SELECT a.cell, CASE WHEN around = 3 THEN 1 WHEN around = 2 THEN alive ELSE 0 END AS alive FROM a JOIN s USING (cell)), {leaves_sql()} SELECT leaf.cell, r.alive FROM leaf JOIN r ON r.cell = {O.ancestor(M1, 'leaf.cell', '0')}"
)
def life_step_amr(spark, sf_dir):
    """Each leaf of a refined grid gets what its ancestor gets on the unrefined one."""
    return W.life_step_refined(_alive(spark, sf_dir, one_level(spark, sf_dir))).cells.select("cell", "alive")


@query("SELECT min(least(CASE WHEN vx > 0 THEN 1 / vx END, CASE WHEN vy > 0 THEN 2 / vy END)) AS dt FROM (SELECT l_quantity AS vx, l_linenumber - 1.0::DOUBLE AS vy FROM lineitem)")
def global_min_step(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(F.lit(1.0).alias("length_x"), F.lit(2.0).alias("length_y"), F.lit(1.0).alias("length_z"), F.col("l_quantity").alias("vx"), (F.col("l_linenumber") - 1.0).alias("vy"), F.lit(0.0).alias("vz"))
    return W.max_time_step(Grid(M0, df))


@query("SELECT round(sqrt(sum(l_quantity * l_quantity)), 6) AS norm FROM lineitem")
def pnorm(spark, sf_dir):
    return S.p_norm(spark.read.parquet(f"{sf_dir}/lineitem.parquet"), F.col("l_quantity"), 2).select(F.round("norm", 6).alias("norm"))


@query(f"{leaf_counts_sql()}, n AS ({O.near(M1)}), x AS (SELECT DISTINCT a.part, b.part AS o FROM n JOIN leaf a ON a.cell = n.cell JOIN leaf b ON b.cell = n.nbr), l AS (SELECT part, o FROM x UNION SELECT o, part FROM x UNION SELECT part, part FROM leaf), t AS (SELECT part AS o, sum(n) AS s FROM cells GROUP BY part) SELECT part, CAST(sum(s) AS BIGINT) AS total FROM l JOIN t USING (o) GROUP BY part")
def neighbor_part_sums(spark, sf_dir):
    return S.neighbor_part_sums(counted_level(spark, sf_dir), F.col("n"))


@query(f"WITH {leaves_sql()} SELECT part, count(*) AS cells, CAST(count(*) AS DOUBLE) AS weight FROM leaf GROUP BY part")
def partition_balance(spark, sf_dir):
    return S.balance(one_level(spark, sf_dir))


@query(f"{leaf_counts_sql()} SELECT cell, lvl, CAST(sum(n) AS BIGINT) AS n, CAST(sum(qty) AS BIGINT) AS qty FROM (SELECT {O.ancestor(M1, 'cell', '0')} AS cell, 0 AS lvl, n, qty FROM cells UNION ALL SELECT cell, lvl, n, qty FROM cells WHERE lvl = 1) GROUP BY cell, lvl")
def level_pyramid(spark, sf_dir):
    return S.level_pyramid(counted_level(spark, sf_dir), {"n": F.sum("n"), "qty": F.sum("qty")})


@query(f"{leaf_counts_sql()} SELECT {O.ancestor(M1, 'cell', '0')} AS cell, avg(n) AS n FROM cells WHERE lvl >= 0 GROUP BY 1")
def restrict_average(spark, sf_dir):
    return S.pyramid(counted_level(spark, sf_dir), {"n": F.avg("n")}, 0)


_LEVELS = "SELECT {l0} AS cell, 0 AS lvl, count(*) AS n, CAST(sum(qty) AS BIGINT) AS qty FROM {rows} GROUP BY 1 UNION ALL SELECT {l1}, 1, count(*), CAST(sum(qty) AS BIGINT) FROM {rows} WHERE {l0} IN (SELECT cell FROM r0) GROUP BY 1"


def _levels(meta: GridMeta, rows: str) -> str:
    """The sums of a grid whose cells in r0 are refined, level by level."""
    return _LEVELS.format(l0=O.cell(meta, ("ix", "iy", "iz"), "0"), l1=O.cell(meta, ("ix", "iy", "iz"), "1"), rows=rows)


@query(f"WITH {leaves_sql()}, kept AS (SELECT p.* FROM (SELECT *, l_returnflag AS flag FROM (SELECT lineitem.*, {items_sql(M1).split('SELECT ', 1)[1].rsplit(' FROM lineitem', 1)[0]} FROM lineitem)) p WHERE flag <> 'R') {_levels(M1, 'kept')}")
def pyramid_by_deltas(spark, sf_dir):
    """All rows in three batches, then a batch that takes returned ones away, one batch sent twice and a compaction between: the sums are those of a recount."""
    grid = one_level(spark, sf_dir)
    pyramid = DeltaPyramid(spark, _folder(spark), grid, at(), {"n": F.lit(1), "qty": F.col("qty")})
    rows = items(spark, sf_dir, M1)
    for batch in (0, 1, 1, 2):
        pyramid.apply(rows.filter(F.col("okey") % 3 == batch), batch)
    pyramid.compact()
    pyramid.apply(rows.filter("flag = 'R'"), 3, -1)
    return pyramid.totals()


EVENTS = GridMeta((16, 4, 4), 1)
_KINDS = ("click", "error", "purchase", "signup", "view")


@query(f"WITH pts AS (SELECT CAST(date_diff('day', TIMESTAMP '2024-01-01', ts) AS BIGINT) AS ix, user_id // 20 AS iy, list_position({list(_KINDS)}, event_type) AS iz, 1 AS qty FROM events), r0 AS (SELECT cell FROM (SELECT {O.cell(EVENTS, ('ix', 'iy', 'iz'), '0')} AS cell FROM pts) GROUP BY cell HAVING count(*) * 100 > (SELECT count(*) FROM pts)), s AS ({_levels(EVENTS, 'pts')}) SELECT cell, lvl, n FROM s WHERE cell <> 0")
def pyramid_of_stream(spark, sf_dir):
    """A stream of events by day, user and type, whose batches are added to a pyramid as they come: the sums are those of a recount."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("ts", "user_id", "event_type")
    index = (F.datediff(F.col("ts").cast("date"), F.lit("2024-01-01").cast("date")).cast("long"), mapping.div(F.col("user_id"), 20), F.array_position(F.lit(list(_KINDS)), F.col("event_type")))
    grid = refined_by_count(Grid.level0(spark, EVENTS), events, index, F.col("n") * 100 > F.col("total"))
    path = _folder(spark)
    pyramid = DeltaPyramid(spark, f"{path}/pyramid", grid, index, {"n": F.lit(1)})
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(_stream_folder(spark, events, path))
    pyramid.follow(stream.select("ts", "user_id", "event_type"), f"{path}/checkpoint", availableNow=True).awaitTermination()
    return pyramid.totals()


def _stream_folder(spark, events: DataFrame, path: str) -> str:
    """A folder of the table's rows in several files, as a stream would find them."""
    events.repartition(3).write.parquet(f"{path}/events")
    return f"{path}/events"


# --- E: refinement -------------------------------------------------------------------------------------------------

DEEP = "l1_dense AS (SELECT cell FROM (SELECT {c1} AS cell FROM pts) GROUP BY cell HAVING count(*) * 700 > (SELECT count(*) FROM pts))"


@query(f"WITH {leaves_sql()} SELECT cell, lvl, ix, iy, iz, len FROM leaf")
def refine_children(spark, sf_dir):
    return one_level(spark, sf_dir).cells.select("cell", "lvl", "ix", "iy", "iz", "len")


def two_levels(spark, sf_dir: str) -> Grid:
    """Cells of level 0 with over a hundredth of the rows are refined, then a third of their children; what must follow, follows."""
    grid = one_level(spark, sf_dir, M2)
    chosen = grid.cells.filter("lvl = 1 and (ix + iy + iz) % 3 = 0").select("cell")
    return A.adapt(grid, refine=chosen).grid


_DENSE2 = f"pts AS ({items_sql(M2)}), r0 AS (SELECT cell FROM (SELECT {O.cell(M2, ('ix', 'iy', 'iz'), '0')} AS cell FROM pts) GROUP BY cell HAVING count(*) * 100 > (SELECT count(*) FROM pts))"
_ONCE2 = f"a1 AS (SELECT range AS cell FROM range(1, 118) WHERE range NOT IN (SELECT cell FROM r0) UNION ALL SELECT cell FROM ({O.children(M2, 'SELECT cell FROM r0')})), g1 AS ({O.placed(M2, 'SELECT cell FROM a1')})"
_P0 = f"{_DENSE2}, {_ONCE2}, c1 AS (SELECT cell FROM g1 WHERE lvl = 1 AND (ix + iy + iz) % 3 = 0)"
_NEAR1 = f"n1 AS (SELECT cell, nbr FROM ({O.near(M2, 'g1')}) UNION SELECT nbr, cell FROM ({O.near(M2, 'g1')}))"
_INDUCED = "c2 AS (SELECT cell FROM c1 UNION SELECT n1.nbr FROM n1 JOIN g1 a ON a.cell = n1.cell JOIN g1 b ON b.cell = n1.nbr WHERE n1.cell IN (SELECT cell FROM c1) AND b.lvl < a.lvl), c3 AS (SELECT cell FROM c2 UNION SELECT n1.nbr FROM n1 JOIN g1 a ON a.cell = n1.cell JOIN g1 b ON b.cell = n1.nbr WHERE n1.cell IN (SELECT cell FROM c2) AND b.lvl < a.lvl)"
_TWO = f"{_P0}, {_NEAR1}, {_INDUCED}, a2 AS (SELECT cell FROM a1 WHERE cell NOT IN (SELECT cell FROM c3) UNION ALL SELECT cell FROM ({O.children(M2, 'SELECT cell FROM c3')}))"


@query(f"WITH {_TWO} {O.placed(M2, 'SELECT cell FROM a2')}")
def refine_induced(spark, sf_dir):
    return two_levels(spark, sf_dir).cells.select("cell", "lvl", "ix", "iy", "iz", "len")


@query(f"WITH {_TWO}, leaf AS ({O.placed(M2, 'SELECT cell FROM a2')}) {O.near(M2)}")
def neighbors_of_two_levels(spark, sf_dir):
    return N.neighbors_of(two_levels(spark, sf_dir))


@query(f"WITH {_TWO}, leaf AS ({O.placed(M2, 'SELECT cell FROM a2')}), p AS (SELECT DISTINCT cell, nbr FROM ({O.near(M2)})) SELECT DISTINCT CASE WHEN a.lvl < b.lvl THEN a.cell ELSE b.cell END AS coarse, CASE WHEN a.lvl < b.lvl THEN b.cell ELSE a.cell END AS fine FROM p JOIN leaf a ON a.cell = p.cell JOIN leaf b ON b.cell = p.nbr WHERE a.lvl <> b.lvl")
def pairs_by_deltas(spark, sf_dir):
    """Neighbors of different levels, kept through two adaptations: each looks only around the cells it changed."""
    none = spark.createDataFrame([], "coarse long, fine long")
    counts = settle(sums_per_leaf(Grid.level0(spark, M2), items(spark, sf_dir, M2), at(), {"n": F.lit(1)}))
    total = counts.agg(F.sum("n")).first()[0] or 0
    first = A.adapt(Grid.level0(spark, M2), refine=counts.filter(F.col("n") * 100 > total).select("cell"), pairs=none)
    chosen = first.grid.cells.filter("lvl = 1 and (ix + iy + iz) % 3 = 0").select("cell")
    return A.adapt(first.grid, refine=chosen, pairs=first.pairs).pairs.select("coarse", "fine")


@query(
    f"WITH {_P0}, {_NEAR1}, v0 AS (SELECT cell FROM g1 WHERE lvl = 0 AND cell % 7 = 2), v1 AS (SELECT cell FROM v0 UNION SELECT n1.nbr FROM n1 JOIN g1 a ON a.cell = n1.cell JOIN g1 b ON b.cell = n1.nbr WHERE n1.cell IN (SELECT cell FROM v0) AND b.lvl > a.lvl), w AS (SELECT cell FROM c1 WHERE cell NOT IN (SELECT cell FROM v1)), w2 AS (SELECT cell FROM w UNION SELECT n1.nbr FROM n1 JOIN g1 a ON a.cell = n1.cell JOIN g1 b ON b.cell = n1.nbr WHERE n1.cell IN (SELECT cell FROM w) AND b.lvl < a.lvl) SELECT cell FROM ({O.children(M2, 'SELECT cell FROM w2')})"
)
def refine_vetoed(spark, sf_dir):
    """New cells where refining some cells is vetoed: finer neighbors of vetoed cells stay whole too."""
    grid = one_level(spark, sf_dir, M2)
    chosen = grid.cells.filter("lvl = 1 and (ix + iy + iz) % 3 = 0").select("cell")
    return A.adapt(grid, refine=chosen, dont_refine=grid.cells.filter("lvl = 0 and cell % 7 = 2").select("cell")).new


_MERGE = (
    f"WITH {_TWO}, leaf AS ({O.placed(M2, 'SELECT cell FROM a2')}), u AS (SELECT cell, lvl, {O.ancestor(M2, 'cell', 'greatest(lvl - 1, 0)')} AS grp FROM leaf WHERE lvl > 0), g AS (SELECT grp FROM u GROUP BY grp HAVING count(*) = 8 AND count(*) FILTER (cell % 5 = 0) > 0 AND count(*) FILTER (cell % 11 = 3) = 0), "
    f"gp AS ({O.placed(M2, 'SELECT grp AS cell FROM g')}), boxes AS (SELECT gp.cell, gp.lvl, gp.len, gp.ix + hx * gp.len AS bx, gp.iy + hy * gp.len AS bby, gp.iz + hz * gp.len AS bz FROM gp CROSS JOIN (VALUES {', '.join(str((x, y, z)) for x in (-1, 0, 1) for y in (-1, 0, 1) for z in (-1, 0, 1) if (x, y, z) != (0, 0, 0))}) h(hx, hy, hz)), "
    "bad AS (SELECT DISTINCT boxes.cell FROM boxes JOIN leaf ON leaf.ix < bx + boxes.len AND leaf.ix + leaf.len > bx AND leaf.iy < bby + boxes.len AND leaf.iy + leaf.len > bby AND leaf.iz < bz + boxes.len AND leaf.iz + leaf.len > bz WHERE leaf.lvl > boxes.lvl + 1)"
)


@query(f"{_MERGE} SELECT u.cell, u.grp AS parent FROM u WHERE grp IN (SELECT grp FROM g) AND grp NOT IN (SELECT cell FROM bad)")
def unrefine_groups(spark, sf_dir):
    """Merged cells: one request per group is enough; a veto for any sibling, or finer leaves around the parent, keep the group."""
    grid = two_levels(spark, sf_dir)
    done = A.adapt(grid, unrefine=grid.cells.filter("cell % 5 = 0").select("cell"), dont_unrefine=grid.cells.filter("cell % 11 = 3").select("cell"))
    return done.removed.select("cell", mapping.parent(M2, F.col("cell")).alias("parent"))


@query(f"WITH {_TWO}, leaf AS ({O.placed(M2, 'SELECT cell FROM a2')}) SELECT CAST(count(*) AS BIGINT) AS leaves, CAST(sum(len * len * len) AS BIGINT) AS volume, CAST(0 AS BIGINT) AS jumps, CAST(0 AS BIGINT) AS overlaps, CAST(0 AS BIGINT) AS missing, CAST(0 AS BIGINT) AS one_sided, CAST(0 AS BIGINT) AS misplaced FROM leaf")
def grid_invariants(spark, sf_dir):
    grid = two_levels(spark, sf_dir)
    n = lambda df, name: df.agg(F.count(F.lit(1)).alias(name))
    out = n(grid.cells, "leaves").crossJoin(checks.volume(grid).select("volume"))  # one row each
    for df, name in ((checks.level_jumps(grid), "jumps"), (checks.overlapping_leaves(grid), "overlaps"), (checks.missing_neighbors(grid), "missing"), (checks.one_sided(grid), "one_sided"), (checks.bad_places(grid), "misplaced")):
        out = out.crossJoin(n(df, name))
    return out


_LISTED = f"SELECT DISTINCT s_suppkey * 7919 % {M2.last_cell + 500} AS cell FROM supplier"


@query(
    f"WITH want AS (SELECT * FROM ({O.placed(M2, _LISTED)}) WHERE lvl >= 0), r0 AS (SELECT DISTINCT {O.ancestor(M2, 'cell', '0')} AS cell FROM want WHERE lvl > 0), {_ONCE2}, c1 AS (SELECT DISTINCT {O.ancestor(M2, 'cell', '1')} AS cell FROM want WHERE lvl > 1), "
    f"{_NEAR1}, {_INDUCED}, a2 AS (SELECT cell FROM a1 WHERE cell NOT IN (SELECT cell FROM c3) UNION ALL SELECT cell FROM ({O.children(M2, 'SELECT cell FROM c3')})) SELECT cell, lvl, cell IN (SELECT cell FROM want) AS listed FROM ({O.placed(M2, 'SELECT cell FROM a2')})"
)
def load_listed_cells(spark, sf_dir):
    """The grid in which cells listed in a table exist; ids beyond the last are passed over, and listed cells around smaller listed ones are refined."""
    wanted = spark.read.parquet(f"{sf_dir}/supplier.parquet").select((F.col("s_suppkey") * 7919 % (M2.last_cell + 500)).alias("cell")).distinct()
    cells = A.load_cells(Grid.level0(spark, M2), wanted).cells
    return cells.join(F.broadcast(wanted.withColumn("listed", F.lit(True))), "cell", "left").select("cell", "lvl", F.coalesce("listed", F.lit(False)).alias("listed"))


# --- F: partitions -------------------------------------------------------------------------------------------------


@query(f"WITH {leaves_sql()}, o AS (SELECT cell, (row_number() OVER (ORDER BY cell) - 0.5) / count(*) OVER () * 5 AS p FROM leaf) SELECT cell, CAST(floor(p) AS INTEGER) AS part FROM o")
def partition_block(spark, sf_dir):
    return P.partition(one_level(spark, sf_dir), 5, "BLOCK").cells.select("cell", "part")


_ZKEY = " + ".join(f"(((i{a} >> {b}) & 1) << {3 * b + d})" for d, a in enumerate("xyz") for b in range(5))


@query(f"{leaf_counts_sql()}, o AS (SELECT cell, n + 1 AS w, {_ZKEY} AS z FROM cells), r AS (SELECT cell, w, CAST(sum(w) OVER (ORDER BY z, cell) AS DOUBLE) AS run, CAST(sum(w) OVER () AS DOUBLE) AS total FROM o) SELECT cell, CAST(least(floor((run - w / 2.0::DOUBLE) / total * 6), 5) AS INTEGER) AS part FROM r")
def partition_weighted(spark, sf_dir):
    grid = counted_level(spark, sf_dir)
    weights = grid.cells.select("cell", (F.col("n") + 1).cast("double").alias("weight"))
    return P.partition(P.set_weights(grid, weights), 6, "HSFC").cells.select("cell", "part")


@query(f"WITH {leaves_sql()}, o AS (SELECT cell, (row_number() OVER (ORDER BY cell) - 0.5) / count(*) OVER () * 5 AS p FROM leaf) SELECT cell, CAST(CASE WHEN cell % 10 = 7 THEN 4 ELSE floor(p) END AS INTEGER) AS part FROM o")
def partition_pins(spark, sf_dir):
    grid = one_level(spark, sf_dir)
    pins = grid.cells.filter("cell % 10 = 7 or cell % 10 = 8").select("cell", F.lit(4).alias("pin"))
    grid = P.unpin(P.pin(grid, pins), grid.cells.filter("cell % 10 = 8"))
    return P.partition(grid, 5, "BLOCK").cells.select("cell", "part")


@query(f"WITH {leaves_sql()}, o AS (SELECT cell, part, CAST(floor((row_number() OVER (ORDER BY cell) - 0.5) / count(*) OVER () * 5) AS INTEGER) AS p FROM leaf) SELECT cell, part AS from_part, p AS to_part FROM o WHERE part <> p")
def balance_moves(spark, sf_dir):
    grid = one_level(spark, sf_dir)
    return P.moved(grid, P.balance_load(grid, 5, "BLOCK"))


# --- H, I: files and workloads ---------------------------------------------------------------------------------------


_HALVES = ", ".join(f"(i{a} + len * (k >> {d} & 1)) / 2.0::DOUBLE" for d, a in enumerate("xyz"))


@query(
    f"{leaf_counts_sql()}, v AS (SELECT *, row_number() OVER (ORDER BY cell) - 1 AS i FROM cells) SELECT 1 AS section, i AS n, k, concat_ws(' ', {_HALVES}) AS line FROM v CROSS JOIN (SELECT CAST(range AS INTEGER) AS k FROM range(8)) "
    "UNION ALL SELECT 3, i, 0, concat_ws(' ', 8, i*8, i*8+1, i*8+2, i*8+3, i*8+4, i*8+5, i*8+6, i*8+7) FROM v UNION ALL SELECT 5, i, 0, '11' FROM v UNION ALL SELECT 7, i, 0, CAST(n AS VARCHAR) FROM v "
    "UNION ALL SELECT section, 0, k, replace(replace(line, '#8', CAST((SELECT count(*) * 8 FROM v) AS VARCHAR)), '#', CAST((SELECT count(*) FROM v) AS VARCHAR)) FROM (VALUES (0, 0, '~ vtk DataFile Version 2.0'), (0, 1, 'leaf cells as voxels'), (0, 2, 'ASCII'), (0, 3, 'DATASET UNSTRUCTURED_GRID'), (0, 4, 'POINTS #8 float'), (4, 0, 'CELL_TYPES #'), (6, 0, 'CELL_DATA #'), (6, 1, 'SCALARS n float 1'), (6, 2, 'LOOKUP_TABLE default')) h(section, k, line) "
    "UNION ALL SELECT 2, 0, 0, concat('CELLS ', count(*), ' ', count(*) * 9) FROM v"
)
def vtk_rows(spark, sf_dir):
    """Every line of the file of a refined grid with rows per leaf as cell data; coordinates as numbers, the first heading's sign as ~."""
    lines = store.vtk_lines(counted_level(spark, sf_dir), ("n",))
    split = F.split("line", " ")
    number = F.when(F.col("section") == 1, F.concat_ws(" ", *[F.element_at(split, i).cast("double").cast("string") for i in (1, 2, 3)])).otherwise(F.regexp_replace("line", "^#", "~"))
    return lines.select("section", "n", "k", number.alias("line"))


def _folder(spark) -> str:
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir") or "file://" + tempfile.mkdtemp(prefix="cellarium-")
    return f"{root}/grids/{uuid.uuid4().hex}"


@query(f"{leaf_counts_sql()} SELECT cell, lvl, n, qty FROM cells")
def parquet_round_trip(spark, sf_dir):
    path = _folder(spark)
    store.save(counted_level(spark, sf_dir), path, "counts")
    return store.load(spark, path)[0].cells.select("cell", "lvl", "n", "qty")


@query(f"{leaf_counts_sql()} SELECT cell, lvl, n, qty FROM cells")
def binary_round_trip(spark, sf_dir):
    path = f"{_folder(spark)}.bin"
    grid = counted_level(spark, sf_dir)
    store.write_binary(grid, path, {"n": "q", "qty": "q"}, header=b"step 1  ")
    return store.read_binary(spark, path, {"n": "q", "qty": "q"}, 8)[0].cells.select("cell", "lvl", "n", "qty")


@query(f"{leaf_counts_sql()} SELECT cell, lvl, part, CAST(n AS DOUBLE) AS density, CAST(qty AS DOUBLE) AS vx FROM cells")
def snapshot_round_trip(spark, sf_dir):
    path = f"{_folder(spark)}.dc"
    grid = counted_level(spark, sf_dir)
    flow = grid.meta.with_(geometry=Cartesian())
    columns = {"density": F.col("n"), "vx": F.col("qty"), **{c: F.lit(0.0) for c in ("max_diff", "vy", "vz")}}
    snapshot.write_snapshot(Grid(flow, grid.cells).with_columns(columns), path)
    return snapshot.read_snapshot(spark, path)[0].cells.select("cell", "lvl", "part", "density", "vx")


@query(f"{leaf_counts_sql()} SELECT cell, lvl, n FROM cells WHERE cell BETWEEN 60 AND 500 AND n > 2")
def grid_file_range(spark, sf_dir):
    """Of a saved grid, a range of ids: only that part of the file is read, and of its columns one."""
    path = f"{_folder(spark)}.bin"
    store.write_binary(counted_level(spark, sf_dir), path, {"n": "q", "qty": "q"})
    rows = store.open_binary(spark, path).rows({"n": "q", "qty": "q"}, ("cell", "n")).filter("cell between 60 and 500 and n > 2")
    return rows.select("cell", mapping.level_of(M1, F.col("cell")).alias("lvl"), "n")


FLOW = GridMeta((20, 20, 1), 0, (True, True, False), 0, Cartesian((0.0, 0.0, 0.0), (0.05, 0.05, 0.05)))
_FLOW_CELLS = "SELECT range AS cell, (range - 1) % 20 AS ix, (range - 1) // 20 AS iy FROM range(1, 401)"
_FLOW_STATE = f"s AS (SELECT cell, ix, iy, 0.25 * (1 + cos(pi() * least(sqrt(pow(x - 0.25, 2) + pow(y - 0.5, 2)), 0.15) / 0.15)) AS d, 0.5 - y AS vx, x - 0.5 AS vy FROM (SELECT *, ix * 0.05 + 0.025 AS x, iy * 0.05 + 0.025 AS y FROM ({_FLOW_CELLS})))"
_FLOW_TERMS = "SELECT a.cell, sum(CASE WHEN k > 0 THEN -1 ELSE 1 END * CASE WHEN (v >= 0) = (k > 0) THEN a.d ELSE b.d END * v * 0.01 / 0.05) AS f FROM s a CROSS JOIN (VALUES (1, 1, 0), (-1, -1, 0), (2, 0, 1), (-2, 0, -1)) h(k, hx, hy) JOIN s b ON b.ix = (a.ix + hx + 20) % 20 AND b.iy = (a.iy + hy + 20) % 20 CROSS JOIN LATERAL (SELECT CASE WHEN abs(k) = 1 THEN (a.vx + b.vx) / 2 ELSE (a.vy + b.vy) / 2 END AS v) GROUP BY a.cell"


@query(f"WITH {_FLOW_STATE}, f AS ({_FLOW_TERMS}) SELECT s.cell, CAST(round((s.d + f.f) * 1000000) AS BIGINT) AS density FROM s JOIN f USING (cell)")
def advection_step(spark, sf_dir):
    grid = W.advection_step(W.advection_start(Grid.level0(spark, FLOW)), 0.01)
    return grid.cells.select("cell", F.round(F.col("density") * 1000000).cast("long").alias("density"))


LINE = GridMeta((32, 1, 1), 0, (True, True, True), 0, Cartesian((0.0, 0.0, 0.0), (2 * math.pi / 32,) * 3))


def _sine(spark, n: int = 32) -> Grid:
    meta = GridMeta((n, 1, 1), 0, (True, True, True), 0, Cartesian((0.0, 0.0, 0.0), (2 * math.pi / n,) * 3))
    grid = Grid.level0(spark, meta)
    x = geometry.center(meta, F.col("cell"))[0]
    return grid.with_columns({"rhs": -F.sin(x), "solution": F.lit(0.0)})


_H2 = (2 * math.pi / 32) ** 2


@query(f"SELECT range AS cell, CAST(round(sin((range - 0.5) * {2 * math.pi / 32!r}) * {_H2 / 6!r} * 1000000000) AS BIGINT) AS solution FROM range(1, 33)")
def poisson_jacobi_step(spark, sf_dir):
    """One sweep from zero: the right side over the diagonal, that of three periodic dimensions."""
    system = W.poisson_system(_sine(spark))
    return W.jacobi_step(system, system.cells).select("cell", F.round(F.col("solution") * 1000000000).cast("long").alias("solution"))


@query(f"SELECT range AS cell, CAST(round(sin((range - 0.5) * {2 * math.pi / 32!r}) * {_H2 / (2 - 2 * math.cos(2 * math.pi / 32))!r} * 1000000) AS BIGINT) AS solution FROM range(1, 33)")
def poisson_solve(spark, sf_dir):
    """The discrete equation's exact solution: a sine over the second difference's factor."""
    system = W.poisson_system(_sine(spark))
    solution, _, _ = W.poisson_solve(system, max_iterations=20, stop_residual=1e-12)
    mean = solution.agg(F.avg("solution")).first()[0]
    return solution.select("cell", F.round((F.col("solution") - mean) * 1000000).cast("long").alias("solution"))


@query(
    "WITH d AS (SELECT CAST(o_orderdate AS DATE) - (SELECT min(CAST(o_orderdate AS DATE)) FROM orders) AS i FROM orders), k AS (SELECT i, count(*) AS r FROM d GROUP BY i), "
    "a AS (SELECT unnest(range(0, (SELECT max(i) + 1 FROM d))) AS i), c AS (SELECT a.i, coalesce(r, 0)::DOUBLE AS r FROM a LEFT JOIN k ON a.i = k.i), "
    "f AS (SELECT i, r - avg(r) OVER () AS f, count(*) OVER () AS n FROM c), "
    "p AS (SELECT i, n, sum((i + 1) * f) OVER () / n AS w, coalesce(sum(f) OVER b, 0) AS s, coalesce(sum(i * f) OVER b, 0) AS t FROM f WINDOW b AS (ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) "
    "SELECT i AS day, CAST(round(CASE WHEN i = n - 1 THEN 0 ELSE (w * (i + 1) + i * s - t) / n / n END * 1000000) AS BIGINT) AS solution FROM p"
)
def poisson_line(spark, sf_dir):
    """Orders per day as the right side on a line of one cell per day."""
    days = spark.read.parquet(f"{sf_dir}/orders.parquet").groupBy(F.col("o_orderdate").cast("date").alias("d")).agg(F.count(F.lit(1)).alias("r"))
    days = settle(days)
    first, last = days.agg(F.min("d"), F.max("d")).first()
    n = (last - first).days + 1 if first else 0
    counted = days.select(F.datediff("d", F.lit(first)).cast("long").alias("index"), "r")
    line = spark.range(n).withColumnRenamed("id", "index").join(counted, "index", "left").select("index", F.coalesce("r", F.lit(0)).alias("rhs"))
    return W.poisson_line(line, 1 / max(n, 1)).select(F.col("index").alias("day"), F.round(F.col("solution") * 1000000).cast("long").alias("solution"))


BOX = GridMeta((3, 1, 1), 0, (True, True, True))


@query("SELECT e AS event_id, x, CAST(floor(x) AS BIGINT) + 1 AS cell FROM (SELECT event_id AS e, CASE WHEN a > 3 THEN a - 3 * ceil((a - 3) / 3) ELSE a END AS x FROM (SELECT event_id, (event_id % 12)::DOUBLE / 4 + 0.625 AS a FROM events)) WHERE x < 3")
def particle_rehome(spark, sf_dir):
    k = F.col("event_id")
    particles = spark.read.parquet(f"{sf_dir}/events.parquet").select(k, ((k % 12).cast("double") / 4 + 0.125).alias("x"), F.lit(0.5).alias("y"), F.lit(0.5).alias("z"))
    return W.propagate(Grid.level0(spark, BOX), particles, (0.5, 0.0, 0.0)).select("event_id", "x", "cell")


SPEED = GridMeta((100, 200, 300), 13, geometry=Cartesian((0.0, 0.0, 0.0), (1.0, 1.1, 1.2)))


#: The same cells with every edge given.
EVEN = SPEED.with_(geometry=Stretched.of(SPEED.geometry, SPEED.length))


@query(
    "WITH c AS (SELECT (range - 1) % 100 AS x, (range - 1) // 100 % 200 AS y, (range - 1) // 20000 AS z FROM range(1, 1000001)) "
    "SELECT 1.0::DOUBLE AS length_x, 1.1::DOUBLE AS length_y, 1.2::DOUBLE AS length_z, round(avg(x + 0.5::DOUBLE), 6) AS center_x, round(avg((y + 0.5::DOUBLE) * 1.1::DOUBLE), 6) AS center_y, round(avg((z + 0.5::DOUBLE) * 1.2::DOUBLE), 6) AS center_z FROM c"
)
def geometry_averages(spark, sf_dir):
    averages = W.geometry_averages(spark, SPEED, 1_000_000)
    return averages.select(*[F.round(c, 6).alias(c) for c in averages.columns])


def _life_sql(steps: int) -> str:
    """CTEs n and s1 .. s<steps>: the states of the unrefined automaton; s0 is given."""
    turns = [f"s{k + 1} AS (SELECT a.cell, CASE WHEN w = 3 THEN 1 WHEN w = 2 THEN a.alive ELSE 0 END AS alive FROM s{k} a JOIN (SELECT n.cell, sum(b.alive) AS w FROM n JOIN s{k} b ON b.cell = n.nbr GROUP BY n.cell) USING (cell))" for k in range(steps)]
    return f"n AS ({O.near(FLAT, 'flat')}), " + ", ".join(turns)


@query(
    f"WITH flat AS ({O.placed(FLAT, 'SELECT range AS cell FROM range(1, 118)')}), s0 AS (SELECT cell, CAST(cell IN (SELECT 1 + p_partkey * 7 % 117 FROM part GROUP BY 1 HAVING count(*) % 2 = 1) AS INTEGER) AS alive FROM flat), {_life_sql(3)}, {leaves_sql()} SELECT leaf.cell, CAST(s3.alive AS INTEGER) AS alive FROM leaf JOIN s3 ON s3.cell = {O.ancestor(M1, 'leaf.cell', '0')}"
)
def life_steps_refined(spark, sf_dir):
    """Three steps on a refined grid: every leaf has what its ancestor has after three steps on the unrefined one."""
    return W.life(_alive(spark, sf_dir, one_level(spark, sf_dir)), 3, refined=True).cells.select("cell", "alive")


@query(f"WITH {_FLOW_STATE} SELECT CAST(round(sum(d) * 0.05 * 0.05 * 0.05 * 1e9) AS BIGINT) AS mass, CAST(400 * 8 AS BIGINT) AS volume, true AS refined FROM s")
def advection_adaptive(spark, sf_dir):
    """Three steps, with adaptation after the second: the mass is the start's, the leaves (of 8 smallest cells at level 0) tile the grid, and some are refined."""
    meta = GridMeta((20, 20, 1), 1, (True, True, False), 1, FLOW.geometry)
    grid = W.advection(W.advection_start(Grid.level0(spark, meta)), 0.3, adapt_every=2)
    volume = F.col("length_x") * F.col("length_y") * F.col("length_z")
    return grid.cells.agg(F.round(F.sum(F.col("density") * volume) * 1e9).cast("long").alias("mass"), F.sum(F.col("len") * F.col("len") * F.col("len")).alias("volume"), (F.max("lvl") > 0).alias("refined"))


# --- what nothing above asks for -------------------------------------------------------------------------------------


@query(f"WITH {leaves_sql()} SELECT 13 AS x, 3 AS y, 3 AS z, 1 AS max_level, CAST({M1.last_cell} AS BIGINT) AS last_cell, 20 AS largest_level, -1.5::DOUBLE AS start_x, 1.0::DOUBLE AS end_x, 2.375::DOUBLE AS end_z, 0.5::DOUBLE AS length_x, CAST(count(*) AS BIGINT) AS leaves, max(lvl) AS finest, max(cell) AS largest_cell, CAST(sum(len * len * len) AS BIGINT) AS volume FROM leaf")
def grid_description(spark, sf_dir):
    """Lengths, levels, ids and corners as metadata gives them, beside the leaves of the grid over lineitem. 117 * (8^20 - 1) / 7 * 8 fits 63 bits, one level more doesn't."""
    largest = GridMeta((1, 1, 1), -1)
    told = {"x": M1.length[0], "y": M1.length[1], "z": M1.length[2], "max_level": M1.max_level, "last_cell": M1.last_cell, "largest_level": largest.max_level, "start_x": DYADIC.start[0], "end_x": DYADIC.end[0], "end_z": DYADIC.end[2], "length_x": DYADIC.geometry.level0_length[0]}
    leaves = one_level(spark, sf_dir).cells.agg(F.count(F.lit(1)).alias("leaves"), F.max("lvl").alias("finest"), F.max("cell").alias("largest_cell"), F.sum(F.col("len") * F.col("len") * F.col("len")).alias("volume"))
    return leaves.select(*[F.lit(v).alias(k) if k != "last_cell" else F.lit(v).cast("long").alias(k) for k, v in told.items()], "*")


@query(f"WITH {leaves_sql()} SELECT cell, lvl, part, 1.0::DOUBLE AS weight, cell * 2 AS twice FROM leaf")
def copied_structure(spark, sf_dir):
    """The same cells and owners with other data; ids twice, as a derived item would give them."""
    return one_level(spark, sf_dir).with_columns({"old": F.lit("x")}).copy_structure({"twice": F.col("cell") * 2}).cells.select("cell", "lvl", "part", "weight", "twice")


@query(_with_level(f"SELECT okey, {_X} // 8 AS ix, {_Y} // 8 AS iy, {_Z} // 8 AS iz FROM i"))
def level0_places(spark, sf_dir):
    ids = _ids(spark, sf_dir, IDS)
    return ids.select("okey", *[v.alias(c) for c, v in zip(("ix", "iy", "iz"), geometry.level0_start_index(IDS, F.col("cell")))])


BALANCES = GridMeta((4, 4, 1), 2, (False, True, False), geometry=Cartesian((-1024.0, -1024.0, 0.0), (4096.0, 4096.0, 1.0)))


def _at_level(level: int) -> str:
    """The cell of a level around (a, a wrapped, 0.5): the smallest cells are 1024 wide and 0.25 high."""
    return O.cell(BALANCES, ("ix", "iy", "2"), str(level))


@query(f"SELECT c_custkey, {_at_level(0)} AS l0, {_at_level(1)} AS l1, {_at_level(2)} AS l2 FROM (SELECT c_custkey, CAST(floor((a + 1024) / 1024) AS BIGINT) AS ix, CAST(floor((CASE WHEN a < -1024 THEN a + 16384 ELSE a END + 1024) / 1024) AS BIGINT) AS iy FROM (SELECT c_custkey, CAST(c_acctbal AS DOUBLE) * 2 AS a FROM customer))")
def cells_of_points_at_level(spark, sf_dir):
    points = spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", (F.col("c_acctbal").cast("double") * 2).alias("a"))
    return points.select("c_custkey", *[geometry.cell_at_point(BALANCES, F.lit(k), (F.col("a"), F.col("a"), F.lit(0.5))).alias(f"l{k}") for k in range(3)])


@query(f"WITH {leaves_sql()} SELECT cell, lvl, part FROM leaf WHERE cell IN (1, 39, 117, 130, 500, 1000)")
def cells_by_id(spark, sf_dir):
    grid = one_level(spark, sf_dir)
    return reduce(DataFrame.unionByName, [grid[c] for c in (1, 39, 117, 130, 500, 1000)]).select("cell", "lvl", "part")


@query(f"{MASKS} SELECT cell, part FROM leaf JOIN m USING (cell) WHERE part = 1 AND mask IN (4, 12)")
def cells_by_exact_neighbor_type(spark, sf_dir):
    grid = one_level(spark, sf_dir).add_hood("cross", CROSS)
    return L.get_cells(grid, 1, [L.REMOTE_OF, L.REMOTE_OF | L.REMOTE_TO], exact=True, hood="cross", ordered=True).select("cell", "part")


@query(f"WITH {leaves_sql()} SELECT cell FROM leaf WHERE {O.ancestor(M1, 'cell', '0')} BETWEEN 40 AND 78")
def cells_overlapping_part(spark, sf_dir):
    """Leaves whose ancestor of level 0 belongs to the second of three blocks."""
    grid = one_level(spark, sf_dir)
    return L.overlapping_part(grid, grid.cells.select("cell"), 1, Grid.level0(spark, FLAT, 3))


_COUNT0 = f"r AS (SELECT {O.cell(M0, ('ix', 'iy', 'iz'), '0')} AS cell, count(*) AS n FROM ({items_sql(M0)}) GROUP BY 1)"


@query(f"WITH k AS (SELECT cell, {' + '.join(f'((i{a} >> {b} & 1) << {3 * b + d})' for d, a in enumerate('xyz') for b in range(4))} AS z FROM ({O.placed(FLAT, 'SELECT range AS cell FROM range(1, 118)')})), o AS (SELECT cell, row_number() OVER (ORDER BY z, cell) - 1 AS r FROM k), {_COUNT0} SELECT o.cell, CAST(CASE WHEN r < 32 THEN r // 16 ELSE 2 + (r - 32) // 17 END AS INTEGER) AS part, coalesce(n, 0) AS n FROM o LEFT JOIN r ON r.cell = o.cell")
def level0_along_curve(spark, sf_dir):
    """Cells dealt along the curve, each with its rows."""
    rows = binned(items(spark, sf_dir, M0), M0, at()).groupBy("cell").agg(F.count(F.lit(1)).alias("n"))
    return Grid.level0(spark, FLAT, 7, "curve").cells.join(rows, "cell", "left").select("cell", "part", F.coalesce("n", F.lit(0)).alias("n"))


_POINTS = "SELECT DISTINCT 1 + CAST(n_nationkey % 13 AS BIGINT) + CAST(n_regionkey % 3 AS BIGINT) * 13 AS cell FROM nation"


@query(f"WITH r AS ({_POINTS}) SELECT range AS cell, 0 AS lvl FROM range(1, 118) WHERE range NOT IN (SELECT cell FROM r) UNION ALL SELECT cell, 1 FROM ({O.children(M1, 'SELECT cell FROM r')})")
def refine_at_points(spark, sf_dir):
    """Cells around points are refined; a point outside asks for nothing."""
    nation = spark.read.parquet(f"{sf_dir}/nation.parquet")
    points = nation.select((F.col("n_nationkey") % 13 * 1.0 + 0.5).alias("x"), (F.col("n_regionkey") % 3 * 1.0 + 0.25).alias("y"), F.lit(0.75).alias("z"))
    points = points.unionByName(spark.range(1).select(F.lit(-1.0).alias("x"), F.lit(0.0).alias("y"), F.lit(0.0).alias("z")))
    grid = Grid.level0(spark, M1)
    return A.adapt(grid, refine=A.requests_at(grid, points)).grid.cells.select("cell", "lvl")


_DEALT = f"c AS (SELECT {O.cell(M0, ('ix', 'iy', 'iz'), '0')} AS cell, sum(qty)::BIGINT AS qty FROM ({items_sql(M0)}) GROUP BY 1), f AS (SELECT range AS cell, coalesce(qty, 0) AS qty FROM range(1, 118) LEFT JOIN c ON c.cell = range)"


@query(f"WITH {_DEALT} SELECT 'refined' AS step, k.cell, f.qty / 8.0::DOUBLE AS qty FROM ({O.children(M1, 'SELECT unnest([1, 20, 60, 61])::BIGINT AS cell')}) k JOIN f ON f.cell = k.parent UNION ALL SELECT 'merged', cell, CAST(qty AS DOUBLE) FROM f WHERE cell IN (1, 60, 61)")
def prolong_and_restrict(spark, sf_dir):
    """Children get an eighth of their parent's quantity; what merges again has its children's sum. One of the groups is kept."""
    sums = binned(items(spark, sf_dir, M0), M0, at()).groupBy("cell").agg(F.sum("qty").alias("s"))
    flat = Grid.level0(spark, M1)
    flat = flat.with_cells(settle(flat.cells.join(sums, "cell", "left").withColumn("qty", F.coalesce("s", F.lit(0)).cast("double")).drop("s")))
    fine = A.adapt(flat, refine=[1, 20, 60, 61], prolong={"qty": F.col("qty") / 8})
    born = fine.new.join(fine.grid.cells, "cell").select(F.lit("refined").alias("step"), "cell", "qty")
    back = A.adapt(fine.grid, unrefine=fine.new, dont_unrefine=fine.grid.cells.filter("lvl = 1 and ix = 12 and iy = 2 and iz = 0"), restrict={"qty": F.sum("qty")})
    merged = back.grid.cells.filter("lvl = 0 and cell in (1, 20, 60, 61)").select(F.lit("merged").alias("step"), "cell", "qty")
    return born.unionByName(merged)


@query(f"{leaf_counts_sql()}, {FACES_SQL}, d AS (SELECT f.cell, max(abs(a.n - b.n)::DOUBLE / (least(a.n, b.n) + 8)) AS diff FROM f JOIN cells a ON a.cell = f.cell JOIN cells b ON b.cell = f.nbr GROUP BY f.cell) SELECT cell, CASE WHEN diff > (lvl + 1) * 4 THEN 'refine' WHEN diff >= (lvl + 1) * 4 * 0.25 THEN 'dont_unrefine' ELSE 'unrefine' END AS request FROM d JOIN leaf USING (cell) WHERE diff > (lvl + 1) * 4 OR lvl > 0")
def requests_by_difference(spark, sf_dir):
    grid = counted_level(spark, sf_dir)
    asked = A.adaptation_requests(grid, settle(S.max_difference(grid, "n", 8)), 4.0, 0.25)
    out = None
    for kind, ids in asked.items():
        rows = ids.select("cell", F.lit(kind).alias("request"))
        out = rows if out is None else out.unionByName(rows)
    return out


def _rcb_sql(parts: int) -> str:
    """CTEs b0, b1, ... : boxes (lo, parts left) of cells, each cut across its longest side at the median."""
    steps = [f"b0 AS (SELECT cell, (ix + len / 2.0::DOUBLE) / 2 AS x, (iy + len / 2.0::DOUBLE) / 2 AS y, (iz + len / 2.0::DOUBLE) / 2 AS z, 0 AS lo, {parts} AS n FROM leaf)"]
    for k in range(math.ceil(math.log2(parts))):
        side = {a: f"max({a}) OVER w - min({a}) OVER w" for a in "xyz"}
        steps.append(f"s{k} AS (SELECT *, CASE WHEN {side['x']} >= {side['y']} AND {side['x']} >= {side['z']} THEN x WHEN {side['y']} >= {side['z']} THEN y ELSE z END AS along FROM b{k} WINDOW w AS (PARTITION BY lo))")
        steps.append(f"q{k} AS (SELECT *, n > 1 AND floor((row_number() OVER (PARTITION BY lo ORDER BY along, cell) - 0.5::DOUBLE) / count(*) OVER (PARTITION BY lo) * 1048576) < (n // 2) * 1048576.0::DOUBLE / n AS l FROM s{k})")
        steps.append(f"b{k + 1} AS (SELECT cell, x, y, z, CASE WHEN n = 1 OR l THEN lo ELSE lo + n // 2 END AS lo, CASE WHEN n = 1 THEN 1 WHEN l THEN n // 2 ELSE n - n // 2 END AS n FROM q{k})")
    return ", ".join(steps)


@query(f"WITH {leaves_sql()}, {_rcb_sql(6)} SELECT cell, CAST(lo AS INTEGER) AS part FROM b3")
def partition_rcb(spark, sf_dir):
    """Every cell's part by recursive coordinate bisection."""
    return P.partition(one_level(spark, sf_dir), 6, "RCB").cells.select("cell", "part")


@query(f"WITH {leaves_sql()} SELECT m AS method, 6 AS parts, count(*) AS cells, true AS even, true AS nested FROM leaf CROSS JOIN (SELECT unnest(['RCB', 'RIB', 'HIER', 'OPTIONS']) AS m) GROUP BY m")
def partition_bisection(spark, sf_dir):
    """Recursive and inertial bisection and hierarchies, given as levels and as options: six parts, whose sizes differ by at most three cells, and in hierarchies parts 3k to 3k + 2 make up half k of the outer cut."""
    grid = one_level(spark, sf_dir)
    options = P.Options()
    options.add_level(3)
    options.set_in_level(0, "LB_METHOD", "RCB")
    halves = P.partition(grid, 2, "RCB").cells.select("cell", F.col("part").alias("half"))
    out = None
    for method, how in (("RCB", {"method": "RCB"}), ("RIB", {"method": "RIB"}), ("HIER", {"method": "HIER", "levels": ((2, "RCB"), (3, "HSFC"))}), ("OPTIONS", {"options": options})):
        cells = P.partition(grid, 6, **how).cells.join(halves, "cell")
        wrong = F.sum((F.floor(F.col("part") / 3) != F.col("half")).cast("int")) if method in ("HIER", "OPTIONS") else F.lit(0)
        sizes = cells.groupBy("part").agg(F.count(F.lit(1)).alias("n"), wrong.alias("wrong"))
        rows = sizes.agg(F.count(F.lit(1)).cast("int").alias("parts"), F.sum("n").alias("cells"), (F.max("n") - F.min("n") <= 3).alias("even"), (F.sum("wrong") == 0).alias("nested")).withColumn("method", F.lit(method))
        out = rows if out is None else out.unionByName(rows)
    return out.select("method", "parts", "cells", "even", "nested")
