"""Stencil joins: which cells lie in the neighborhoods of which.

For a leaf and an offset, the target box is the leaf moved by so many of its own lengths. On a grid in
which neighboring levels differ by one at most, the leaf there is the box itself, the cell one level up around it, or,
if neither is a leaf, all eight children of the box. So neighbors are found by two equi-joins on computed ids
and no search; a uniform grid needs none. Offsets become rows by exploding a literal array, never by a cross join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import mapping
from ..plans.grid import DEFAULT, Grid
from ..plans.shared import small

_AXES = ("ix", "iy", "iz")


def probes(grid: Grid, cells: DataFrame, offsets, keep: tuple[str, ...] = ()) -> DataFrame:
    """A row per cell and offset whose box is inside the grid: tx.. (target relative to the cell's corner, unwrapped) and wx.. (its corner, wrapped)."""
    hood = F.array(*[F.struct(F.lit(i).alias("ord"), *[F.lit(h).cast("long").alias(n) for h, n in zip(o, ("hx", "hy", "hz"))]) for i, o in enumerate(offsets)])
    rows = cells.select(*keep, "cell", "lvl", *_AXES, "len", F.explode(hood).alias("__h")).select(*keep, "cell", "lvl", *_AXES, "len", "__h.*")
    for axis, h, n, around in zip(_AXES, ("hx", "hy", "hz"), grid.meta.extent, grid.meta.periodic):
        target = F.col(axis) + F.col(h) * F.col("len")
        if not around:
            rows = rows.filter((target >= 0) & (target < n))
        rows = rows.withColumn("w" + axis[1], F.pmod(target, F.lit(n)) if around else target)
    return rows.withColumns({"t" + a[1]: F.col(h) * F.col("len") for a, h in zip(_AXES, ("hx", "hy", "hz"))}).drop("hx", "hy", "hz")


def _met(rows: DataFrame, leaf: DataFrame, wanted: Column, name: str, within: tuple[str, ...], how: str = "left") -> DataFrame:
    """rows with the leaf whose id (in leaf's column of that name) is wanted. within: columns that must agree too."""
    other = leaf.withColumnsRenamed({k: f"__{name}_{k}" for k in within})
    on = wanted == F.col(name)
    for k in within:
        on = on & (F.col(k) == F.col(f"__{name}_{k}"))
    return rows.join(other, on, how).drop(*[f"__{name}_{k}" for k in within])


def neighbors_of(grid: Grid, hood=DEFAULT, cells: DataFrame | None = None, keep: tuple[str, ...] = (), within: tuple[str, ...] = ()) -> DataFrame:
    """cell, ord (place of the offset in the neighborhood), nbr and its offset ox, oy, oz in indices, for each of cells (default: all). A larger neighbor is listed once for each offset that reaches it. within: columns of cells (kept) and of the grid's leaves that must agree, see blocks."""
    meta = grid.meta
    offsets = grid.offsets(hood)
    source = grid.cells if cells is None else cells
    if not offsets:
        return source.select(*keep, "cell", F.lit(0).alias("ord"), *[F.lit(0).cast("long").alias(c) for c in ("nbr", "ox", "oy", "oz")]).limit(0)
    rows = probes(grid, source, offsets, keep)
    corner = tuple(F.col("w" + a) for a in "xyz")
    away = [F.col("t" + a) for a in "xyz"]
    rows = rows.withColumn("same", mapping.cell_inside(meta, corner, F.col("lvl")))
    if grid.uniform:
        return rows.select(*keep, "cell", "ord", F.col("same").alias("nbr"), *[a.alias("o" + n) for a, n in zip(away, "xyz")])
    big = F.col("len") * 2
    up, down = F.greatest(F.col("lvl") - 1, F.lit(0)), F.least(F.col("lvl") + 1, F.lit(meta.max_level))
    rows = rows.withColumns({"coarse": F.when(F.col("lvl") > 0, mapping.cell_inside(meta, corner, up)), "down": mapping.cell_inside(meta, corner, down)})
    leaf = grid.cells.select("cell", *within) if within else grid.ids
    rows = _met(rows, leaf.withColumnRenamed("cell", "is_same"), F.col("same"), "is_same", within)
    rows = _met(rows, leaf.withColumnRenamed("cell", "is_coarse"), F.when(F.col("is_same").isNull(), F.col("coarse")), "is_coarse", within)

    same, coarse = F.col("is_same").isNotNull(), F.col("is_coarse").isNotNull()
    whole = same | coarse | (F.col("lvl") >= meta.max_level)
    zero = F.lit(0).cast("long")
    base = F.when(coarse, F.col("coarse")).when(whole, F.col("same")).otherwise(F.col("down"))
    shift = [F.when(coarse, a - c % big).otherwise(a) for a, c in zip(away, corner)]
    half = F.when(whole, zero).otherwise(mapping.div(F.col("len"), 2))
    kids = F.when(whole, F.lit([0])).otherwise(F.lit(list(range(8))))
    rows = rows.select(*keep, "cell", "ord", "lvl", base.alias("base"), *[v.alias("s" + n) for v, n in zip(shift, "xyz")], half.alias("half"), F.explode(kids).alias("k"))
    bits = [F.col("k").bitwiseAND(F.lit(1)), mapping.shr(F.col("k"), 1).bitwiseAND(F.lit(1).cast("long")), mapping.shr(F.col("k"), 2)]
    x, y, _ = meta.length
    nbr = F.col("base") + bits[0] + bits[1] * mapping.shl(2 * x, F.col("lvl")) + bits[2] * mapping.shl(4 * x * y, F.col("lvl") * 2)
    return rows.select(*keep, "cell", "ord", nbr.alias("nbr"), *[(F.col("s" + n) + b * F.col("half")).alias("o" + n) for n, b in zip("xyz", bits)])


def neighbors_to(grid: Grid, hood=DEFAULT) -> DataFrame:
    """cell, nbr: the cells that have cell in their neighborhood; each once."""
    return neighbors_of(grid, hood).select(F.col("nbr").alias("cell"), F.col("cell").alias("nbr")).distinct()


def with_places(grid: Grid, neigh: DataFrame, columns: tuple[str, ...] = (), within: tuple[str, ...] = ()) -> DataFrame:
    """neigh with the neighbor's length nlen and level nlvl, which follow from its id without a join, and columns of the neighbor (as n_<name>), which need one."""
    level = mapping.level_of(grid.meta, F.col("nbr"))
    neigh = neigh.withColumns({"nlvl": level, "nlen": mapping.length_in_indices(grid.meta, level)})
    if columns:
        other = small(grid.cells.select(F.col("cell").alias("nbr"), *within, *[F.col(c).alias(f"n_{c}") for c in columns]), grid.leaves)
        neigh = neigh.join(other, ["nbr", *within])
    return neigh


def face_neighbors(grid: Grid, keep: tuple[str, ...] = ()) -> DataFrame:
    """cell, nbr, direction (+1, -1 in x, 2 in y, 3 in z), ox.. of the leaves that share a face: one or four on a side."""
    faces = [(0, 0, -1), (0, -1, 0), (-1, 0, 0), (1, 0, 0), (0, 1, 0), (0, 0, 1)]
    near = neighbors_of(_face_grid(grid, faces), "faces", keep=(*keep, "len"))
    near = with_places(grid, near)
    offsets = [F.col("ox"), F.col("oy"), F.col("oz")]
    over = [(o > -F.col("nlen")) & (o < F.col("len")) for o in offsets]
    direction = F.coalesce(*[F.when(o == F.col("len"), k + 1).when(o == -F.col("nlen"), -(k + 1)) for k, o in enumerate(offsets)])
    near = near.withColumn("direction", direction.cast("int")).filter((sum((c.cast("int") for c in over), F.lit(0)) == 2) & F.col("direction").isNotNull())
    return near.drop("ord").distinct() if not grid.uniform else near.drop("ord")


def _face_grid(grid: Grid, faces) -> Grid:
    # faces are in every default neighborhood
    return Grid(grid.meta, grid.cells, {"faces": tuple(faces)}, leaves=grid.leaves, uniform=grid.uniform)


def face_cache(grid: Grid) -> DataFrame:
    """cell and its six face neighbors x_neg, x_pos, y_neg, y_pos, z_neg, z_pos: where four smaller ones are, that nearest the origin; 0 outside."""
    near = face_neighbors(grid)
    ix, iy, iz = mapping.indices_of(grid.meta, F.col("nbr"))
    first = F.struct(iz, iy, ix, F.col("nbr").alias("nbr"))
    sides = {"x_neg": -1, "x_pos": 1, "y_neg": -2, "y_pos": 2, "z_neg": -3, "z_pos": 3}
    best = near.groupBy("cell").agg(*[F.min(F.when(F.col("direction") == d, first))["nbr"].alias(n) for n, d in sides.items()])
    return grid.cells.select("cell").join(best, "cell", "left").select("cell", *[F.coalesce(n, F.lit(0).cast("long")).alias(n) for n in sides])


def neighbors_at_offset(grid: Grid, x: int, y: int, z: int, hood=DEFAULT) -> DataFrame:
    """cell, nbr: the neighbors whose corner is exactly so many of the cell's lengths away."""
    near = neighbors_of(grid, hood, keep=("len",))
    return near.filter((F.col("ox") == F.col("len") * x) & (F.col("oy") == F.col("len") * y) & (F.col("oz") == F.col("len") * z)).select("cell", "nbr")


def neighbor_table(grid: Grid, hood=DEFAULT) -> DataFrame:
    """Every pair of cells of which one is in the other's neighborhood, with kind only_of, both or only_to, and the grid's neighbor items."""
    of = neighbors_of(grid, hood)
    to = neighbors_to(grid, hood)
    marked = of.join(to.withColumn("is_to", F.lit(True)), ["cell", "nbr"], "full_outer")
    kind = F.when(F.col("ord").isNull(), "only_to").when(F.col("is_to"), "both").otherwise("only_of")
    out = marked.select("cell", "nbr", "ord", *[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("ox", "oy", "oz")], kind.alias("kind"))
    return out.select("*", *[v.alias(k) for k, v in grid.neighbor_items.items()])
