"""Adaptive refinement: requests in, a new grid out.

Order of decisions: vetoes against refining spread to finer neighbors, the cells they reach are not refined;
coarser neighbors of refined cells are refined too, until none is left (neighboring levels then differ by one
at most); merges are dropped where they would break that, where a sibling is refined, or where one is
vetoed. The spreading loops take at most as many rounds as there are levels; each is one join of a frontier with the
neighbor pairs that cross levels, so the loops never read the pairs of equal level.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import mapping
from ..plans.grid import CORE, Grid
from ..plans.shared import SMALL_ROWS, settle, small
from .lookup import existing_at_point
from .neighbors import neighbors_of, probes, with_places

_INDEX = ("ix", "iy", "iz")


@dataclass(frozen=True)
class Adapted:
    grid: Grid
    #: Ids of cells that were made by refining.
    new: DataFrame
    #: Ids of cells that were merged away.
    removed: DataFrame
    #: Former rows of cells that were refined or merged away.
    refined_data: DataFrame
    unrefined_data: DataFrame
    #: The new grid's neighbor pairs of different levels, if the old ones were given.
    pairs: DataFrame | None = None


def _ids(grid: Grid, ids: DataFrame | list[int] | None) -> DataFrame:
    spark = grid.cells.sparkSession
    if ids is None:
        ids = []
    if isinstance(ids, (list, tuple, set)):
        return spark.createDataFrame([(int(i),) for i in ids], "cell long")
    return ids.select(F.col("cell").cast("long").alias("cell"))


def level_pairs(grid: Grid) -> DataFrame:
    """coarse, fine: neighbors (either way) of different levels."""
    near = with_places(grid, neighbors_of(grid, keep=("lvl",))).filter("lvl <> nlvl")
    finer = F.col("nlvl") > F.col("lvl")
    return near.select(F.when(finer, F.col("cell")).otherwise(F.col("nbr")).alias("coarse"), F.when(finer, F.col("nbr")).otherwise(F.col("cell")).alias("fine")).distinct()


def level_pairs_of(grid: Grid, cells: DataFrame) -> DataFrame:
    """Those of level_pairs that some of the grid's leaves (rows of it) are part of: what is in their neighborhoods, and coarser leaves that have them in theirs, which lie around their parents. Finer ones that have a leaf in theirs are in its own."""
    meta = grid.meta
    near = with_places(grid, neighbors_of(grid, cells=cells, keep=("lvl",))).filter("lvl <> nlvl")
    finer = F.col("nlvl") > F.col("lvl")
    of = near.select(F.when(finer, F.col("cell")).otherwise(F.col("nbr")).alias("coarse"), F.when(finer, F.col("nbr")).otherwise(F.col("cell")).alias("fine"))
    twice = F.col("len") * 2
    parents = cells.filter("lvl > 0").select("cell", (F.col("lvl") - 1).alias("lvl"), *[(F.col(c) - F.col(c) % twice).alias(c) for c in _INDEX], twice.alias("len"))
    around = probes(grid, parents, grid.offsets()).select(mapping.cell_inside(meta, (F.col("wx"), F.col("wy"), F.col("wz")), F.col("lvl")).alias("coarse"), F.col("cell").alias("fine"))
    return of.union(around.join(grid.ids.withColumnRenamed("cell", "coarse"), "coarse", "left_semi")).distinct()


def updated_pairs(pairs: DataFrame, grid: Grid, gone: DataFrame, made: DataFrame) -> DataFrame:
    """The grid's level_pairs from those before an adaptation: without the pairs of cells that are gone, with those of cells that were made. Neighbors of all other cells are not looked at."""
    kept = pairs
    for end in ("coarse", "fine"):
        kept = kept.join(gone.select(F.col("cell").alias(end)), end, "left_anti")
    new = grid.cells.join(made.select("cell"), "cell", "left_semi")
    return kept.select("coarse", "fine").union(level_pairs_of(grid, new))


def _spread(start: DataFrame, pairs: DataFrame, source: str, target: str, rounds: int) -> DataFrame:
    """start and all that pairs lead to from it."""
    reached = frontier = settle(start.distinct())
    for _ in range(rounds):
        frontier = settle(pairs.join(frontier.withColumnRenamed("cell", source), source).select(F.col(target).alias("cell")).distinct().join(reached, "cell", "left_anti"))
        if not frontier.limit(1).count():
            break
        reached = reached.union(frontier)
    return reached


def blocked_boxes(grid: Grid, refined: DataFrame | None) -> DataFrame:
    """Cells that hold leaves too fine for a merged neighbor of the same size: more than one level finer, or one level finer and about to be refined."""
    meta = grid.meta
    index = tuple(F.col(c) for c in _INDEX)
    ups = F.array(*[F.when(F.col("lvl") >= k + 2, mapping.ancestor(meta, index, k)) for k in range(max(0, meta.max_level - 1))] or [F.lit(None).cast("long")])
    deep = grid.cells.filter("lvl >= 2").select(F.explode(ups).alias("box")).filter("box is not null")
    if refined is None:
        return deep.distinct()
    near = refined.filter("lvl >= 1").select(mapping.ancestor(meta, index, F.greatest(F.col("lvl") - 1, F.lit(0))).alias("box"))
    return deep.union(near).distinct()


def _asked(grid: Grid, ids: DataFrame | list[int] | None) -> DataFrame | None:
    """Distinct requested ids, counted and marked for broadcast if they are few; None if there are none."""
    if ids is None:
        return None
    found = settle(_ids(grid, ids).filter("cell is not null").distinct())
    n = found.count()
    return small(found, n) if n else None


def _merged(grid: Grid, refined: DataFrame | None, unrefine: DataFrame, against: list[DataFrame]) -> DataFrame:
    """Rows of the cells that merge, with their parent as group. One request for any sibling is enough."""
    meta, cells = grid.meta, grid.cells

    def group(ids: DataFrame) -> DataFrame:
        placed = mapping.with_place(ids.select("cell"), meta).filter("lvl > 0")
        return placed.select(mapping.ancestor(meta, tuple(F.col(c) for c in _INDEX), F.greatest(F.col("lvl") - 1, F.lit(0))).alias("group")).distinct()

    groups = group(cells.join(unrefine, "cell", "left_semi").select("cell"))
    for ids in against:
        groups = groups.join(group(ids), "group", "left_anti")
    members = cells.filter("lvl > 0").withColumn("group", mapping.parent_at(meta, F.col("cell"), F.col("lvl"), tuple(F.col(c) for c in _INDEX))).join(groups, "group")
    whole = settle(members.groupBy("group").agg(F.count(F.lit(1)).alias("n")).filter("n = 8").select("group"))
    boxes = mapping.with_place(whole.withColumnRenamed("group", "cell"), meta)
    around = probes(grid, boxes, grid.offsets()).select("cell", mapping.cell_inside(meta, (F.col("wx"), F.col("wy"), F.col("wz")), F.col("lvl")).alias("box"))
    stopped = around.join(blocked_boxes(grid, refined), "box", "left_semi").select(F.col("cell").alias("group")).distinct()
    return settle(members.join(whole.join(stopped, "group", "left_anti"), "group", "left_semi"))


def adapt(
    grid: Grid,
    refine: DataFrame | list[int] | None = None,
    unrefine: DataFrame | list[int] | None = None,
    dont_refine: DataFrame | list[int] | None = None,
    dont_unrefine: DataFrame | list[int] | None = None,
    prolong: dict[str, Column] | None = None,
    restrict: dict[str, Column] | None = None,
    pairs: DataFrame | None = None,
) -> Adapted:
    """prolong: values of new cells as expressions over their parent's row (default: the parent's). restrict: values of merged cells as aggregates over their children's rows (default: null). Children inherit owner, pin and weight; a merged cell gets the owner of its first child and loses pin and weight. Requests for cells that don't exist are passed over; refining at the largest level counts as a veto against merging. What nobody asks for is not planned. pairs: the grid's level_pairs if they are at hand, as the result of an earlier adaptation has them; they are kept up to date then."""
    meta = grid.meta
    user = [c for c in grid.cells.columns if c not in CORE]
    cells = grid.cells
    none = cells.limit(0)
    ask = {n: _asked(grid, ids) for n, ids in (("unrefine", unrefine), ("dont_refine", dont_refine), ("dont_unrefine", dont_unrefine))} if meta.max_level else {"unrefine": None}
    if not meta.max_level or refine is None and (ask["unrefine"] is None or grid.uniform):
        return Adapted(grid, none.select("cell"), none.select("cell"), none, none, pairs)
    refined = at_limit = None
    if refine is not None:
        wanted = cells.join(_ids(grid, refine).distinct(), "cell", "left_semi").select("cell", "lvl")
        at_limit = wanted.filter(F.col("lvl") == meta.max_level).select("cell")
        wanted = wanted.filter(F.col("lvl") < meta.max_level).select("cell")
        veto = ask["dont_refine"]
        if grid.uniform:
            chosen = wanted if veto is None else wanted.join(veto, "cell", "left_anti")
        else:
            across = settle(level_pairs(grid)) if pairs is None else pairs
            if veto is not None:
                wanted = wanted.join(_spread(cells.join(veto, "cell", "left_semi").select("cell"), across, "coarse", "fine", meta.max_level), "cell", "left_anti")
            chosen = _spread(wanted, across, "fine", "coarse", meta.max_level)
        chosen = settle(chosen)
        n = chosen.count()
        chosen = small(chosen, n)
        refined = cells.join(chosen, "cell", "left_semi")
    gone = None
    if ask["unrefine"] is not None and not grid.uniform:
        gone = _merged(grid, refined, ask["unrefine"], [x for x in (None if refined is None else chosen, at_limit, ask["dont_unrefine"]) if x is not None])

    kept, made = cells, []
    born = none.select("cell")
    if refined is not None:
        # the first child stands at the corner of its parent, so only the level changes
        first = mapping.cell_inside(meta, tuple(F.col(c) for c in _INDEX), F.col("lvl") + 1)
        half = mapping.div(F.col("len"), 2)
        kids = refined.withColumns({"__first": first, "__half": half}).select("*", F.posexplode(F.array(*mapping.children_inside(meta, F.col("__first"), F.col("lvl")))).alias("__k", "__kid"))
        values = {c: (prolong or {}).get(c, F.col(c)) for c in user}
        at = [(F.col(c) + F.when(F.col("__k").bitwiseAND(F.lit(1 << d)) > 0, F.col("__half")).otherwise(0)).alias(c) for d, c in enumerate(_INDEX)]
        made.append(kids.select(F.col("__kid").alias("cell"), (F.col("lvl") + 1).alias("lvl"), *at, F.col("__half").alias("len"), "part", "weight", "pin", *[v.alias(c) for c, v in values.items()]))
        born = refined.select(F.explode(F.array(*mapping.children_inside(meta, first, F.col("lvl")))).alias("cell"))
        kept = kept.join(chosen, "cell", "left_anti")
    if gone is not None:
        up = gone.groupBy("group").agg(F.min_by("part", "cell").alias("part"), *[(restrict or {}).get(c, F.lit(None).cast(dict(cells.dtypes)[c])).alias(c) for c in user])
        up = up.select(F.col("group").alias("cell"), "part", F.lit(1.0).alias("weight"), F.lit(None).cast("int").alias("pin"), *user)
        made.append(Grid.of(meta, up).cells)
        kept = kept.join(gone.select("cell"), "cell", "left_anti")
    after = kept
    for rows in made:
        after = after.unionByName(rows)
    after = settle(after)
    leaves = grid.leaves + 7 * n if grid.leaves is not None and refined is not None and gone is None else after.count()
    new = Grid(meta, after, grid.hoods, grid.cell_items, grid.neighbor_items, leaves)
    if pairs is not None:
        changed = [(refined, born)] if refined is not None else []
        if gone is not None:
            changed.append((gone, up))
        lost, made_ids = (reduce(DataFrame.union, [x[k].select("cell") for x in changed]) for k in (0, 1))
        few = refined is not None and gone is None and n <= SMALL_ROWS // 8
        lost, made_ids = (F.broadcast(lost), F.broadcast(made_ids)) if few else (lost, made_ids)
        pairs = settle(updated_pairs(pairs, new, lost, made_ids))
    return Adapted(new, born, none.select("cell") if gone is None else gone.select("cell"), none if refined is None else refined, none if gone is None else gone.drop("group"), pairs)


def requests_at(grid: Grid, points: DataFrame, x: str = "x", y: str = "y", z: str = "z") -> DataFrame:
    """cell: the existing cells around points, each once, to refine, merge or keep them; points outside the grid are passed over."""
    return existing_at_point(grid, points.select(x, y, z), x, y, z).filter("cell <> 0").select("cell").distinct()


def load_cells(grid: Grid, wanted: DataFrame | list[int]) -> Grid:
    """From a grid of level 0, refine until the listed cells exist. Ids that are no cell's are passed over."""
    meta = grid.meta
    ids = settle(mapping.with_place(_ids(grid, wanted), meta).filter("lvl >= 0"))
    pairs = grid.cells.sparkSession.createDataFrame([], "coarse long, fine long") if grid.uniform else None
    for k in range(ids.agg(F.max("lvl")).first()[0] or 0):
        ups = ids.filter(F.col("lvl") > k).select(mapping.ancestor(meta, (F.col("ix"), F.col("iy"), F.col("iz")), k).alias("cell")).distinct()
        done = adapt(grid, refine=ups, pairs=pairs)
        grid, pairs = done.grid, done.pairs
    return grid


def adaptation_requests(grid: Grid, differences: DataFrame, increase: float, sensitivity: float) -> dict[str, DataFrame]:
    """Requests by the largest relative difference of a cell (cell, max_diff): above (level + 1) * increase it is refined, below sensitivity times that its group is merged, between it keeps its group."""
    with_level = grid.cells.select("cell", "lvl").join(differences, "cell")
    limit = (F.col("lvl") + 1) * increase
    return {
        "refine": with_level.filter(F.col("max_diff") > limit).select("cell"),
        "dont_unrefine": with_level.filter((F.col("max_diff") <= limit) & (F.col("max_diff") >= limit * sensitivity) & (F.col("lvl") > 0)).select("cell"),
        "unrefine": with_level.filter((F.col("max_diff") < limit * sensitivity) & (F.col("lvl") > 0)).select("cell"),
    }
