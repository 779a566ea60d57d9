"""Simulations on grids as loops of plans: cellular automaton, advection, Poisson equation, particles. A loop keeps its state in a checkpointed DataFrame and collects single rows only."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry, mapping
from ..functions.meta import GridMeta
from ..plans.grid import DEFAULT, Grid
from ..plans.shared import settle
from .adapt import Adapted, adapt, adaptation_requests
from .lookup import existing_at_point
from .neighbors import face_neighbors, with_places
from .stencil import face_stencil, level0_stencil, max_difference, stencil

# --- life ----------------------------------------------------------------------------------------------------------


def born_or_kept(alive: Column, around: Column) -> Column:
    """Three neighbors: alive; two: as before; else dead."""
    return F.when(around == 3, F.lit(1)).when(around == 2, alive).otherwise(F.lit(0)).cast("int")


def life_step(grid: Grid, alive: str = "alive", hood=DEFAULT) -> Grid:
    counts = stencil(grid, {"__around": F.sum(f"n_{alive}")}, (alive,), hood)
    cells = grid.cells.join(counts, "cell", "left").withColumn(alive, born_or_kept(F.col(alive), F.coalesce("__around", F.lit(0)))).drop("__around")
    return grid.with_cells(cells)


def life_step_refined(grid: Grid, alive: str = "alive", hood=DEFAULT) -> Grid:
    """A step on a refined grid that gives each leaf what its ancestor of level 0 gets on the unrefined one."""
    counts = level0_stencil(grid, {"__around": F.sum(f"n_{alive}")}, (alive,), hood)
    cells = grid.cells.withColumn("l0", mapping.level0_parent(grid.meta, F.col("cell"))).join(counts, "l0", "left")
    return grid.with_cells(cells.withColumn(alive, born_or_kept(F.col(alive), F.coalesce("__around", F.lit(0)))).drop("l0", "__around"))


def life(grid: Grid, steps: int, refined: bool = False) -> Grid:
    for _ in range(steps):
        grid = (life_step_refined if refined else life_step)(grid).settled()
    return grid


# --- advection -----------------------------------------------------------------------------------------------------


def advection_start(grid: Grid) -> Grid:
    """A smooth hump of radius 0.15 around (0.25, 0.5) in a rotating flow."""
    x, y, _ = geometry.center(grid.meta, F.col("cell"))
    lengths = geometry.length(grid.meta, F.col("cell"))
    r = F.least(F.sqrt(F.pow(x - 0.25, F.lit(2.0)) + F.pow(y - 0.5, F.lit(2.0))), F.lit(0.15)) / 0.15
    return grid.with_columns({"density": 0.25 * (1 + F.cos(math.pi * r)), "vx": 0.5 - y, "vy": x - 0.5, "vz": F.lit(0.0), **{n: v for n, v in zip(("length_x", "length_y", "length_z"), lengths)}})


def fluxes(grid: Grid, dt: float) -> DataFrame:
    """cell, flux: first-order upwind change of density in dt. Each face is looked at from both of its cells."""
    lengths = ("length_x", "length_y", "length_z")
    read = ("density", "vx", "vy", "vz", *lengths)
    side = F.abs("direction")

    def at_face(v: str, d: str) -> Column:  # velocity interpolated to the shared face
        return (F.col(d) * F.col(f"n_{v}") + F.col(f"n_{d}") * F.col(v)) / (F.col(d) + F.col(f"n_{d}"))

    def area(a: str, b: str) -> Column:
        return F.least(F.col(a) * F.col(b), F.col(f"n_{a}") * F.col(f"n_{b}"))

    v = F.when(side == 1, at_face("vx", "length_x")).when(side == 2, at_face("vy", "length_y")).otherwise(at_face("vz", "length_z"))
    shared = F.when(side == 1, area("length_y", "length_z")).when(side == 2, area("length_x", "length_z")).otherwise(area("length_x", "length_y"))
    out = F.col("direction") > 0
    from_here = (v >= 0) == out
    amount = F.when(from_here, F.col("density")).otherwise(F.col("n_density")) * dt * v * shared
    volume = F.col("length_x") * F.col("length_y") * F.col("length_z")
    return face_stencil(grid, {"flux": F.sum(F.when(out, -amount).otherwise(amount) / volume)}, read, read)


def advection_step(grid: Grid, dt: float) -> Grid:
    cells = grid.cells.join(fluxes(grid, dt), "cell", "left").withColumn("density", F.col("density") + F.coalesce("flux", F.lit(0.0))).drop("flux")
    return grid.with_cells(cells)


def max_time_step(grid: Grid) -> DataFrame:
    """dt: the least length / |velocity| that is an ordinary number."""
    steps = [F.when((F.abs(v) > 0) & (F.col(d) / F.abs(v) < float("inf")), F.col(d) / F.abs(v)) for v, d in (("vx", "length_x"), ("vy", "length_y"), ("vz", "length_z"))]
    return grid.cells.agg(F.min(F.least(*steps)).alias("dt"))


def advection_adapt(grid: Grid, increase: float, threshold: float, sensitivity: float) -> Adapted:
    """Refine and merge by relative differences of density; children take their parent's density, parents their children's mean."""
    asked = adaptation_requests(grid, max_difference(grid, "density", threshold), increase, sensitivity)
    columns = {c: F.first(c) for c in grid.cells.columns if c in ("vx", "vy", "vz", "length_x", "length_y", "length_z")}
    done = adapt(grid, **asked, restrict={"density": F.sum("density") / 8, **columns})
    keep = done.grid.cells.withColumn("__d", F.col("density"))
    fresh = advection_start(done.grid.with_cells(keep)).cells.withColumn("density", F.col("__d")).drop("__d")
    return Adapted(done.grid.with_cells(settle(fresh)), done.new, done.removed, done.refined_data, done.unrefined_data)


def advection(grid: Grid, until: float, cfl: float = 0.5, adapt_every: int = 0, increase: float = 0.02, threshold: float = 0.25, sensitivity: float = 0.5) -> Grid:
    """The clock advances by the largest allowed step while fluxes use cfl times it."""
    grid, time, turn = grid.settled(), 0.0, 0
    while time < until:
        dt = max_time_step(grid).first()[0]
        if dt is None:
            break
        grid = advection_step(grid, cfl * dt).settled()
        turn += 1
        if adapt_every and turn % adapt_every == 0 and grid.meta.max_level:
            grid = advection_adapt(grid, increase, threshold, sensitivity).grid
        time += dt
    return grid


# --- Poisson -------------------------------------------------------------------------------------------------------

SOLVE, BOUNDARY, SKIP = "solve", "boundary", "skip"


@dataclass(frozen=True)
class System:
    """cells: cell, kind, rhs, solution, scaling. links: cell, nbr, forward (multiplier of the neighbor in A), backward (in A transposed)."""

    grid: Grid
    cells: DataFrame
    links: DataFrame


def poisson_system(grid: Grid, solve: DataFrame | None = None, skip: DataFrame | None = None) -> System:
    """grid has rhs and solution. Cells neither solved nor skipped are boundaries, whose solution is given. Skipped cells, and pairs of boundaries, are not linked. A face of four smaller neighbors counts each with a quarter."""
    kind = F.lit(SOLVE) if solve is None else F.when(F.col("__solve"), SOLVE).when(F.coalesce("__skip", F.lit(False)), SKIP).otherwise(BOUNDARY)
    cells = grid.cells
    if solve is not None:
        cells = cells.join(solve.select("cell", F.lit(True).alias("__solve")), "cell", "left")
        none = cells.sparkSession.createDataFrame([], "cell long")
        cells = cells.join((none if skip is None else skip).select("cell", F.lit(True).alias("__skip")), "cell", "left")
    lengths = geometry.length(grid.meta, F.col("cell"))
    cells = cells.withColumn("kind", kind).withColumns({f"d{k}": v for k, v in zip((1, 2, 3), lengths)})
    held = grid.with_cells(settle(cells.select(*[c for c in cells.columns if not c.startswith("__")])))
    faces = with_places(held, face_neighbors(held, keep=("kind", "lvl", "d1", "d2", "d3")), ("kind", "d1", "d2", "d3"))
    faces = faces.filter((F.col("kind") != SKIP) & (F.col("n_kind") != SKIP) & ~((F.col("kind") == BOUNDARY) & (F.col("n_kind") == BOUNDARY)))
    side = F.abs("direction")
    own = F.when(side == 1, F.col("d1")).when(side == 2, F.col("d2")).otherwise(F.col("d3"))
    other = F.when(side == 1, F.col("n_d1")).when(side == 2, F.col("n_d2")).otherwise(F.col("n_d3"))
    faces = faces.withColumns({"own": own, "away": (own + other) / 2})
    # what stands on one side of a cell in one direction, and on the other; nothing there counts as a cell of its own size
    sides = faces.groupBy("cell", "direction").agg(F.max("away").alias("away"), F.max("own").alias("own"))
    opposite = sides.select("cell", (-F.col("direction")).alias("direction"), F.col("away").alias("back"))
    factor = sides.join(opposite, ["cell", "direction"], "left").select("cell", "direction", (2 / (F.col("away") * (F.col("away") + F.coalesce("back", "own")))).alias("factor"))
    factor = settle(factor)
    scaling = factor.groupBy("cell").agg((-F.sum("factor")).alias("scaling"))
    quarter = lambda c: F.when(c, F.lit(0.25)).otherwise(F.lit(1.0))
    links = faces.select("cell", "nbr", "direction", (F.col("nlvl") > F.col("lvl")).alias("finer"), "n_kind")
    there = factor.select(F.col("cell").alias("nbr"), (-F.col("direction")).alias("direction"), F.col("factor").alias("n_factor"))
    links = links.join(factor, ["cell", "direction"]).join(there, ["nbr", "direction"])
    links = settle(links.select("cell", "nbr", (F.col("factor") * quarter(F.col("finer"))).alias("forward"), (F.col("n_factor") * quarter(F.col("finer"))).alias("backward")))
    state = held.cells.join(scaling, "cell").select("cell", "kind", "rhs", "solution", "scaling")
    return System(held, settle(state), links)


def apply_matrix(system: System, state: DataFrame, value: str, factor: str, name: str) -> DataFrame:
    """cell, name: scaling * value + sum of factor * the neighbors' value."""
    there = state.select(F.col("cell").alias("nbr"), F.col(value).alias("__there"))
    sums = system.links.join(there, "nbr").groupBy("cell").agg(F.sum(F.col(factor) * F.col("__there")).alias("__sum"))
    return state.join(sums, "cell", "left").select("cell", (F.col("scaling") * F.col(value) + F.coalesce("__sum", F.lit(0.0))).alias(name))


def _dot(state: DataFrame, a: str, b: str) -> float:
    return state.filter(F.col("kind") == SOLVE).agg(F.sum(F.col(a) * F.col(b))).first()[0] or 0.0


def poisson_solve(system: System, max_iterations: int = 1000, min_iterations: int = 0, stop_residual: float = 1e-15, p: float = 2.0, stop_after_increase: float = 10.0) -> tuple[DataFrame, float, int]:
    """Biconjugate gradients: cell, solution (the best met), its residual and the iterations made. Boundary values stay."""
    solve = F.col("kind") == SOLVE
    ax = apply_matrix(system, system.cells, "solution", "forward", "ax")
    r = F.when(solve, F.col("rhs") - F.col("ax")).otherwise(F.lit(0.0))
    state = system.cells.join(ax, "cell").withColumn("r0", r)
    state = settle(state.withColumns({"r1": F.col("r0"), "p0": F.col("r0"), "p1": F.col("r0"), "best": F.col("solution")}).drop("ax"))
    dot_r, least, turn = _dot(state, "r0", "r1"), math.inf, 0
    while turn < max_iterations:
        turn += 1
        state = settle(state.join(apply_matrix(system, state, "p0", "forward", "ap"), "cell"))
        dot_p = _dot(state, "p1", "ap")
        if dot_p == 0:
            break
        alpha = dot_r / dot_p
        state = state.withColumn("solution", F.when(solve, F.col("solution") + alpha * F.col("p0")).otherwise(F.col("solution")))
        residual = state.filter(solve).agg(F.pow(F.sum(F.pow(F.abs("r0"), F.lit(p))), F.lit(1 / p))).first()[0] or 0.0
        if residual < least:
            least, state = residual, state.withColumn("best", F.col("solution"))
        if turn >= min_iterations and (residual <= stop_residual or residual >= stop_after_increase * least) or dot_r == 0:
            break
        at = apply_matrix(system, state, "p1", "backward", "at")
        state = state.join(at, "cell").withColumns({"r0": F.when(solve, F.col("r0") - alpha * F.col("ap")).otherwise(0.0), "r1": F.when(solve, F.col("r1") - alpha * F.col("at")).otherwise(0.0)})
        state = settle(state.drop("ap", "at"))
        old, dot_r = dot_r, _dot(state, "r0", "r1")
        beta = dot_r / old
        state = state.withColumns({"p0": F.when(solve, F.col("r0") + beta * F.col("p0")).otherwise(0.0), "p1": F.when(solve, F.col("r1") + beta * F.col("p1")).otherwise(0.0)})
    return settle(state.select("cell", F.col("best").alias("solution"))), least, turn


def jacobi_step(system: System, state: DataFrame) -> DataFrame:
    """One sweep: each solved cell takes the value that its equation asks for, given its neighbors'."""
    there = state.select(F.col("cell").alias("nbr"), F.col("solution").alias("__there"))
    sums = system.links.join(there, "nbr").groupBy("cell").agg(F.sum(F.col("forward") * F.col("__there")).alias("__sum"))
    new = (F.col("rhs") - F.coalesce("__sum", F.lit(0.0))) / F.col("scaling")
    return state.join(sums, "cell", "left").withColumns({"before": F.col("solution"), "solution": F.when(F.col("kind") == SOLVE, new).otherwise(F.col("solution"))}).drop("__sum")


def poisson_failsafe(system: System, max_iterations: int = 1000, stop_change: float = 1e-10) -> tuple[DataFrame, float, int]:
    state, change, turn = system.cells, math.inf, 0
    while turn < max_iterations and change > stop_change:
        turn += 1
        state = settle(jacobi_step(system, state))
        change = state.agg(F.sum(F.abs(F.col("solution") - F.col("before")))).first()[0] or 0.0
        state = state.drop("before")
    return state.select("cell", "solution"), change, turn


#: Cells of a line that are summed together, at least.
STRETCH = 1024


def poisson_line(line: DataFrame, dx: float) -> DataFrame:
    """index, solution of a periodic line of cells of length dx, solved directly. line: index (0 to n - 1, each once) and rhs, of which the mean is taken off; the solution is 0 in the last cell.

    The second difference unrolls to dx * dx * (slope * (i + 1) + i * s - t): s and t are the sums of rhs and of index times rhs over the cells before i, slope makes
    the ends meet. Sums are taken by stretches, then within each, so no task holds the line.
    """
    rhs = F.col("rhs").cast("double")
    n, mean, turned = line.agg(F.count(F.lit(1)), F.avg(rhs), F.sum((F.col("index") + 1) * rhs)).first()
    if not n:
        return line.select(F.col("index").cast("long").alias("index"), rhs.alias("solution"))
    slope = (turned - mean * (n * (n + 1) / 2)) / n
    width = max(STRETCH, -(-n // int(line.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    i = F.col("index")
    rows = line.select(i.cast("long").alias("index"), (rhs - mean).alias("f")).withColumns({"g": i * F.col("f"), "__range": F.expr(f"index div {width}")})
    before = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    own = Window.partitionBy("__range").orderBy("index").rowsBetween(Window.unboundedPreceding, -1)
    sums = rows.groupBy("__range").agg(F.sum("f").alias("f"), F.sum("g").alias("g"))
    sums = sums.select("__range", *[F.coalesce(F.sum(c).over(before), F.lit(0.0)).alias(f"{c}0") for c in "fg"])
    s, t = (F.col(f"{c}0") + F.coalesce(F.sum(c).over(own), F.lit(0.0)) for c in "fg")
    solution = F.when(i == n - 1, 0.0).otherwise(dx * dx * (slope * (i + 1) + i * s - t))
    return rows.join(F.broadcast(sums), "__range").select("index", solution.alias("solution"))  # sums: at most a row per shuffle partition


# --- particles -----------------------------------------------------------------------------------------------------


def propagate(grid: Grid, particles: DataFrame, velocity: tuple[float, float, float], dt: float = 1.0) -> DataFrame:
    """particles (x, y, z and other columns) moved, wrapped around periodic dimensions, each in the cell around it; those that leave the grid are dropped."""
    moved = [F.col(c) + v * dt for c, v in zip("xyz", velocity)]
    at = geometry.real_coordinate(grid.meta, tuple(moved))
    out = particles.drop("cell").withColumns({"__" + c: a for c, a in zip("xyz", at)}).drop("x", "y", "z").withColumnsRenamed({"__" + c: c for c in "xyz"})
    return existing_at_point(grid, out).filter("cell <> 0")


def geometry_averages(spark, meta: GridMeta, cells: int) -> DataFrame:
    """Mean length and center of the first `cells` ids: one projection over a range, no shuffle but the last sum."""
    df = mapping.with_place(spark.range(1, cells + 1).withColumnRenamed("id", "cell"), meta)
    index = (F.col("ix"), F.col("iy"), F.col("iz"))
    lengths, centers = geometry.length_at(meta, index, F.col("lvl")), geometry.middle_at(meta, index, F.col("lvl"))
    return df.agg(*[F.avg(v).alias(f"length_{a}") for a, v in zip("xyz", lengths)], *[F.avg(v).alias(f"center_{a}") for a, v in zip("xyz", centers)])
