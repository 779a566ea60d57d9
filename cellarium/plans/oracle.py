"""SQL text for cell arithmetic and small grids, to hold plans against another engine. Neighbors are stated here by overlap of boxes, not by computed ids as in the plans."""

from __future__ import annotations

from ..functions.meta import GridMeta, hood_offsets


def level(m: GridMeta, c: str) -> str:
    whens = " ".join(f"WHEN {c} <= {m.cells_before(k + 1)} THEN {k}" for k in range(m.max_level + 1))
    return f"(CASE WHEN {c} IS NULL OR {c} < 1 OR {c} > {m.last_cell} THEN -1 {whens} END)"


def _before(m: GridMeta, lvl: str) -> str:
    return f"(CAST({[m.cells_before(k) for k in range(m.max_level + 1)]} AS BIGINT[])[{lvl} + 1])"


def _pow2(lvl: str) -> str:
    return f"(CAST(1 AS BIGINT) << CAST({lvl} AS INTEGER))"


def index(m: GridMeta, c: str, lvl: str) -> tuple[str, str, str]:
    x, y, _ = m.length
    rest, wide, deep, step = f"({c} - 1 - {_before(m, lvl)})", f"({x} * {_pow2(lvl)})", f"({y} * {_pow2(lvl)})", _pow2(f"({m.max_level} - {lvl})")
    return f"(({rest} % {wide}) * {step})", f"((({rest} // {wide}) % {deep}) * {step})", f"(({rest} // ({wide} * {deep})) * {step})"


def length(m: GridMeta, lvl: str) -> str:
    return _pow2(f"({m.max_level} - {lvl})")


def cell(m: GridMeta, i: tuple[str, str, str], lvl: str) -> str:
    x, y, _ = m.length
    inside = " AND ".join([f"{lvl} BETWEEN 0 AND {m.max_level}", *[f"{c} >= 0 AND {c} < {n}" for c, n in zip(i, m.extent)]])
    step, wide = _pow2(f"({m.max_level} - {lvl})"), f"({x} * {_pow2(lvl)})"
    a, b, c = (f"({v} // {step})" for v in i)
    return f"(CASE WHEN {inside} THEN 1 + {_before(m, lvl)} + {a} + {b} * {wide} + {c} * {wide} * {y} * {_pow2(lvl)} ELSE 0 END)"


def placed(m: GridMeta, ids: str, extra: str = "") -> str:
    """SELECT of cell, lvl, ix, iy, iz, len from a SELECT of cell (and extra columns)."""
    x, y, z = index(m, "cell", "lvl")
    return f"SELECT cell, lvl, {x} AS ix, {y} AS iy, {z} AS iz, {length(m, 'lvl')} AS len{extra} FROM (SELECT *, {level(m, 'cell')} AS lvl FROM ({ids}) __i) __l"


def children(m: GridMeta, source: str) -> str:
    """SELECT of cell (a child), k and parent, from a SELECT of cell of levels below the largest."""
    half = _pow2(f"({m.max_level} - lvl - 1)")
    at = (f"(ix + k % 2 * {half})", f"(iy + k // 2 % 2 * {half})", f"(iz + k // 4 * {half})")
    return f"SELECT {cell(m, at, '(lvl + 1)')} AS cell, k, cell AS parent FROM ({placed(m, source)}) __p CROSS JOIN (SELECT range AS k FROM range(8)) __k"


def ancestor(m: GridMeta, c: str, lvl: str) -> str:
    return cell(m, index(m, c, level(m, c)), lvl)


def near(m: GridMeta, leaf: str = "leaf", offsets=None) -> str:
    """SELECT of cell, ord, nbr, ox, oy, oz over a table of leaves with places."""
    offsets = hood_offsets(m.hood) if offsets is None else offsets
    values = ", ".join(f"({i}, {x}, {y}, {z})" for i, (x, y, z) in enumerate(offsets))
    wrapped, inside, meet, away = [], [], [], []
    for a, n, around in zip("xyz", m.extent, m.periodic):
        t = f"(i{a} + h{a} * len)"
        wrapped.append(f"(({t} % {n} + {n}) % {n}) AS w{a}" if around else f"{t} AS w{a}")
        if not around:
            inside.append(f"{t} >= 0 AND {t} < {n}")
        meet.append(f"n.i{a} < b.w{a} + b.len AND n.i{a} + n.len > b.w{a}")
        away.append(f"b.h{a} * b.len + n.i{a} - b.w{a} AS o{a}")
    where = "WHERE " + " AND ".join(inside) if inside else ""
    boxes = f"SELECT cell, len, ord, hx, hy, hz, {', '.join(wrapped)} FROM {leaf} CROSS JOIN (VALUES {values}) h(ord, hx, hy, hz) {where}"
    return f"SELECT b.cell, b.ord, n.cell AS nbr, {', '.join(away)} FROM ({boxes}) b JOIN {leaf} n ON {' AND '.join(meet)}"


def center(m: GridMeta, i: tuple[str, str, str], lvl: str) -> tuple[str, str, str]:
    """For a Cartesian geometry with lengths that are powers of two."""
    g, out = m.geometry, []
    for c, s, d in zip(i, g.start, g.level0_length):
        out.append(f"(({s!r}::DOUBLE + {c} * ({d / (1 << m.max_level)!r}::DOUBLE)) + ({d!r}::DOUBLE / {_pow2(lvl)}) / 2)")
    return tuple(out)
