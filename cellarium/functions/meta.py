"""What describes a grid besides its cells: small, immutable, kept on the driver."""

from __future__ import annotations

import json
from dataclasses import dataclass, field, replace

LONG_MAX = 2**63 - 1

#: No cell. Lookups that find nothing give it.
NO_CELL = 0


@dataclass(frozen=True)
class NoGeometry:
    """Unit cubes from the origin."""

    kind = "none"


@dataclass(frozen=True)
class Cartesian:
    start: tuple[float, float, float] = (0.0, 0.0, 0.0)
    level0_length: tuple[float, float, float] = (1.0, 1.0, 1.0)
    kind = "cartesian"

    def __post_init__(self):
        if len(self.start) != 3 or len(self.level0_length) != 3 or not all(x > 0 for x in self.level0_length):
            raise ValueError("a Cartesian geometry needs a start and three positive lengths of cells of level 0")


@dataclass(frozen=True)
class Stretched:
    """edges: for each dimension the coordinates of the edges of cells of level 0, ascending, one more than cells."""

    edges: tuple[tuple[float, ...], tuple[float, ...], tuple[float, ...]] = ((0.0, 1.0), (0.0, 1.0), (0.0, 1.0))
    kind = "stretched"

    def __post_init__(self):
        if len(self.edges) != 3 or any(len(e) < 2 or any(b <= a for a, b in zip(e, e[1:])) for e in self.edges):
            raise ValueError("edges must ascend strictly in three dimensions")

    @staticmethod
    def of(cartesian: Cartesian, length: tuple[int, int, int]) -> Stretched:
        """The same cells as a Cartesian geometry's."""
        return Stretched(tuple(tuple(s + i * d for i in range(n + 1)) for s, d, n in zip(cartesian.start, cartesian.level0_length, length)))


@dataclass(frozen=True)
class GridMeta:
    """length: cells of level 0 in each dimension. max_level: -1 for the largest whose ids fit 63 bits. hood: 0 for the six faces, n for all of the (2n+1)^3 - 1 offsets around a cell."""

    length: tuple[int, int, int]
    max_level: int = 0
    periodic: tuple[bool, bool, bool] = (False, False, False)
    hood: int = 1
    geometry: NoGeometry | Cartesian | Stretched = field(default_factory=NoGeometry)

    def __post_init__(self):
        if len(self.length) != 3 or any(int(n) != n or n <= 0 for n in self.length):
            raise ValueError("a grid has at least one cell of level 0 in each dimension")
        if self.hood < 0:
            raise ValueError("a neighborhood's length is at least 0")
        if isinstance(self.geometry, Stretched) and any(len(e) != n + 1 for e, n in zip(self.geometry.edges, self.length)):
            raise ValueError("a stretched geometry has one edge more than cells in each dimension")
        if self.max_level < 0:
            object.__setattr__(self, "max_level", self.max_possible_level)
        if self.max_level > self.max_possible_level:
            raise ValueError(f"ids of level {self.max_level} don't fit 63 bits; the largest level is {self.max_possible_level}")

    @property
    def level0_cells(self) -> int:
        x, y, z = self.length
        return x * y * z

    @property
    def max_possible_level(self) -> int:
        level = -1
        while self.cells_before(level + 2) <= LONG_MAX:
            level += 1
        if level < 0:
            raise ValueError("the cells of level 0 don't fit 63 bits")
        return level

    def cells_before(self, level: int) -> int:
        """Number of possible cells of smaller levels: the last id below those of `level`."""
        return self.level0_cells * (8**level - 1) // 7

    @property
    def last_cell(self) -> int:
        return self.cells_before(self.max_level + 1)

    @property
    def extent(self) -> tuple[int, int, int]:
        """Indices in each dimension: smallest possible cells."""
        return tuple(n << self.max_level for n in self.length)

    @property
    def start(self) -> tuple[float, float, float]:
        g = self.geometry
        return tuple(e[0] for e in g.edges) if isinstance(g, Stretched) else g.start if isinstance(g, Cartesian) else (0.0, 0.0, 0.0)

    @property
    def end(self) -> tuple[float, float, float]:
        g = self.geometry
        if isinstance(g, Stretched):
            return tuple(e[-1] for e in g.edges)
        one = g.level0_length if isinstance(g, Cartesian) else (1.0, 1.0, 1.0)
        return tuple(s + n * d for s, n, d in zip(self.start, self.length, one))

    def stretched_again(self) -> GridMeta:
        """The same grid with the edges of a stretched geometry set back to unit cubes from the origin; it stays stretched."""
        return replace(self, geometry=Stretched(tuple(tuple(float(i) for i in range(n + 1)) for n in self.length)))

    def reset_geometry(self) -> GridMeta:
        """The same grid with unit cubes from the origin."""
        return replace(self, geometry=NoGeometry())

    def with_(self, **changes) -> GridMeta:
        return replace(self, **changes)

    def to_json(self) -> str:
        g = self.geometry
        kind = {"kind": g.kind} | ({"start": g.start, "level0_length": g.level0_length} if isinstance(g, Cartesian) else {"edges": g.edges} if isinstance(g, Stretched) else {})
        return json.dumps({"length": self.length, "max_level": self.max_level, "periodic": self.periodic, "hood": self.hood, "geometry": kind})

    @staticmethod
    def from_json(text: str) -> GridMeta:
        d = json.loads(text)
        g = d["geometry"]
        geometry = Cartesian(tuple(g["start"]), tuple(g["level0_length"])) if g["kind"] == "cartesian" else Stretched(tuple(map(tuple, g["edges"]))) if g["kind"] == "stretched" else NoGeometry()
        return GridMeta(tuple(d["length"]), d["max_level"], tuple(d["periodic"]), d["hood"], geometry)


def hood_offsets(n: int) -> list[tuple[int, int, int]]:
    """The default neighborhood: x fastest, then y, z; for 0 the faces -z, -y, -x, +x, +y, +z."""
    if n == 0:
        return [(0, 0, -1), (0, -1, 0), (-1, 0, 0), (1, 0, 0), (0, 1, 0), (0, 0, 1)]
    r = range(-n, n + 1)
    return [(x, y, z) for z in r for y in r for x in r if (x, y, z) != (0, 0, 0)]
