"""The layout of a binary grid file: a preamble that says what the grid is, the number of cells, a table of (id, offset) and the cells' data."""

from __future__ import annotations

import struct

from ..functions.meta import Cartesian, GridMeta, NoGeometry, Stretched

# fixed values: the layout of the binary file
MAGIC = 0x1234567890ABCDEF
GEOMETRY_ID = {"none": 0, "cartesian": 1, "stretched": 2}


def preamble(meta: GridMeta, header: bytes = b"") -> bytes:
    """Everything before the number of cells: header, endianness, lengths and largest level, neighborhood length, periodicity, geometry."""
    g = meta.geometry
    out = header + struct.pack("<Q3Qi", MAGIC, *meta.length, meta.max_level) + struct.pack("<I3B", meta.hood, *map(int, meta.periodic)) + struct.pack("<i", GEOMETRY_ID[g.kind])
    if isinstance(g, Cartesian):
        out += struct.pack("<6d", *g.start, *g.level0_length)
    elif isinstance(g, Stretched):
        out += struct.pack("<3Q", *map(len, g.edges)) + b"".join(struct.pack(f"<{len(e)}d", *e) for e in g.edges)
    return out


def parse_preamble(data: bytes, at: int = 0) -> tuple[GridMeta, int]:
    magic, x, y, z, level = struct.unpack_from("<Q3Qi", data, at)
    if magic != MAGIC:
        raise ValueError("wrong byte order, or no grid at this offset")
    at += 36
    hood, px, py, pz = struct.unpack_from("<I3B", data, at)
    at += 7
    (kind,) = struct.unpack_from("<i", data, at)
    at += 4
    shape = NoGeometry()
    if kind == GEOMETRY_ID["cartesian"]:
        v = struct.unpack_from("<6d", data, at)
        shape, at = Cartesian(v[:3], v[3:]), at + 48
    elif kind == GEOMETRY_ID["stretched"]:
        sizes = struct.unpack_from("<3Q", data, at)
        at, edges = at + 24, []
        for n in sizes:
            edges.append(struct.unpack_from(f"<{n}d", data, at))
            at += 8 * n
        shape = Stretched(tuple(edges))
    elif kind != 0:
        raise ValueError(f"unknown geometry {kind}")
    return GridMeta((x, y, z), level, (bool(px), bool(py), bool(pz)), hood, shape), at


def read_head(read, length: int, header_length: int = 0) -> tuple[GridMeta, bytes, int, int]:
    """Metadata, header, number of cells and where their table starts. read(n): the first n bytes of the file."""

    def upto(n: int) -> bytes:
        if n > length:
            raise ValueError("the file ends within its preamble")
        return read(n)

    fixed = header_length + 47
    (kind,) = struct.unpack_from("<i", upto(fixed), fixed - 4)
    whole = fixed + (48 if kind == GEOMETRY_ID["cartesian"] else 0)
    if kind == GEOMETRY_ID["stretched"]:
        whole = fixed + 24 + 8 * sum(struct.unpack_from("<3Q", upto(fixed + 24), fixed))
    content = upto(whole + 8)
    meta, end = parse_preamble(content, header_length)
    (n,) = struct.unpack_from("<Q", content, end)
    return meta, content[:header_length], n, end + 8
