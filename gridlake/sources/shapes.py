"""Boundary files: the polygons of a shapefile and the attributes beside them.

The two files (.shp and .dbf) describe a stated, small set of boundaries, at most
MOST_BYTES together, so they are read on the driver and handed on as rings, which
`space.bridge` turns into a table of cells. Their layout is the public one of
the format; only polygons (types 5, 15 and 25) are read.
"""

from __future__ import annotations

import struct

from pyspark.sql import DataFrame, SparkSession

from ..operators import select, space
from .zarr import _read

MOST_BYTES = 256 << 20


def polygons(data: bytes) -> list[list[space.Ring]]:
    """The rings of each record of a .shp file; a null record has none."""
    if len(data) < 100 or struct.unpack(">i", data[:4])[0] != 9994:
        raise ValueError("not a shapefile")
    at, out = 100, []
    while at + 12 <= len(data):
        size = struct.unpack(">i", data[at + 4 : at + 8])[0] * 2
        body = data[at + 8 : at + 8 + size]
        at += 8 + size
        kind = struct.unpack("<i", body[:4])[0]
        if kind == 0:
            out.append([])
            continue
        if kind not in (5, 15, 25):
            raise ValueError(f"shapes of type {kind} are no polygons")
        parts, points = struct.unpack("<ii", body[36:44])
        first = [*struct.unpack(f"<{parts}i", body[44 : 44 + 4 * parts]), points]
        xy = struct.unpack(f"<{2 * points}d", body[44 + 4 * parts : 44 + 4 * parts + 16 * points])
        whole = list(zip(xy[::2], xy[1::2], strict=True))
        out.append([whole[a:b] for a, b in zip(first, first[1:], strict=False)])
    return out


def attributes(data: bytes, encoding: str = "utf-8") -> list[dict[str, str | None]]:
    """The rows of a .dbf file as strings; blanks are None."""
    count, header, width = struct.unpack("<IHH", data[4:12])
    fields, at = [], 32
    while data[at] != 0x0D:
        fields.append((data[at : at + 11].split(b"\0")[0].decode(), data[at + 16]))
        at += 32
    out = []
    for i in range(count):
        place, row = header + i * width + 1, {}
        for name, size in fields:
            row[name] = data[place : place + size].decode(encoding, "replace").strip() or None
            place += size
        out.append(row)
    return out


def read(spark: SparkSession, path: str, name: str) -> dict[str, list[space.Ring]]:
    """The polygons of a shapefile by one of its attributes; parts with one name are one boundary."""
    shp, dbf = (_read(spark, path.removesuffix(".shp") + end) for end in (".shp", ".dbf"))
    if shp is None or dbf is None or len(shp) + len(dbf) > MOST_BYTES:
        raise ValueError(f"{path}: .shp and .dbf of at most {MOST_BYTES} bytes are read")
    out: dict[str, list[space.Ring]] = {}
    for rings, row in zip(polygons(shp), attributes(dbf), strict=True):
        if name not in row:
            raise ValueError(f"no attribute {name}; there are {sorted(row)}")
        if row[name] is not None:
            out.setdefault(row[name], []).extend(rings)
    return out


def names(spark: SparkSession, path: str, name: str) -> list[str]:
    """The boundaries that a shapefile offers."""
    return sorted(read(spark, path, name))


def clip(df: DataFrame, cells: DataFrame, path: str, name: str, chosen: list[str] | None = None, separated: bool = False) -> DataFrame:
    """Rows of the cells within the chosen boundaries of a shapefile (all of them by default)."""
    shapes = read(df.sparkSession, path, name)
    wanted = sorted(shapes) if chosen is None else chosen
    if unknown := set(wanted) - set(shapes):
        raise ValueError(f"no such boundaries: {sorted(unknown)}")
    bridge = space.bridge(cells, {k: shapes[k] for k in wanted})
    return (select.clip_separated if separated else select.clip_region)(df, bridge, wanted)
