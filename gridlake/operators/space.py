"""Polygons as column expressions, derivatives on grids, and winds from geopotential height.

Polygons are a stated, small set of boundaries: their edges are literals in the
plan, so that cells meet them without a join. Facts then meet the bridge of
cells and names (select.clip_region).
"""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

Ring = list[tuple[float, float]]

EARTH_RADIUS_M = 6371229.0
OMEGA, GRAVITY = 7.292115e-5, 9.81


def parse_wkt(text: str) -> list[Ring]:
    """The rings of a POLYGON or MULTIPOLYGON, as (x, y) points; holes are rings too."""
    if not re.match(r"\s*(MULTI)?POLYGON\b", text, re.I):
        raise ValueError(f"not a polygon: {text[:40]}")
    return [[tuple(map(float, p.split()[:2])) for p in ring.split(",")] for ring in re.findall(r"\(([^()]+)\)", text)]


def _edges(rings: list[Ring]) -> Column:
    pairs = [(a, b) for r in rings for a, b in zip(r, [*r[1:], r[0]], strict=True) if a != b]
    return F.array(*[F.struct(*[F.lit(float(v)).alias(n) for n, v in zip(("ax", "ay", "bx", "by"), (*a, *b), strict=True)]) for a, b in pairs])


def inside(rings: list[Ring], x: Column, y: Column) -> Column:
    """Whether points lie in a polygon, by the parity of edges to their right; NULL coordinates lie nowhere."""

    def right(e: Column) -> Column:
        return ((e["ay"] > y) != (e["by"] > y)) & (x < (e["bx"] - e["ax"]) * (y - e["ay"]) / (e["by"] - e["ay"]) + e["ax"])

    xs, ys = [p[0] for r in rings for p in r], [p[1] for r in rings for p in r]
    near = x.between(min(xs), max(xs)) & y.between(min(ys), max(ys))
    return F.coalesce(near & (F.size(F.filter(_edges(rings), right)) % 2 == 1), F.lit(False))


def touches(rings: list[Ring], x: Column, y: Column, half_x: float, half_y: float) -> Column:
    """Whether the box around a cell's centre meets the polygon: its centre lies inside, or an edge crosses the box."""

    def crosses(e: Column) -> Column:
        cx, cy = (e["ax"] + e["bx"]) / 2 - x, (e["ay"] + e["by"]) / 2 - y
        dx, dy = (e["bx"] - e["ax"]) / 2, (e["by"] - e["ay"]) / 2
        return (F.abs(cx) <= half_x + F.abs(dx)) & (F.abs(cy) <= half_y + F.abs(dy)) & (F.abs(cx * dy - cy * dx) <= half_x * F.abs(dy) + half_y * F.abs(dx))

    return inside(rings, x, y) | F.coalesce(F.exists(_edges(rings), crosses), F.lit(False))


def bridge(cells: DataFrame, polygons: dict[str, list[Ring]], half: tuple[float, float] | None = None, x: str = "lon", y: str = "lat") -> DataFrame:
    """(cell_id, name) of the cells in each named polygon; half, the half sizes of cells, keeps all that touch."""
    px, py = F.col(x), F.col(y)
    hit = [F.when(touches(r, px, py, *half) if half else inside(r, px, py), F.lit(name)) for name, r in polygons.items()]
    if not hit:
        return cells.select("cell_id", F.lit(None).cast("string").alias("name")).where(F.lit(False))
    return cells.select("cell_id", F.explode(F.array_compact(F.array(*hit))).alias("name")).distinct()


def trim_edges(df: DataFrame, n: int = 10, y: str = "y_idx", x: str = "x_idx") -> DataFrame:
    """Without the n outermost rows and columns of the grid."""
    ends = df.agg(*[f(c).alias(f"{f.__name__}_{c}") for f in (F.min, F.max) for c in (y, x)])
    both = df.join(F.broadcast(ends))
    ok = [F.col(c).between(F.col(f"min_{c}") + n, F.col(f"max_{c}") - n) for c in (y, x)]
    return both.where(ok[0] & ok[1]).select(*df.columns)


def great_circle(lat1: Column, lon1: Column, lat2: Column, lon2: Column, radius: float = EARTH_RADIUS_M) -> Column:
    """Metres between two places on a sphere."""
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * radius * F.asin(F.sqrt(a))


def derivative(df: DataFrame, key: list[str], value: str, along: str, out: str, lat: str = "lat", lon: str = "lon") -> DataFrame:
    """df with the derivative of value along a grid line (key: all but `along`), to second order on uneven spacing.

    The ends take the three nearest points; a line of two has their slope, of one NULL.
    """
    w = Window.partitionBy(*key).orderBy(along)
    names = {k: (F.lag if k < 0 else F.lead) for k in (-2, -1, 1, 2)}
    at = lambda c, k: names[k](c, abs(k)).over(w) if k else F.col(c)
    gap = lambda a, b: great_circle(at(lat, a), at(lon, a), at(lat, b), at(lon, b))
    parts = {"_p2": at(value, -2), "_p1": at(value, -1), "_n1": at(value, 1), "_n2": at(value, 2), "_hp2": gap(-2, -1), "_hp1": gap(-1, 0), "_hn1": gap(0, 1), "_hn2": gap(1, 2)}
    d = df.withColumns(parts)
    v, p2, p1, n1, n2, hp2, hp1, hn1, hn2 = (F.col(c) for c in (value, *parts))
    middle = (hp1 * hp1 * n1 + (hn1 * hn1 - hp1 * hp1) * v - hn1 * hn1 * p1) / (hp1 * hn1 * (hp1 + hn1))
    first = -(2 * hn1 + hn2) / (hn1 * (hn1 + hn2)) * v + (hn1 + hn2) / (hn1 * hn2) * n1 - hn1 / (hn2 * (hn1 + hn2)) * n2
    last = (2 * hp1 + hp2) / (hp1 * (hp1 + hp2)) * v - (hp1 + hp2) / (hp1 * hp2) * p1 + hp1 / (hp2 * (hp1 + hp2)) * p2
    slope = F.when(hp1.isNotNull() & hn1.isNotNull(), middle).when(hn2.isNotNull(), first).when(hp2.isNotNull(), last).when(hn1.isNotNull(), (n1 - v) / hn1).when(hp1.isNotNull(), (v - p1) / hp1)
    return d.withColumn(out, slope).drop(*parts)


def geostrophic_wind(df: DataFrame, key: list[str], height: str, sine: str | None = None, cosine: str | None = None, y: str = "y_idx", x: str = "x_idx") -> DataFrame:
    """df with u and v, m/s, of the wind that balances a geopotential height; sine and cosine turn them to earth winds.

    key: what tells one grid from another (time, sim, level). NULL at the equator.
    """
    d = derivative(df, [*key, y], height, x, "_dx")
    d = derivative(d, [*key, x], height, y, "_dy")
    f = 2 * OMEGA * F.sin(F.radians("lat"))
    factor = F.when(f != 0, GRAVITY / f)
    u, v = -factor * F.col("_dy"), factor * F.col("_dx")
    if sine and cosine:
        u, v = u * F.col(cosine) - v * F.col(sine), v * F.col(cosine) + u * F.col(sine)
    return d.withColumns({"u": u, "v": v}).drop("_dx", "_dy")


def union(parts: Iterable[list[Ring]]) -> list[Ring]:
    """The rings of several polygons that do not overlap as one."""
    return [r for p in parts for r in p]
