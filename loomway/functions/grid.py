"""Grid cells of a metric projection: ids, codes, children, neighbours, and the projection itself."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

BASE = 100_000
CODE = r"^CRS3035RES(\d+)mN(\d+)E(\d+)$"


def cell_id(north: Column, east: Column, resolution: int) -> Column:
    """Integer id of the cell; null outside the grid (negative, not finite, or an easting index beyond the base)."""
    n, e = F.floor(north / resolution), F.floor(east / resolution)
    ok = (north >= 0) & (east >= 0) & (north < 1e9) & (e < BASE)
    return F.when(ok, n * BASE + e).cast("long")


def cell_origin(cell: Column, resolution: int) -> tuple[Column, Column]:
    """South-west corner (north, east) in metres."""
    return F.floor(cell / BASE).cast("long") * resolution, F.pmod(cell, F.lit(BASE)) * resolution


def cell_code(north: Column, east: Column, resolution: int) -> Column:
    c = cell_id(north, east, resolution)
    n, e = cell_origin(c, resolution)
    return F.when(c.isNotNull(), F.concat(F.lit(f"CRS3035RES{resolution}mN"), n.cast("string"), F.lit("E"), e.cast("string")))


def parse_code(code: Column) -> tuple[Column, Column, Column]:
    """(north, east, resolution) of a cell's code, null where it is none or not aligned."""
    res, n, e = (F.nullif(F.regexp_extract(code, CODE, i), F.lit("")).try_cast("long") for i in (1, 2, 3))
    ok = (res > 0) & (n % res == 0) & (e % res == 0)
    return F.when(ok, n), F.when(ok, e), F.when(ok, res)


def children(cell: Column, parent_resolution: int, child_resolution: int) -> Column:
    """Ids of the cells nested in a cell, by northing then easting."""
    k = parent_resolution // child_resolution
    if k < 2 or parent_resolution % child_resolution:
        raise ValueError("the child resolution must divide the parent's")
    n, e = F.floor(cell / BASE).cast("long") * k, F.pmod(cell, F.lit(BASE)) * k
    return F.transform(F.sequence(F.lit(0), F.lit(k * k - 1)), lambda i: (n + F.floor(i / k)) * BASE + e + F.pmod(i, F.lit(k)))


def neighbours(cell: Column, reach: int = 2) -> Column:
    """Ids of the cells around, without the cell itself."""
    w = 2 * reach + 1
    ids = F.transform(F.sequence(F.lit(0), F.lit(w * w - 1)), lambda i: cell + (F.floor(i / w).cast("long") - reach) * BASE + F.pmod(i, F.lit(w)) - reach)
    return F.filter(ids, lambda x: x != cell)


def tile_bounds(north: Column, east: Column, size: int, halo: int = 0) -> Column:
    """Half-open (north_min, east_min, north_max, east_max) of a point's tile with its halo."""
    n, e = F.floor(north / size) * size - halo, F.floor(east / size) * size - halo
    return F.struct(n.alias("north_min"), e.alias("east_min"), (n + size + 2 * halo).alias("north_max"), (e + size + 2 * halo).alias("east_max"))


# The European equal-area projection: ellipsoid, centre and false origin (fixed values).
_A, _F = 6_378_137.0, 1 / 298.257222101
_LON0, _LAT0, _X0, _Y0 = 10.0, 52.0, 4_321_000.0, 3_210_000.0
_E2 = _F * (2 - _F)
_E = math.sqrt(_E2)


def _q(s):
    return (1 - _E2) * (s / (1 - _E2 * s * s) - 1 / (2 * _E) * math.log((1 - _E * s) / (1 + _E * s)))


def project(lon: Column, lat: Column) -> tuple[Column, Column]:
    """(x, y) in metres of degrees, by the forward Lambert azimuthal equal-area formulas."""
    qp, q0 = _q(1.0), _q(math.sin(math.radians(_LAT0)))
    b0 = math.asin(q0 / qp)
    rq = _A * math.sqrt(qp / 2)
    s0 = math.sin(math.radians(_LAT0))
    d = _A * math.cos(math.radians(_LAT0)) / math.sqrt(1 - _E2 * s0 * s0) / (rq * math.cos(b0))
    s = F.sin(F.radians(lat))
    q = (1 - _E2) * (s / (1 - _E2 * s * s) - 1 / (2 * _E) * F.ln((1 - _E * s) / (1 + _E * s)))
    b = F.asin(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), q / qp)))
    dl = F.radians(lon - _LON0)
    k = rq * F.sqrt(2 / (1 + math.sin(b0) * F.sin(b) + math.cos(b0) * F.cos(b) * F.cos(dl)))
    return _X0 + k * d * F.cos(b) * F.sin(dl), _Y0 + k / d * (math.cos(b0) * F.sin(b) - math.sin(b0) * F.cos(b) * F.cos(dl))


def segment_distance(px: Column, py: Column, ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    """Distance of a point from a segment, its foot kept between the ends."""
    dx, dy = bx - ax, by - ay
    length2 = dx * dx + dy * dy
    t = F.coalesce(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.try_divide((px - ax) * dx + (py - ay) * dy, length2))), F.lit(0.0))
    return F.sqrt(F.pow(px - ax - t * dx, 2) + F.pow(py - ay - t * dy, 2))
