"""Points near other points, and points within regions."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomway.functions.exprs import finite
from loomway.operators.rangeprobe import stream_probe

EARTH_RADIUS_M = 6_371_008.8
TILE_DEG = 0.25
#: Points at home in a cell from which the cell is split: few bytes, but a task would compare each with all of its neighbours.
CELL_ROWS = 2_000
#: Crowded cells up to which their list is broadcast, 24 bytes each.
CROWDED_BROADCAST = 100_000


def usable_points(df: DataFrame, id_col: str = "id", lon: str = "lon", lat: str = "lat") -> DataFrame:
    """(id, lon, lat), once per id: without rows that have no id, no finite place within the ranges, or both at 0.

    If an id comes with several usable places, the smallest (lon, lat) counts.
    """
    one = df.select(F.col(id_col).cast("long").alias("id"), F.col(lon).cast("double").alias("lon"), F.col(lat).cast("double").alias("lat")).where("id is not null")
    lon_, lat_ = F.col("lon"), F.col("lat")
    one = one.where(finite(lon_) & finite(lat_) & lon_.between(-180, 180) & lat_.between(-90, 90) & ~((lon_ == 0) & (lat_ == 0)))
    return one.groupBy("id").agg(F.min(F.struct("lon", "lat")).alias("_p")).select("id", "_p.lon", "_p.lat")


def great_circle_m(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """Haversine distance in metres."""
    a, b = F.radians(lat1), F.radians(lat2)
    h = F.pow(F.sin((b - a) / 2), 2) + F.cos(a) * F.cos(b) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return F.lit(2 * EARTH_RADIUS_M) * F.asin(F.least(F.lit(1.0), F.sqrt(h)))


def near_pairs(points: DataFrame, radius_m: float, cell_m: float | None = None) -> DataFrame:
    """Pairs (id_a < id_b) of points (id, lon, lat) at most `radius_m` apart on the sphere.

    Rows of cells of equal height go around the globe, each with as many
    columns as fit at its side towards the equator. A point is copied to each
    cell its radius can reach and meets the points at home there, so a pair
    comes out once, at the home of its smaller id. A cell with more than
    CELL_ROWS points at home is split by their ids, and its copies go to each
    part, so that one crowded place is many tasks. Works over the date line and
    at the poles.
    """
    cell = cell_m or 2 * radius_m
    step = float(np.degrees(cell / EARTH_RADIUS_M))
    reach = float(np.degrees(radius_m / EARTH_RADIUS_M)) * (1 + 1e-9)
    band = lambda lat: F.floor((lat + 90) / F.lit(step))
    # Degrees of longitude that the radius spans at a latitude; everything near the poles.
    s = F.lit(float(np.sin(np.radians(reach))))
    cos = F.cos(F.radians("lat"))
    span = F.when(F.abs("lat") + F.lit(2 * reach) >= 90, F.lit(180.0)).otherwise(F.degrees(F.asin(F.least(F.lit(1.0), s / cos))) * (1 + 1e-9))
    widest = lambda b: F.cos(F.radians(F.least(F.abs(b * step - 90), F.abs((b + 1) * step - 90))))
    columns = lambda b: F.greatest(F.lit(1), F.floor(F.lit(360 / step) * widest(b))).cast("long")
    column = lambda lon, n: F.floor((lon + 180) / 360 * n)
    base = points.select("id", "lon", "lat", band(F.col("lat")).alias("b0"), span.alias("span"))
    base = base.withColumn("n0", columns(F.col("b0")))
    home = base.select("id", "lon", "lat", F.col("b0").alias("band"), F.pmod(column(F.col("lon"), F.col("n0")), F.col("n0")).alias("col"))
    lat = F.col("lat")
    copies = base.withColumn("band", F.explode(F.sequence(band(F.greatest(F.lit(-90.0), lat - reach)), band(F.least(F.lit(90.0), lat + reach)))))
    copies = copies.withColumn("n", columns(F.col("band")))
    first, last = column(F.col("lon") - F.col("span"), F.col("n")), column(F.col("lon") + F.col("span"), F.col("n"))
    copies = copies.withColumn("col", F.explode(F.array_distinct(F.transform(F.sequence(first, F.least(last, first + F.col("n") - 1)), lambda j: F.pmod(j, F.col("n"))))))
    # At most one row for every CELL_ROWS points; their number is measured, as nearly always there is none.
    crowded = home.groupBy("band", "col").agg(F.count("*").alias("n")).where(F.col("n") > CELL_ROWS).select("band", "col", F.ceil(F.col("n") / CELL_ROWS).alias("parts"))
    many = crowded.count()
    whole = F.lit(0).cast("long")
    if many:
        crowded = F.broadcast(crowded) if many <= CROWDED_BROADCAST else crowded
        home = home.join(crowded, ["band", "col"], "left").withColumn("part", F.when(F.col("parts").isNull(), whole).otherwise(F.pmod(F.xxhash64("id"), F.col("parts"))))
        copies = copies.drop("n").join(crowded, ["band", "col"], "left").withColumn("part", F.explode(F.sequence(whole, F.coalesce("parts", F.lit(1).cast("long")) - 1)))
    else:
        home, copies = home.withColumn("part", whole), copies.withColumn("part", whole)
    a = home.select("band", "col", "part", F.col("id").alias("id_a"), F.col("lon").alias("lon_a"), F.col("lat").alias("lat_a"))
    b = copies.select("band", "col", "part", F.col("id").alias("id_b"), F.col("lon").alias("lon_b"), F.col("lat").alias("lat_b"))
    near = great_circle_m(F.col("lon_a"), F.col("lat_a"), F.col("lon_b"), F.col("lat_b")) <= radius_m
    return a.join(b, ["band", "col", "part"]).where((F.col("id_a") < F.col("id_b")) & (F.abs(F.col("lat_a") - F.col("lat_b")) <= reach) & near).select("id_a", "id_b")


def parse_wkt(text: str | None) -> list[list[np.ndarray]]:
    """Parts of a (multi)polygon, each a list of closed rings, the outer one first; [] where there is no shape."""
    if not text or not re.match(r"\s*(SRID=\d+;)?\s*(MULTI)?POLYGON\b", text, re.I):
        return []
    parts: list[list[np.ndarray]] = []
    for part in re.findall(r"\(\s*(\([^()]*\)(?:\s*,\s*\([^()]*\))*)\s*\)", text):
        rings = []
        for ring in re.findall(r"\(([^()]*)\)", part):
            try:
                pts = np.array([[float(v) for v in p.split()[:2]] for p in ring.split(",") if p.strip()], float).reshape(-1, 2)
            except ValueError:
                continue
            if len(pts) and (pts[0] != pts[-1]).any():
                pts = np.vstack([pts, pts[:1]])
            rings.append(pts)
        if rings and len(rings[0]):
            parts.append(rings)
    return parts


class Slabs:
    """Trapezoidal decomposition of a region: slabs between neighbouring breakpoints in x, edges in each from low to high.

    Breakpoints are the vertices and the crossings of edges, so no two edges
    cross inside a slab. `inside` says for the space under each edge, and over
    the last, whether it belongs to the region.
    """

    def __init__(self, xs, offset, x0, y0, slope, inside):
        self.xs, self.offset, self.x0, self.y0, self.slope, self.inside = xs, offset, x0, y0, slope, inside

    @classmethod
    def build(cls, parts: list[list[np.ndarray]]) -> Slabs:
        edges = []
        for p, rings in enumerate(parts):
            for r, ring in enumerate(rings):
                for (ax, ay), (bx, by) in zip(ring[:-1], ring[1:]):
                    if ax != bx:
                        edges.append((ax, ay, bx, by, p, r) if ax < bx else (bx, by, ax, ay, p, r))
        e = np.array(edges, float).reshape(-1, 6)
        slope = (e[:, 3] - e[:, 1]) / (e[:, 2] - e[:, 0]) if len(e) else np.empty(0)
        points = np.unique(e[:, [0, 2]])
        more = [points]
        slab, k = cls._spread(points, e)
        left, right = points[slab], points[slab + 1]
        yl, yr = e[k, 1] + (left - e[k, 0]) * slope[k], e[k, 1] + (right - e[k, 0]) * slope[k]
        order = np.lexsort((yr, yl, slab))
        # Edges from low to high at a slab's left that fall back at its right: only there do any cross.
        falls = (np.diff(slab[order]) == 0) & (np.diff(yr[order]) < 0)
        at = np.searchsorted(slab[order], np.unique(slab[order][1:][falls])), np.searchsorted(slab[order], np.unique(slab[order][1:][falls]), "right")
        for lo, hi in zip(*at):
            m = order[lo:hi]
            dl, dr = yl[m][:, None] - yl[m][None, :], yr[m][:, None] - yr[m][None, :]
            i, j = np.nonzero(np.triu(dl * dr < 0))
            x0, x1 = left[m[0]], right[m[0]]
            cross = x0 + (x1 - x0) * dl[i, j] / (dl[i, j] - dr[i, j])
            more.append(cross[(cross > x0) & (cross < x1)])
        points = np.unique(np.concatenate(more))
        slab, k = cls._spread(points, e)
        middle = (points[slab] + points[slab + 1]) / 2
        order = np.lexsort((k, e[k, 1] + (middle - e[k, 0]) * slope[k], slab))
        slab, k = slab[order], k[order]
        offset = np.searchsorted(slab, np.arange(max(1, len(points))))
        inside, ring = [], list(map(tuple, e[k, 4:6].astype(int).tolist()))
        for lo, hi in zip(offset[:-1].tolist(), offset[1:].tolist()):
            odd: set[tuple[int, int]] = set()
            inside.append(False)
            for i in range(lo, hi):
                odd ^= {ring[i]}
                inside.append(any(r == 0 and not any(q == p and h > 0 for q, h in odd) for p, r in odd))
        return cls(points, offset.astype(np.int64), e[k, 0], e[k, 1], slope[k], np.array(inside, bool))

    @staticmethod
    def _spread(points: np.ndarray, e: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(slab, edge) of every edge in every slab it spans; edges begin and end at breakpoints."""
        first, last = np.searchsorted(points, e[:, 0]), np.searchsorted(points, e[:, 2])
        n = last - first
        edge = np.repeat(np.arange(len(e)), n)
        return np.repeat(first, n) + np.arange(len(edge)) - np.repeat(np.cumsum(n) - n, n), edge

    def clip(self, a: float, z: float) -> Slabs | None:
        """The slabs that meet [a, z]."""
        i, j = max(0, np.searchsorted(self.xs, a, "right") - 1), min(len(self.xs) - 1, np.searchsorted(self.xs, z, "left") + 1)
        if j <= i:
            return None
        lo, hi = self.offset[i], self.offset[j]
        return Slabs(self.xs[i : j + 1], self.offset[i : j + 1] - lo, self.x0[lo:hi], self.y0[lo:hi], self.slope[lo:hi], self.inside[lo + i : hi + j])

    def contains(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        slab = np.searchsorted(self.xs, x, "right") - 1
        ok = (slab >= 0) & (slab < len(self.xs) - 1)
        at = np.where(ok, slab, 0)
        lo, hi = self.offset[at].copy(), self.offset[at + 1].copy()
        start = lo.copy()
        hi[~ok] = lo[~ok]
        while (open_ := lo < hi).any():
            mid = (lo + hi) // 2
            m = mid[open_]
            below = self.y0[m] + (x[open_] - self.x0[m]) * self.slope[m] < y[open_]
            lo[open_], hi[open_] = np.where(below, m + 1, lo[open_]), np.where(below, hi[open_], m)
        return ok & self.inside[np.where(ok, lo + at, 0)] & (lo >= start)

    def pack(self) -> bytes:
        """One binary value: the arrays' lengths, then the arrays. Arrow writes it far faster than lists."""
        arrays = [np.asarray(getattr(self, n), float) for n in _ARRAYS]
        return np.array([len(a) for a in arrays], np.int64).tobytes() + b"".join(a.tobytes() for a in arrays)

    @classmethod
    def unpack(cls, data: bytes) -> Slabs:
        head = 8 * len(_ARRAYS)
        ends = np.cumsum(np.frombuffer(data[:head], np.int64))
        got = dict(zip(_ARRAYS, np.split(np.frombuffer(data[head:], float), ends[:-1])))
        return cls(**got | {"offset": got["offset"].astype(np.int64), "inside": got["inside"].astype(bool)})


_ARRAYS = ("xs", "offset", "x0", "y0", "slope", "inside")


def _decompose(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        out = []
        for rid, texts in zip(pdf["rid"], pdf["geoms"]):
            parts = [p for t in texts for p in parse_wkt(t)]
            if not parts:
                continue
            slabs = Slabs.build(parts)
            if len(slabs.xs) < 2:
                continue
            box = np.vstack([r for p in parts for r in p])
            (x_lo, y_lo), (x_hi, y_hi) = np.floor(box.min(0) / TILE_DEG).astype(int), np.floor(box.max(0) / TILE_DEG).astype(int)
            for tx in range(x_lo, x_hi + 1):
                c = slabs.clip(tx * TILE_DEG, (tx + 1) * TILE_DEG)
                if c is not None:
                    packed = c.pack()
                    out += [(tx, ty, rid, packed) for ty in range(y_lo, y_hi + 1)]
        yield pd.DataFrame(out, columns=["tx", "ty", "rid", "slabs"])


def containing_regions(points: DataFrame, regions: DataFrame, region_id: str, wkt: str, rows_per_split: int = 100_000) -> DataFrame:
    """(region, id) for each point (id, lon, lat) and each region that contains it in plane degrees.

    Region borders are split into ordered slabs (see Slabs), the slabs go to
    the tiles they meet, and each point is located by binary search among the
    edges of its slab. A tile with many points is split. Holes are outside,
    open rings are closed to their first point; null, empty or unreadable
    shapes contain nothing. Rows that share a region id are one region.
    """
    shapes = regions.select(F.col(region_id).try_cast("long").alias("rid"), F.col(wkt).alias("g")).where("rid is not null and g is not null").groupBy("rid").agg(F.collect_list("g").alias("geoms"))
    build = shapes.mapInPandas(_decompose, "tx int, ty int, rid long, slabs binary")
    tile = lambda c: F.floor(F.col(c) / TILE_DEG).cast("int")
    probe = points.select(tile("lon").alias("tx"), tile("lat").alias("ty"), "id", "lon", "lat")

    def prepare(b: pd.DataFrame) -> list[tuple[int, Slabs]]:
        return [(int(r), Slabs.unpack(x)) for r, x in zip(b["rid"], b["slabs"])]

    def locate(built: list[tuple[int, Slabs]], rows: pd.DataFrame) -> pd.DataFrame:
        x, y, ids = rows["lon"].to_numpy(float), rows["lat"].to_numpy(float), rows["id"].to_numpy(np.int64)
        got = [(rid, ids[s.contains(x, y)]) for rid, s in built]
        return pd.DataFrame({"region": np.concatenate([np.full(len(i), rid, np.int64) for rid, i in got] or [np.empty(0, np.int64)]), "id": np.concatenate([i for _, i in got] or [np.empty(0, np.int64)])})

    return stream_probe(build, probe, ["tx", "ty"], F.xxhash64("id"), locate, "region long, id long", rows_per_split, prepare)
