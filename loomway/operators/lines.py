"""Lines from ordered points: assembly, envelopes, and points near them."""

from __future__ import annotations

import struct
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomway.functions.grid import segment_distance
from loomway.operators.relational import band_join


def way_points(ways: DataFrame, nodes: DataFrame) -> DataFrame:
    """(id, place, node, x, y) of ways (id, refs) in the order of their refs, from nodes (id, x, y).

    A node may stand in a way more than once; refs without a node are left out,
    as are ways without refs.
    """
    refs = ways.select(F.col("id"), F.posexplode("refs").alias("place", "node"))
    return refs.join(nodes.select(F.col("id").alias("node"), "x", "y"), "node").select("id", "place", "node", "x", "y")


def segments(points: DataFrame, line: str, order: Sequence[str]) -> DataFrame:
    """(line, x0, y0, x1, y1) between neighbouring points of each line; a line of one point has none."""
    w = W.partitionBy(line).orderBy(*order)
    s = points.select(line, F.lag("x").over(w).alias("x0"), F.lag("y").over(w).alias("y0"), F.col("x").alias("x1"), F.col("y").alias("y1"))
    return s.where("x0 is not null and y0 is not null and x1 is not null and y1 is not null")


def envelopes(points: DataFrame, line: str) -> DataFrame:
    """(line, points, xmin, ymin, xmax, ymax) of each line."""
    return points.groupBy(line).agg(F.count("*").alias("points"), *(f(c).alias(f"{c}{n}") for n, f in (("min", F.min), ("max", F.max)) for c in "xy"))


def near_lines(points: DataFrame, places: DataFrame, line: str, order: Sequence[str], radius: float) -> DataFrame:
    """Each place (x, y, other columns) with each line at most `radius` from it: (line, other columns, metres).

    A place meets the segments whose box, wider by the radius, holds it, by
    buckets of x; the exact distance is the least of those. A segment nearer
    than the radius always has the place in its box, so none is lost.
    """
    s = segments(points, line, order)
    box = s.select("*", *(e.alias(n) for n, e in (("_lo", F.least("x0", "x1") - radius), ("_hi", F.greatest("x0", "x1") + radius), ("_bottom", F.least("y0", "y1") - radius), ("_top", F.greatest("y0", "y1") + radius))))
    keep = [c for c in places.columns if c not in ("x", "y")]
    met = band_join(places.where("x is not null and y is not null"), box, "x", "_lo", "_hi", 500.0).where(F.col("y").between(F.col("_bottom"), F.col("_top")))
    d = segment_distance(*(F.col(c) for c in ("x", "y", "x0", "y0", "x1", "y1")))
    return met.groupBy(line, *keep).agg(F.min(d).alias("metres")).where(F.col("metres") <= radius)


def _extent(data: bytes, at: int, box: list[float]) -> int:
    """Widens the box by the geometry that begins at a byte of well-known binary; gives the byte behind it."""
    order = "<" if data[at] == 1 else ">"
    (code,) = struct.unpack_from(order + "I", data, at + 1)
    at += 5
    if code & 0x20000000:
        at += 4  # a reference system stands first
    kind = code & 0xFF
    size = 2 + bool(code & 0x80000000 or 1000 <= code % 0x10000000 < 2000 or 3000 <= code % 0x10000000 < 4000) + bool(code & 0x40000000 or 2000 <= code % 0x10000000 < 4000)
    if code % 0x10000000 >= 1000:
        kind = code % 1000

    def points(n: int, at: int) -> int:
        v = struct.unpack_from(f"{order}{n * size}d", data, at)
        xs, ys = [x for x in v[::size] if x == x], [y for y in v[1::size] if y == y]
        if xs and ys:
            box[:] = [min(box[0], *xs), min(box[1], *ys), max(box[2], *xs), max(box[3], *ys)]
        return at + 8 * n * size

    def count(at: int) -> tuple[int, int]:
        return struct.unpack_from(order + "I", data, at)[0], at + 4

    if kind == 1:
        return points(1, at)
    n, at = count(at)
    if kind == 2:
        return points(n, at)
    for _ in range(n):
        if kind == 3:
            m, at = count(at)
            at = points(m, at)
        else:
            at = _extent(data, at, box)
    return at


@F.pandas_udf(T.StructType([T.StructField(c, T.DoubleType()) for c in ("xmin", "ymin", "xmax", "ymax")]))
def wkb_envelope(shape: pd.Series) -> pd.DataFrame:
    """Envelope of a geometry in well-known binary, once per row; null where there is none, it is empty or can't be read."""
    inf, out = float("inf"), []
    for b in shape:
        box = [inf, inf, -inf, -inf]
        try:
            if b is not None:
                _extent(bytes(b), 0, box)
        except (struct.error, IndexError):
            box = [inf, inf, -inf, -inf]
        out.append(box if box[0] <= box[2] else [None] * 4)
    return pd.DataFrame(out, columns=["xmin", "ymin", "xmax", "ymax"], dtype="Float64")
