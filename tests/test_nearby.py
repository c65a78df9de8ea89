import numpy as np
from pyspark.sql import functions as F

from loomway.operators.nearby import EARTH_RADIUS_M, Slabs, containing_regions, near_pairs, parse_wkt, usable_points


def distance(a, b):
    (x1, y1), (x2, y2) = np.radians(a), np.radians(b)
    h = np.sin((y2 - y1) / 2) ** 2 + np.cos(y1) * np.cos(y2) * np.sin((x2 - x1) / 2) ** 2
    return 2 * EARTH_RADIUS_M * np.arcsin(min(1, np.sqrt(h)))


def inside(parts, x, y):
    def ring(r):
        c = False
        for (ax, ay), (bx, by) in zip(r[:-1], r[1:]):
            if (ax > x) != (bx > x) and y > ay + (x - ax) * (by - ay) / (bx - ax):
                c = not c
        return c

    return any(ring(p[0]) and not any(ring(h) for h in p[1:]) for p in parts)


def test_near_pairs_everywhere(spark):
    r = np.random.default_rng(4)
    pts = []
    for lon, lat in ((2.3, 48.8), (179.9999, -17), (-179.9999, -17), (10, 89.9999), (-120, 89.9999), (5, -89.9998), (0.00001, 0.00001), (-61, 14.6)):
        cos = max(0.001, np.cos(np.radians(lat)))
        for _ in range(60):
            x, y = lon + r.normal() * 0.0004 / cos, lat + r.normal() * 0.0004
            pts.append(((x + 180) % 360 - 180, float(np.clip(y, -90, 90))))
    rows = [(i, float(x), float(y)) for i, (x, y) in enumerate(pts)]
    df = spark.createDataFrame(rows, "id long, lon double, lat double")
    got = sorted((a, b) for a, b in near_pairs(df, 25.0).collect())
    want = sorted((i, j) for i in range(len(pts)) for j in range(i + 1, len(pts)) if distance(pts[i], pts[j]) <= 25)
    assert got == want and len(want) > 50


def test_a_crowded_place_is_split(spark, monkeypatch):
    from loomway.operators import nearby

    monkeypatch.setattr(nearby, "CELL_ROWS", 7)
    r = np.random.default_rng(5)
    pts = [(2.3 + r.normal() * 1e-4, 48.8 + r.normal() * 1e-4) for _ in range(150)] + [(2.3, 48.8)] * 50
    df = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(pts)], "id long, lon double, lat double")
    got = sorted((a, b) for a, b in near_pairs(df, 25.0).collect())
    assert got == sorted((i, j) for i in range(200) for j in range(i + 1, 200) if distance(pts[i], pts[j]) <= 25)


def test_usable_points(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, 2.0, 3.0), (1, 2.0, 3.0), (2, None, 1.0), (3, nan, 1.0), (4, 181.0, 0.0), (5, 1.0, -91.0), (6, 0.0, 0.0), (7, inf, 0.0), (None, 1.0, 1.0), (8, 0.0, 1.0)]
    df = spark.createDataFrame(rows, "id long, lon double, lat double").withColumn("_p", F.lit(1))
    assert sorted(r.id for r in usable_points(df).collect()) == [1, 8]
    assert usable_points(df.limit(0)).count() == 0


WKT = [
    "POLYGON ((0 0, 4 0, 4 4, 0 4, 0 0), (1 1, 2 1, 2 2, 1 2, 1 1))",
    "MULTIPOLYGON (((10 10, 12 10, 12 12, 10 12)), ((11 11, 13 11, 13 13, 11 13, 11 13, 11 11)))",
    "POLYGON ((20 0, 24 4, 24 0, 20 4))",
    "POLYGON ((0 20, 0.5 22, 3 23, 1.2 21, 4 20.5, 0 20), (0.6 20.6, 1.1 21, 0.9 20.7))",
]


def test_slabs_agree_with_ray_casting():
    r = np.random.default_rng(1)
    for text in WKT:
        parts = parse_wkt(text)
        box = np.vstack([x for p in parts for x in p])
        pts = r.uniform(box.min(0) - 0.5, box.max(0) + 0.5, (1500, 2))
        assert Slabs.build(parts).contains(pts[:, 0], pts[:, 1]).tolist() == [inside(parts, x, y) for x, y in pts]


def test_regions_split_tiles_and_odd_shapes(spark):
    r = np.random.default_rng(2)
    pts = np.vstack([r.uniform(-1, 14, (800, 2)), r.uniform(0, 0.2, (800, 2)), r.uniform([0, 20], [4, 23], (500, 2))])
    regions = [(str(i), t, 9) for i, t in enumerate(WKT)] + [("9", None, 9), ("10", "POLYGON EMPTY", 9), ("11", "garbage ((", 9), (None, WKT[0], 9), ("0", WKT[0], 9)]
    p = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(pts)], "id long, lon double, lat double")
    g = spark.createDataFrame(regions, "siren string, geom string, id int")
    got = sorted((a, b) for a, b in containing_regions(p, g, "siren", "geom", rows_per_split=100).collect())
    assert got == sorted((k, i) for k, t in enumerate(WKT) for i, (x, y) in enumerate(pts) if inside(parse_wkt(t), x, y))
    assert containing_regions(p.limit(0), g, "siren", "geom").count() == 0
    assert containing_regions(p, g.limit(0), "siren", "geom").count() == 0
