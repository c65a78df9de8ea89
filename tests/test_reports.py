"""Operators behind the reports, on small tables."""

import math

import pytest
from pyspark.sql import functions as F

from loomway.functions import codes
from loomway.functions.exprs import drawn_below, looked_up
from loomway.operators import decompose as dc
from loomway.operators import feeds, legs, lines


def values(df, *names):
    return sorted((tuple(r[n] for n in names) for r in df.collect()), key=repr)


def test_codes_and_motives(spark):
    df = spark.createDataFrame([("1.10", "9.91", None), ("2.29", "1.1", "7.71"), ("0.00", "1.2", None), (None, None, "9.91"), ("5.59", "7.77", "1.1")], "m string, d string, o string")
    des, ori = codes.new_purpose(F.col("d")), codes.new_purpose(F.col("o"))
    got = [tuple(r) for r in df.select(codes.new_mode(F.col("m")), codes.motive(des, ori)).collect()]
    assert got == [(1.1, 9.1), (2.3, 7.1), (None, None), (None, None), (5.1, 7.7)]
    no_answer = spark.createDataFrame([(9999.0, 7.1), (1.1, 9999.0), (1.3, 9.1)], "d double, o double")
    assert [r[0] for r in no_answer.select(codes.motive(F.col("d"), F.col("o"))).collect()] == [None, None, 9.1]
    assert len(codes.by_old_code(codes.MODE_CODES)) == sum(map(len, codes.MODE_CODES.values()))


def test_strict_lookup(spark):
    df = spark.createDataFrame([("a",), (None,), ("b",)], "c string")
    assert [r[0] for r in df.select(looked_up(F.col("c"), {"a": "x", "b": "y"})).collect()] == ["x", None, "y"]
    with pytest.raises(Exception, match="unknown letter: b"):
        df.select(looked_up(F.col("c"), {"a": "x"}, "letter")).collect()
    assert df.limit(0).select(looked_up(F.col("c"), {"a": "x"})).count() == 0


def test_stable_sample(spark):
    df = spark.range(20_000).select(F.col("id").cast("string").alias("k"))
    n = {s: df.where(drawn_below("k", s)).count() for s in (0.1, 0.3)}
    assert abs(n[0.1] - 2000) < 200 and abs(n[0.3] - 6000) < 300
    assert df.where(drawn_below("k", 0.1) & ~drawn_below("k", 0.3)).count() == 0


def test_scaled_ends_and_other_power(spark):
    schema = "mtp double, maccompm int, maccomphm int, uu_status_ori string, uu_status_des string, uu_status_res string, tuu_res string, duration_min double, distance_km_declared double, declared_walk_min double, declared_wait_min double"
    trips = spark.createDataFrame([(3.1, 0, 0, "C", "C", "C", "8", 30.0, 12.0, None, None), (2.1, 0, 0, "C", "C", "C", "8", 20.0, 5.0, None, None), (5.6, 0, 0, "C", "C", "C", "8", 30.0, 8.0, None, None), (1.1, 0, 0, "C", "C", "C", "8", 20.0, 1.5, None, None)], schema)
    run = lambda **kw: {r.mode_group: r for r in legs.trip_legs(trips, **kw).collect()}
    one, half, declared = run(terminal="defaults"), run(terminal="defaults", scale=0.5), run(scale=0.5)
    assert half["car_driver"].energy_kh_kj != one["car_driver"].energy_kh_kj and half["walk"].energy_kh_kj == one["walk"].energy_kh_kj
    assert declared["car_driver"].energy_kh_kj == run()["car_driver"].energy_kh_kj  # declared ends are not scaled
    assert half["cycle"].bike_ride_s > one["cycle"].bike_ride_s
    assert run(bike_power_w=70.0)["cycle"].energy_kh_kj > run()["cycle"].energy_kh_kj
    v = 5000 / one["cycle"].bike_ride_s
    assert one["cycle"].implied_power_w == pytest.approx(v * (74 * 9.81 * 0.006 + 0.5 * 1.2 * 0.55 * v * v) / 0.976) and one["walk"].implied_power_w is None


def test_standard_speeds(spark):
    rows = [("s", "a", 0, 2.0, 10.0, 1.0), ("s", "a", 1, 1.0, 30.0, 1.0), ("s", "b", 0, 1.0, 20.0, 1.0), ("s", "b", 1, 1.0, 20.0, 1.0), ("s", "b", 2, 1.0, 9.0, 9.0), ("s", "mix", 0, 1.0, 0.0, 0.0), ("s", "mix", 1, 3.0, 0.0, 0.0), ("s", "mix", 2, 9.0, 0.0, 0.0), ("none", "a", 0, 1.0, 1.0, 1.0)]
    schema = "sel string, role string, cell int, w double, k double, h double"
    cells = spark.createDataFrame(rows, schema)
    common = dc.common_cells(cells, ["sel"])
    assert values(common, "sel", "cell") == [("s", 0), ("s", 1)]
    (r,) = dc.standard_speeds(cells, common, ["sel"]).collect()
    assert (r.sel, r.cells) == ("s", 2)
    assert r.speed_a == pytest.approx((1 * 5 + 3 * 30) / (1 * 0.5 + 3 * 1)) and r.speed_b == pytest.approx(20.0)
    # A replicate that lacks a common cell on one side has no speed there.
    reps = spark.createDataFrame([(*x, 0) for x in rows] + [("s", x[1], x[2], 0.0 if x[1:3] == ("a", 1) else x[3], *x[4:], 1) for x in rows[:-1]], schema + ", rep int")
    got = {r.rep: (r.speed_a, r.speed_b) for r in dc.standard_speeds(reps, common, ["sel"], ["rep"]).collect()}
    assert got[0][0] == pytest.approx(r.speed_a) and got[1][0] is None and got[1][1] == pytest.approx(20.0)
    assert dc.standard_speeds(cells.limit(0), common.limit(0), ["sel"]).count() == 0


def test_joint_mix_needs_support(spark):
    cells = spark.createDataFrame([("a", "x", 2.0, 10.0), ("a", "y", 1.0, 1.0), ("b", "x", 1.0, 0.0), ("b", "y", 3.0, 0.0)], "survey string, cell string, weight double, total double")
    assert dc.to_joint_mix(cells).first().value == pytest.approx((1 * 5 + 3 * 1) / 4)
    with pytest.raises(Exception, match="no support in cell z"):
        dc.to_joint_mix(cells.union(spark.createDataFrame([("b", "z", 1.0, 0.0)], cells.schema))).collect()
    assert dc.to_joint_mix(cells.limit(0)).first().value is None


def test_review_instructions_and_areas(spark):
    lines_ = spark.createDataFrame([(0.9, "kept"), (0.89, "cut"), (None, "dropped")], "share double, reason string")
    got = feeds.review_lists(lines_, "share", 0.9).withColumn("s", feeds.severity(F.col("reason"), ("dropped", "cut")))
    assert values(got, "list", "s") == [("automatic", 2), ("review", 0), ("review", 1)]
    edits = spark.createDataFrame([("remove", "extension"), ("remove", "suspension"), ("keep", "new_line"), (None, "new_line"), ("remove", None)], "s string, c string")
    assert [r[0] for r in edits.select(feeds.edit_instruction(F.col("s"), F.col("c"))).collect()] == ["cut", None, None, None, None]
    a = spark.createDataFrame([("x",), ("y",), ("z",), ("w",)], "authority string")
    f = spark.createDataFrame([(1, '["x"]'), (2, '["x", "y", "y"]'), (3, "no json"), (4, None), (5, "[]")], "id int, areas string")
    assert values(feeds.area_coverage(a, f, "id"), "authority", "coverage", "feeds") == [("w", "uncovered", 0), ("x", "dedicated", 2), ("y", "indirect", 1), ("z", "uncovered", 0)]


def test_lines(spark):
    ways = spark.createDataFrame([(1, [10, 11, 10, 99]), (2, [12]), (3, None), (4, [])], "id long, refs array<long>")
    nodes = spark.createDataFrame([(10, 0.0, 0.0), (11, 10.0, 0.0), (12, 5.0, 5.0)], "id long, x double, y double")
    p = lines.way_points(ways, nodes)
    assert values(p, "id", "place", "node") == [(1, 0, 10), (1, 1, 11), (1, 2, 10), (2, 0, 12)]
    assert values(lines.segments(p, "id", ["place"]), "id", "x0", "x1") == [(1, 0.0, 10.0), (1, 10.0, 0.0)]
    assert values(lines.envelopes(p, "id"), "id", "points", "xmin", "xmax", "ymax") == [(1, 3, 0.0, 10.0, 0.0), (2, 1, 5.0, 5.0, 5.0)]


def test_points_near_lines_against_brute_force(spark):
    import random

    r = random.Random(8)
    pts = [(f"l{k}", i, r.uniform(-900, 900), r.uniform(-900, 900)) for k in range(6) for i in range(r.choice([1, 2, 5]))]
    places = [(i, r.uniform(-1000, 1000), r.uniform(-1000, 1000)) for i in range(300)] + [(300, None, 0.0)]
    got = lines.near_lines(spark.createDataFrame(pts, "line string, i int, x double, y double"), spark.createDataFrame(places, "id int, x double, y double"), "line", ["i"], 80.0)
    want = {}
    for line in {p[0] for p in pts}:
        mine = [p[2:] for p in sorted(pts) if p[0] == line]
        for i, x, y in places:
            for (ax, ay), (bx, by) in zip(mine, mine[1:]):
                if x is not None:
                    d2 = (bx - ax) ** 2 + (by - ay) ** 2
                    t = max(0.0, min(1.0, ((x - ax) * (bx - ax) + (y - ay) * (by - ay)) / d2))
                    m = math.hypot(x - ax - t * (bx - ax), y - ay - t * (by - ay))
                    if m <= 80:
                        want[line, i] = min(m, want.get((line, i), m))
    found = {(q.line, q.id): q.metres for q in got.collect()}
    assert found.keys() == want.keys() and all(abs(found[k] - want[k]) < 1e-9 for k in want) and want


def test_rounding_levels_and_coarsening(spark):
    from loomway.operators import rounding as rd

    levels = (1, 5, 15, 30)
    df = spark.createDataFrame([(float(x),) for x in (0, 7, 10, 45, 60)], "d double")
    assert [r[0] for r in df.select(rd.rounding_level(F.col("d"), levels)).collect()] == [30, 1, 5, 15, 30]
    assert [tuple(r) for r in spark.createDataFrame([(2.0,), (7.5,)], "d double").select(*(rd.rounded(F.col("d"), 5, v) for v in rd.VARIANTS)).collect()] == [(0.0, 5.0, 5.0), (10.0, 10.0, 10.0)]
    rows = spark.createDataFrame([("a", f"k{i}", 1.0, float(1 + i % 59)) for i in range(4000)] + [("alone", "z", 1.0, 7.0)], "cell string, key string, w double, d double")
    targets = spark.createDataFrame([("a", 0.8, 0.6, 0.3), ("other", 1.0, 1.0, 1.0)], "cell string, target_5 double, target_15 double, target_30 double")
    got = rd.coarsened(rows, targets, levels).cache()
    mine = got.where("cell = 'a'")
    share = {k: mine.where(rd.rounding_level(F.col("after"), levels) >= k).count() / 4000 for k in (5, 15, 30)}
    # Durations that a coarser level draws leave their finer one, so only the last target is met from both sides.
    assert abs(share[30] - 0.3) < 0.05 and 0.55 < share[15] < 0.8 and 0.75 < share[5] < 0.95
    assert got.where("cell = 'alone' and after != d").count() == 0 and got.count() == 4001
    assert mine.where((rd.rounding_level(F.col("after"), levels) < rd.rounding_level(F.col("d"), levels))).count() == 0
    assert rd.coarsened(rows.limit(0), targets, levels).count() == 0


def test_names_with_affiliation(spark):
    ls = spark.createDataFrame([(1, "a", "n"), (2, "a", "other"), (3, "b", "n"), (4, "", "n"), (5, None, "n"), (6, "c", None)], "line long, key string, network string")
    rel = spark.createDataFrame([(10, "a", "n"), (11, "a", "n"), (11, "a", "n"), (12, "a", "m"), (13, "", "n"), (14, "c", None)], "relation long, key string, network string")
    got = values(feeds.name_matches(ls, rel), "line", "affiliation", "relations", "first")
    assert got == [(1, 1, 2, 10), (2, 0, 3, 10), (3, None, 0, None), (4, None, 0, None), (5, None, 0, None), (6, 0, 1, 14)]
    assert feeds.name_matches(ls.limit(0), rel).count() == 0 and {r.relations for r in feeds.name_matches(ls, rel.limit(0)).collect()} == {0}


def test_envelopes_of_binary_shapes(spark):
    import struct

    line = lambda o, pts: (b"\x01" if o == "<" else b"\x00") + struct.pack(o + "II", 2, len(pts)) + b"".join(struct.pack(o + "dd", *p) for p in pts)
    many = b"\x01" + struct.pack("<II", 5, 2) + line("<", [(0, 1), (2, 3)]) + line(">", [(-5, 9)])
    ring = b"\x01" + struct.pack("<III", 3, 1, 2) + struct.pack("<dddd", 1, 1, 4, 0)
    z = b"\x01" + struct.pack("<II", 1002, 2) + struct.pack("<6d", 1, 2, 99, 3, 4, 99)
    srid = b"\x01" + struct.pack("<III", 0x20000001, 4326, 0)[:8] + struct.pack("<I", 4326)[:0] + struct.pack("<dd", 7, 8)
    shapes = [many, ring, z, srid, line("<", []), None, b"\x01\x02", b""]
    df = spark.createDataFrame([(i, s) for i, s in enumerate(shapes)], "i int, s binary").withColumn("e", lines.wkb_envelope("s")).orderBy("i")
    got = [tuple(r.e) if r.e is not None else (None,) * 4 for r in df.collect()]
    assert got == [(-5, 1, 2, 9), (1, 0, 4, 1), (1, 2, 3, 4), (7, 8, 7, 8), *[(None,) * 4] * 4]


def test_parametrised_scan(spark, tmp_path):
    from loomway.sources import files

    spark.range(3).write.parquet(str(tmp_path / "y2024" / "t"))
    assert files.read_parametrised(spark, f"{tmp_path}/y?/?", "2024", "t", columns=["id"]).count() == 3
    with pytest.raises(ValueError):
        files.read_parametrised(spark, "a?", "x", "y")
