from datetime import date

from pyspark.sql import functions as F

from loomway.operators import feeds
from loomway.operators.relational import band_join, repeated_keys, require_empty

CAL = "service_id string, monday string, tuesday string, wednesday string, thursday string, friday string, saturday string, sunday string, start_date string, end_date string"


def feed(spark):
    week, weekend = ("1",) * 5 + ("0",) * 2, ("0",) * 5 + ("1",) * 2
    cal = [("wk", *week, "20240101", "20240131"), ("we", *weekend, "20240101", "20240131"), ("old", *week, "20230101", "20230131"), ("bad", *week, "2024", "20240131"), (None, *week, "20240101", "20240131")]
    exc = [("wk", date(2024, 1, 10), "2"), ("add", date(2024, 1, 10), "1"), ("we", date(2024, 1, 9), "2"), ("add", None, "1"), ("wk", date(2024, 1, 13), "1"), ("wk", date(2024, 1, 13), "1")]
    return spark.createDataFrame(cal, CAL), spark.createDataFrame(exc, "service_id string, day date, exception_type string")


def test_services(spark):
    cal, exc = feed(spark)
    on = lambda d: sorted(r[0] for r in feeds.active_services(cal, exc, d).collect())
    assert on(date(2024, 1, 9)) == ["wk"] and on(date(2024, 1, 10)) == ["add"] and on(date(2024, 1, 13)) == ["we", "wk"] and on(date(2025, 1, 1)) == []
    sd = feeds.service_days(cal, exc)
    n = {r.service_id: r["count"] for r in sd.groupBy("service_id").count().collect()}
    assert n == {"wk": 23 - 1 + 1, "we": 8, "old": 22, "add": 1}
    assert feeds.service_days(cal.limit(0), exc).count() == 2 and feeds.service_days(cal, exc.limit(0)).where("service_id = 'wk'").count() == 23


def test_patterns(spark):
    rows = [("t1", 1, "A"), ("t1", 2, "B"), ("t2", 2, "B"), ("t2", 1, "A"), ("t3", 1, "B"), ("t3", 2, "A"), ("t4", 1, None)]
    p = feeds.patterns(spark.createDataFrame(rows, "trip string, seq int, stop string"), ["trip"], ["seq"], "stop")
    assert sorted(((r.sequence, r.chains) for r in p.collect()), key=repr) == [(["A", "B"], 2), (["B", "A"], 1), ([None], 1)]
    assert [r.stop_sequence for r in feeds.expand_pattern(p.where(F.size("sequence") == 2), "chains").collect()] == [1, 2, 1, 2]


def test_grid_outcomes(spark):
    stop = lambda p, mode, n, net="n": [(net, p, mode, False, i) for i in range(1, n + 1)]
    stops = spark.createDataFrame(stop("tram", "tram", 5) + stop("bus", "bus", 4) + stop("lost", "bus", 4) + stop("solo", "bus", 3, "m"), "network string, pattern_id string, mode string, express boolean, ordinal int")
    near = lambda p, rel, which, d=10.0, net="n": [(net, p, i, rel, True, d) for i in which]
    dist = spark.createDataFrame(near("tram", "R1", (2, 3, 4)) + near("bus", "R2", (1, 2, 3)) + near("bus", "R3", (1,)) + near("lost", "R9", (1,), 90.0), "network string, pattern_id string, ordinal int, relation_id string, in_service boolean, distance_m double")
    names = spark.createDataFrame([("n", "tram", "R1", 2), ("n", "tram", "R7", 1), ("n", "bus", "R3", 1), ("n", "lost", "R9", 1)], "network string, pattern_id string, relation_id string, affiliation int")
    got = {(r.pattern_id, r.theta): (r.outcome, r.start_idx, r.end_idx, r.covered) for r in feeds.evaluate_grid(stops, dist, names, [25.0], [0.5], [1], [0.5, 0.9]).collect()}
    assert got["tram", 0.5] == ("cut", 2, 4, 3)
    # The bus's own name covers a quarter of its stops: a homonym, so the shape decides. Theta is for guided and express lines.
    assert got["bus", 0.5] == got["bus", 0.9] == ("kept-renamed", 1, 4, 3)
    assert got["lost", 0.5] == ("dropped", 1, 4, 0) and got["solo", 0.5][0] == "not-testable"


def test_helpers(spark):
    a = spark.createDataFrame([(1, 0.5), (2, 3.0), (3, None)], "id int, x double")
    b = spark.createDataFrame([("p", 0.0, 1.0), ("q", 0.5, 9.0), ("r", 5.0, 4.0), ("s", None, 1.0)], "k string, lo double, hi double")
    assert sorted((r.id, r.k) for r in band_join(a, b, "x", "lo", "hi", 2.0).collect()) == [(1, "p"), (1, "q"), (2, "q")]
    dup = repeated_keys(spark.createDataFrame([(1,), (1,), (2,), (None,)], "k int"), ["k"]).collect()
    assert sorted((r.k is None, r.rows) for r in dup) == [(False, 2), (True, 1)]
    require_empty(a.limit(0), "x")
    t = spark.createDataFrame([({"railway": "rail"}, "2025-03-01"), ({"disused:railway": "rail"}, "2024"), ({}, None), (None, "soon")], "tags map<string,string>, d string")
    got = t.select(feeds.lifecycle_excluded(F.col("tags")), feeds.opens_after(F.col("d"), F.lit(date(2024, 6, 1)))).collect()
    assert [r[0] for r in got] == [False, True, False, None] and [r[1] for r in got] == [True, False, False, False]
    old = spark.createDataFrame([(1, "u", "ok"), (2, "v", "ok")], "id int, url string, checked string")
    new = spark.createDataFrame([(1, "u"), (2, "w"), (3, "z")], "id int, url string").withColumn("checked", F.lit(None).cast("string"))
    assert sorted(tuple(r) for r in feeds.upsert(old, new, "id", ["url"], "url", ["checked"]).collect()) == [(1, "u", "ok"), (2, "w", None), (3, "z", None)]
