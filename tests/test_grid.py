"""The registered calibration grid is whole, and agrees with the SQL."""

from datetime import date
from pathlib import Path

import duckdb
from pyspark.sql import functions as F

import __spark_entry__ as entry
from loomway.operators import feeds

FOLDER = "/root/testdata/sf0.001"


def oracle(name):
    con = duckdb.connect()
    for p in Path(FOLDER).glob("*.parquet"):
        con.execute(f"create view {p.stem} as select * from read_parquet('{p}')")
    cur = con.execute(entry.oracle_sql()[name])
    return [d[0] for d in cur.description], cur.fetchall()


def test_whole_grid_and_the_sql(spark):
    got = entry.queries()["t_grid_evaluation"](spark, FOLDER).cache()
    per = got.groupBy("date", "r", "share", "k", "theta").count().collect()
    assert len(per) == 405 and len({r["count"] for r in per}) == 1
    cols, want = oracle("t_grid_evaluation")
    assert {tuple(r) for r in got.select(*cols).collect()} == {tuple(r) for r in want}
    scores = entry.queries()["t_grid_scores"](spark, FOLDER).collect()
    modes = {r.mode for r in scores}
    assert all(sorted(r.place for r in scores if r.mode == m) == list(range(1, 136)) for m in modes) and len(modes) > 1
    got.unpersist()


def test_dates_differ(spark):
    stops = spark.createDataFrame([("n", "p", "tram", False, i) for i in (1, 2, 3)], "network string, pattern_id string, mode string, express boolean, ordinal int")
    d1, d2 = date(2022, 1, 1), date(2024, 1, 1)
    rows = [(d2, "n", "p", i, "R", True, 5.0) for i in (1, 2, 3)] + [(d1, "n", "p", 1, "R", False, 5.0)]
    dist = spark.createDataFrame(rows, "date date, network string, pattern_id string, ordinal int, relation_id string, in_service boolean, distance_m double")
    names = spark.createDataFrame([(d2, "n", "p", "R", 1)], "date date, network string, pattern_id string, relation_id string, affiliation int")
    got = {(r.date, r.theta): (r.outcome, r.covered) for r in feeds.evaluate_grid(stops, dist, names, [25.0], [0.5], [1], [0.5, 0.9], [d1, d2]).orderBy(F.col("date")).collect()}
    assert got == {(d1, t): ("not-testable", 0) for t in (0.5, 0.9)} | {(d2, t): ("kept", 3) for t in (0.5, 0.9)}


def test_fallback_renaming_and_loose_lines(spark):
    lines = {"f": ("tram", False), "s": ("tram", False), "m": ("tram", False), "b": ("bus", False), "e": ("bus", True)}
    stops = spark.createDataFrame([("n", p, m, e, i) for p, (m, e) in lines.items() for i in range(1, 5)], "network string, pattern_id string, mode string, express boolean, ordinal int")
    near = [(p, i, "R", True, 5.0, False) for p, which in {"s": (1, 2, 3, 4), "m": (1, 2, 3, 4), "b": (1, 2), "e": (1, 2)}.items() for i in which] + [("f", i, None, None, 5.0, True) for i in (2, 3, 4)] + [("m", 1, None, None, 5.0, True)]
    dist = spark.createDataFrame([("n", *r) for r in near], "network string, pattern_id string, ordinal int, relation_id string, in_service boolean, distance_m double, is_fallback boolean")
    names = spark.createDataFrame([("n", p, "R", 1) for p in "mbe"], "network string, pattern_id string, relation_id string, affiliation int")
    got = {r.pattern_id: (r.outcome, r.covered, r.start_idx, r.end_idx) for r in feeds.evaluate_grid(stops, dist, names, [25.0], [0.5], [1], [0.9]).collect()}
    assert got == {"f": ("cut", 3, 2, 4), "s": ("kept-renamed", 4, 1, 4), "m": ("kept", 4, 1, 4), "b": ("kept", 2, 1, 4), "e": ("cut", 2, 1, 2)}
