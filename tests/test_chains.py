import pytest
from pyspark.sql import functions as F

from loomway.operators import chains

SCHEMA = "day_id string, num_dep int, ident_dep string, origin_purpose string, destination_purpose string, destination_motive double, motive double, moridom int, mode_group string, mobloc int, departure_s int, arrival_s int"
ORDER = ("num_dep", "ident_dep")


def hm(t):
    return None if t is None else int(t[:2]) * 3600 + int(t[3:]) * 60


def days(spark, rows):
    out = []
    for i, (day, num, origin, dest, motive, mode, dep, arr) in enumerate(rows):
        out.append((day, num, f"d{i:03}", origin, dest, motive, motive, 1, mode, 1, hm(dep), hm(arr)))
    return spark.createDataFrame(out, SCHEMA)


CASES = [
    ("closed", 2, "9.1", "1.1", 1.1, "car_driver", "17:00", "17:30"), ("closed", 1, "1.1", "9.1", 9.1, "car_driver", "08:00", "08:30"),
    ("open", 1, "1.1", "9.1", 9.1, "car_driver", "08:00", "08:30"),
    ("flag", 1, None, "1.2", 1.2, "walk", "08:00", "08:30"), ("nodest", 1, "1.1", None, None, "walk", "08:00", None),
    ("holiday", 1, "1.1", "8.1", 8.1, "car_driver", "08:00", "10:00"),
    ("sport30", 1, "1.1", "7.6", 7.6, "walk", "08:00", "08:10"), ("sport30", 2, "7.6", "1.1", 1.1, "walk", "08:40", "08:50"),
    ("sport14", 1, "1.1", "7.6", 7.6, "walk", "08:00", "08:10"), ("sport14", 2, "7.6", "1.1", 1.1, "walk", "08:24", "08:50"),
    ("sport15", 1, "1.1", "7.6", 7.6, "walk", "08:00", "08:10"), ("sport15", 2, "7.6", "1.1", 1.1, "walk", "08:25", "08:50"),
    ("stroll", 1, "1.1", "7.7", 7.7, "walk", "08:00", "08:10"), ("stroll", 2, "7.7", "1.1", 1.1, "car_driver", "09:24", "09:50"),
    ("alone", 1, "1.1", "7.6", 7.6, "walk", "08:00", "08:10"),
    ("midnight", 1, "1.1", "7.6", 7.6, "cycle", "23:40", "23:55"), ("midnight", 2, "7.6", "1.1", 1.1, "cycle", "00:05", "00:20"),
]


def test_scope_flags(spark):
    got = {}
    for r in chains.scope_trips(days(spark, CASES), ORDER).orderBy("day_id", "num_dep").collect():
        got.setdefault(r.day_id, []).append(r.is_destination)
    assert got == {"closed": [True, True], "open": [True], "flag": [True], "nodest": [True], "holiday": [False], "sport30": [True, True], "sport14": [False, False], "sport15": [True, True], "stroll": [False, False], "alone": [True], "midnight": [False, False]}
    rounds = {r.day_id: r.is_round for r in chains.scope_days(days(spark, CASES), ORDER).collect()}
    assert rounds["closed"] and rounds["flag"] and not rounds["open"] and not rounds["nodest"]


def test_tours(spark):
    rows = [("d", 1, "1.1", "9.1", 9.1, "walk", "08:00", "08:10"), ("d", 2, "9.1", "1.1", 1.1, "walk", "12:00", "12:10"), ("d", 3, "1.1", "2.1", 2.1, "walk", "14:00", "14:10")]
    t = chains.tours(chains.scope_trips(days(spark, rows), ORDER), ORDER, F.lit(True)).orderBy("num_dep").collect()
    assert [(r.tour_id, r.tour_size, r.is_complete) for r in t] == [(0, 2, True), (0, 2, True), (1, 1, False)]


@pytest.mark.parametrize(
    "flags,theta,k,want",
    [
        ("1111", 0.5, 1, ("kept", 0, 3, False)), ("1000", 0.5, 1, ("dropped", 0, 3, False)), ("0111", 0.5, 1, ("cut", 1, 3, False)), ("1110", 0.5, 1, ("cut", 0, 2, False)), ("0111", 0.5, 2, ("kept", 0, 3, False)),
        ("00110110", 0.4, 2, ("cut", 2, 7, False)), ("1100011", 0.5, 3, ("kept", 0, 6, True)), ("0000", 0.0, 1, ("dropped", 0, 3, False)), ("0011100", 0.4, 2, ("cut", 2, 4, False)),
    ],
)
def test_cut_ends(spark, flags, theta, k, want):
    df = spark.createDataFrame([("p", i, c == "1") for i, c in enumerate(flags)], "p string, pos int, hit boolean")
    r = chains.cut_ends(df, ["p"], "pos", "hit", theta, k).first()
    assert (r.outcome, r.start, r.end, r.flagged) == want


def test_unknown_scope():
    with pytest.raises(ValueError):
        chains.scope_filter("round-dest")
    assert len(chains.SCOPES) == 8
