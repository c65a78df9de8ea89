"""The whole cube: eleven components, eight indicators, days without a selected trip, trips without a distance."""

import pytest

import __spark_entry__ as entry
from loomway.plans.scope_cube import COMPONENTS, INDICATORS, components, cube
from pyspark.sql import functions as F

TRIPS = "survey string, hh string, category string, day_id string, typejour double, w double, is_round boolean, is_destination boolean, mobloc int, minutes double, producer_km double, crow_km double"


def test_components_and_indicators(spark):
    trip = lambda hh, day, w, round_, mobloc, m, km, crow, kind=1.0: ("J", hh, "c", day, kind, w, round_, True, mobloc, m, km, crow)
    rows = [
        trip("h1", "d1", 2.0, True, 1, 10.0, 4.0, None), trip("h1", "d1", 2.0, True, 1, 20.0, None, 3.0),
        trip("h1", "d2", 3.0, False, 1, 30.0, 6.0, 5.0),  # not round: left out by the day switch
        trip("h2", "d3", 5.0, True, 0, 40.0, 90.0, 80.0),  # kept, but no local trip
        trip("h2", "d4", 7.0, True, 1, 50.0, 5.0, 5.0, 2.0),  # a weekend
    ]
    roster = spark.createDataFrame([("J", "h1", "c", 2.0), ("J", "h2", "c", 1.0), ("J", "h3", "c", 1.0)], "survey string, hh string, category string, w double")
    parts = components(spark.createDataFrame(rows, TRIPS), roster)
    sums = {r.scope: r for r in parts.groupBy("scope").agg(*(F.sum(c).alias(c) for c in COMPONENTS)).collect()}
    want = dict(zip(COMPONENTS, (20, 3, 7, 2, 4, 60, 4, 8, 2, 6, 2), strict=True))
    assert {c: sums["round-dest-local"][c] for c in COMPONENTS} == want
    assert sums["alldays-dest-local"].dropped == 0 and sums["alldays-dest-local"].kept == 10 and sums["round-dest-daytable"].travel == 7
    out = cube(parts)
    got = {r.indicator: r.value for r in out.where("scope = 'round-dest-local'").collect()}
    assert got == pytest.approx({"person_days_kept_share": 17 / 20, "trips_per_day": 2.0, "minutes_per_trip": 15.0, "km_per_trip_producer": 4.0, "km_per_trip_crow_fly": 3.0, "minutes_per_day_day": 60 / 7, "minutes_per_day_travel_day": 30.0, "minutes_per_day_person": 60 / 17})


def test_registered_cube_has_all_indicators(spark):
    rows = entry.queries()["y_scope_cube"](spark, "/root/testdata/sf0.01").collect()
    assert {r.indicator for r in rows} == set(INDICATORS) and len({r.scope for r in rows}) == 8
    shown = [r for r in rows if r.survey == "J" and r.value is not None]
    assert {r.indicator for r in shown} == set(INDICATORS)
    assert all(r.low <= r.high for r in shown if r.low is not None) and any(r.low is not None for r in shown)
