import random

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from loomway.operators.intervals import periods_and_gaps, survey_minutes


def brute(rows):
    out = []
    for k in {r[0] for r in rows if r[0] is not None}:
        ivs = sorted({(s, e) for kk, s, e in rows if kk == k and s is not None and e is not None and s <= e})
        merged = []
        for s, e in ivs:
            if merged and s <= merged[-1][1]:
                merged[-1][1] = max(merged[-1][1], e)
            else:
                merged.append([s, e])
        out += [(k, "period", s, e) for s, e in merged]
        out += [(k, "gap", a[1], b[0]) for a, b in zip(merged, merged[1:])]
    return sorted(out)


def run(spark, rows, width):
    df = spark.createDataFrame(rows, "d string, s long, e long").withColumn("shard", F.lit("clash")).withColumn("k", F.lit(1))
    return sorted(tuple(r) for r in periods_and_gaps(df, "d", "s", "e", width).collect())


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.sampled_from(["a", "b"]), st.integers(0, 60), st.integers(0, 25)), max_size=25))
def test_random(spark, rows):
    rows = [(k, s, s + n) for k, s, n in rows]
    assert run(spark, rows, 10) == brute(rows)


def test_hot_entity_nulls_and_empty(spark):
    r = random.Random(1)
    rows = [("hot", s := r.randrange(20000), s + r.choice([0, 0, 1, 2, 900])) for _ in range(900)]
    rows += rows[:50] + [(None, 1, 2), ("x", None, 3), ("x", 5, None), ("x", 9, 3), ("y", 10, 10), ("y", 20, 20), ("z", 10, 20), ("z", 20, 30)]
    assert run(spark, rows, 10) == brute(rows)
    assert run(spark, [], 10) == []


def test_survey_clock(spark):
    texts = [("4:00", "03:59"), ("23:50", "00:10:59"), ("24:00", "1:00"), ("12:60", "1:00"), (None, "1:00"), ("7h30", "8:00"), ("07:30", "07:30"), (" 7:30", "8:00")]
    s, e = survey_minutes(F.col("a"), F.col("b"))
    got = [tuple(r) for r in spark.createDataFrame(texts, "a string, b string").select(s, e).collect()]
    assert got[0] == (0, 1439) and got[1] == (1190, 1210) and got[6] == (210, 210)
    assert all(g[0] is None for g in (got[2], got[3], got[4], got[5], got[7]))
