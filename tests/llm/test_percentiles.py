import random

import numpy as np
from pyspark.sql import functions as F

from loomway.llm.percentiles import merge_counts, percentiles, percentiles_from_counts, value_counts

P = (0.0, 0.1, 0.5, 0.9, 1.0)


def brute(rows):
    out = {}
    for g in {r[0] for r in rows}:
        v = [x for k, x, *_ in rows if k == g and x is not None and np.isfinite(x)]
        if v:
            out |= {(g, p): (float(np.quantile(v, p)), len(v)) for p in P}
    return out


def as_dict(df):
    return {(r.g, r.p): (r.value, r.n) for r in df.collect()}


def check(got, want):
    assert got.keys() == want.keys()
    for k in want:
        assert got[k][1] == want[k][1] and abs(got[k][0] - want[k][0]) < 1e-9, k


def test_skewed_groups_pieces_and_ties(spark):
    r = random.Random(2)
    rows = [("hot" if r.random() < 0.5 else r.choice(["a", None, "c"]), r.choice([r.gauss(0, 9), 1.0, 1.0, 2.5, None, float("nan"), float("inf")]), r.choice(["m1", "m2", None])) for _ in range(3000)]
    rows += [("one", 7.0, "m1"), ("none", None, "m1"), ("two", -0.0, "m1"), ("two", 0.0, "m2")]
    df = spark.createDataFrame(rows, "g string, x double, m string").withColumn("part", F.lit("clash")).withColumn("v", F.lit(1)).withColumn("c", F.lit(1))
    check(as_dict(percentiles(df, ["g"], "x", P)), brute(rows))
    pieces = value_counts(df, ["g"], "x", piece="m")
    check(as_dict(percentiles_from_counts(merge_counts(pieces, ["g"]), ["g"], P, partitions=7)), brute(rows))


def test_empty(spark):
    df = spark.createDataFrame([], "g string, x double")
    assert percentiles(df, ["g"], "x", P).count() == 0


def test_pieces_are_stored_by_month_and_combined_with_a_later_one(spark, tmp_path):
    rows = [("a", float(i % 7), f"2024-0{1 + i % 3}") for i in range(60)]
    schema = "g string, x double, m string"
    first, late = ([r for r in rows if (r[2] == "2024-03") == x] for x in (False, True))
    for part in (first, late):
        value_counts(spark.createDataFrame(part, schema), ["g"], "x", piece="m").write.mode("append").partitionBy("m").parquet(str(tmp_path / "pieces"))
    stored = spark.read.parquet(str(tmp_path / "pieces"))
    check(as_dict(percentiles_from_counts(merge_counts(stored, ["g"]), ["g"], P)), brute(rows))
    march = merge_counts(stored.where("m = '2024-03'"), ["g"])
    check(as_dict(percentiles_from_counts(march, ["g"], P)), brute(late))
