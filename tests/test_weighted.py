import hashlib
from collections import Counter
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomway.operators import bootstrap as bs
from loomway.operators import decompose as dc
from loomway.operators import weighted as wt
from loomway.operators.prefix import dense_index, prefix_sums
from loomway.operators.regression import wls


@pytest.fixture(scope="module")
def sample(spark):
    r = random.Random(8)
    rows = [("hot" if r.random() < 0.6 else r.choice(["a", None]), float(r.randrange(40)), r.choice([0.5, 1.0, 2.0, 0.0, None, float("nan")]), f"i{i}") for i in range(800)]
    return rows, spark.createDataFrame(rows, "g string, x double, w double, id string").cache()


def good(rows, g):
    v = [(x, w) for k, x, w, _ in rows if k == g and w and np.isfinite(w)]
    v.sort()
    return np.array([x for x, _ in v]), np.array([w for _, w in v])


def test_quantiles_and_trimmed_mean(sample):
    rows, df = sample
    run = wt.running(df, ["g"], "x", "w")
    step = {(r.g, r.p): r.value for r in wt.quantiles_step(run, ["g"], (0.1, 0.5, 1.0)).collect()}
    inter = {(r.g, r.p): r.value for r in wt.quantiles_interpolated(run, ["g"], (0.0, 0.3, 0.9, 1.0)).collect()}
    trim = {r.g: r.trimmed for r in wt.trimmed_mean(run, ["g"], 0.05).collect()}
    for g in ("hot", "a", None):
        x, w = good(rows, g)
        c = np.cumsum(w)
        for p in (0.1, 0.5, 1.0):
            assert step[g, p] == x[min(np.searchsorted(c, p * c[-1]), len(x) - 1)]
        u, inv = np.unique(x, return_inverse=True)
        share = np.cumsum(np.bincount(inv, w)) / w.sum()
        for p in (0.0, 0.3, 0.9, 1.0):
            assert inter[g, p] == pytest.approx(np.interp(p, share, u))
        keep = c[-1] * 0.95
        kept = np.where(c <= keep, w, np.maximum(0, keep - (c - w)))
        assert trim[g] == pytest.approx((kept * x).sum() / kept.sum())


def test_distributions(sample):
    rows, df = sample
    sup = wt.support(df, ["g"], "x", "w")
    got = {(r.g, r.point): r.share for r in wt.ecdf(sup, ["g"], 4.0, 40.0).collect()}
    for g in ("hot", None):
        x, w = good(rows, g)
        for t in (0.0, 8.0, 36.0, 40.0):
            assert got[g, t] == pytest.approx(w[x <= t].sum() / w.sum())
    ks = {r.g: r.ks for r in wt.ks_distance(df, ["g"], "x", "w", F.col("id") < "i5").collect()}
    one = [(x, w, i < "i5") for k, x, w, i in rows if k == "a" and w and np.isfinite(w)]
    pts = sorted({x for x, *_ in one})
    f = lambda s: np.array([sum(w for x, w, q in one if q == s and x <= p) for p in pts]) / sum(w for _, w, q in one if q == s)
    assert ks["a"] == pytest.approx(np.abs(f(True) - f(False)).max())
    m = {r.g: r for r in wt.moments(sup, ["g"]).collect()}
    x, w = good(rows, "hot")
    assert m["hot"].mean == pytest.approx(np.average(x, weights=w)) and m["hot"].variance == pytest.approx(np.average((x - m["hot"].mean) ** 2, weights=w))
    dens = wt.kde(sup, ["g"], F.lit(3.0), [i * 0.5 - 20 for i in range(160)]).where("g = 'hot'").agg(F.sum("density") * 0.5).first()[0]
    assert dens == pytest.approx(1, abs=1e-3)


def test_classes_have_equal_weight(sample):
    rows, df = sample
    c = wt.weighted_classes(df, "id", "x", "w").join(df, "id").groupBy("class").agg(F.sum("w").alias("w"), F.count("*").alias("n")).collect()
    by = {r["class"]: r for r in c}
    total = sum(by[k].w for k in range(1, 6))
    assert sum(r.n for r in c) == len(rows) and all(abs(by[k].w / total - 0.2) < 0.01 for k in range(1, 6))
    again = wt.weighted_classes(df, "id", "x", "w").exceptAll(wt.weighted_classes(df.orderBy("w"), "id", "x", "w")).count()
    assert again == 0


def test_prefix_sums_and_index(spark):
    df = spark.createDataFrame([("h", i, 1 if i % 3 else None) for i in range(300)] + [(None, i, 2) for i in range(5)], "g string, k int, a int")
    rows = prefix_sums(df, ["g"], ["k"], ["a"], partitions=7).collect()
    for g in ("h", None):
        run = 0
        for r in sorted((r for r in rows if r.g == g), key=lambda r: r.k):
            assert r.below_a == run
            run += r.a or 0
        assert all(r.total_a == run for r in rows if r.g == g)
    idx = dense_index(spark.createDataFrame([(f"k{i:03}",) for i in range(100)], "k string"), ["k"], "i")
    assert sorted((r.k, r.i) for r in idx.collect()) == [(f"k{i:03}", i) for i in range(100)]
    assert prefix_sums(df.limit(0), ["g"], ["k"], ["a"]).count() == 0


def test_draws_and_replicates(spark):
    roster = spark.createDataFrame([(f"h{i:03}",) for i in range(200)] + [(None,)], "hh string")
    drawn = bs.draws(roster, "hh", 10)
    d = bs.long_draws(drawn, 10)
    per = {r.rep: r.n for r in d.groupBy("rep").agg(F.sum("mult").alias("n")).collect()}
    assert per == {r: 200 for r in range(10)}
    var = d.agg((F.sum(F.col("mult") * F.col("mult")) / 2000 - 1).alias("v")).first().v
    assert 0.7 < var < 1.3
    rows = spark.createDataFrame([("a", "h001", 2.0), ("a", "h002", 3.0), ("b", "h001", 1.0), (None, "h002", 1.0), ("b", "h002", None)], "g string, hh string, x double").withColumn("mult", F.lit("clash"))
    got = {(r.g, r.rep): r.s for r in bs.replicates(rows, ["g"], "hh", {"s": F.col("x")}, drawn, 10).collect()}
    mult = {(r.hh, r.rep): r.mult for r in d.collect()}
    assert len(got) == 30
    for (g, rep), s in got.items():
        assert s == sum(x * mult.get((h, rep), 0) for k, h, x in (("a", "h001", 2.0), ("a", "h002", 3.0), ("b", "h001", 1.0), (None, "h002", 1.0)) if k == g)
    assert bs.replicates(rows.limit(0), ["g"], "hh", {"s": F.col("x")}, drawn, 10).count() == 0
    with pytest.raises(Exception, match="outside the roster"):
        bs.replicates(rows, [], "hh", {"s": F.col("x")}, drawn.where("hh <> 'h001'"), 10).collect()


def test_strata_draw_as_many_as_they_have(spark, monkeypatch):
    monkeypatch.setattr(bs, "STRATUM", 30)
    roster = spark.createDataFrame([(s, f"h{i:03}") for s, n in (("a", 100), ("b", 7)) for i in range(n)], "s string, hh string")
    rows = bs.long_draws(bs.draws(roster, "hh", 8, "s", {"a": 0, "b": 500}), 8).collect()
    order = {s: {h: i for i, h in enumerate(sorted((f"h{i:03}" for i in range(n)), key=lambda h: (hashlib.md5(h.encode()).hexdigest(), h)))} for s, n in (("a", 100), ("b", 7))}
    per = Counter()
    for r in rows:
        per[r.s, r.rep, order[r.s][r.hh] * (4 if r.s == "a" else 1) // len(order[r.s])] += r.mult
    assert per == {("a", rep, st): 25 for rep in range(8) for st in range(4)} | {("b", rep, 0): 7 for rep in range(8)}


def test_verdicts_and_gates(spark):
    df = spark.createDataFrame([(0.95, 1.05), (1.2, 1.3), (0.8, 1.3), (None, None), (1.01, 1.05)], "lo double, hi double")
    assert [r[0] for r in df.select(bs.verdict(F.col("lo"), F.col("hi"), 0.1)).collect()] == ["equivalent", "different", "inconclusive", None, "equivalent"]
    reps = spark.createDataFrame([("a", float(i) if i else None) for i in range(20)] + [("b", None)] * 3 + [("b", 1.0)] * 17, "k string, v double")
    got = {r.k: (r.low, r.valid) for r in bs.interval(reps, ["k"], F.col("v"), 0.95, 20).collect()}
    assert got["a"][1] == 19 and got["a"][0] is not None and got["b"] == (None, 17)


def test_decompositions_add_up(spark):
    g = spark.createDataFrame([("a", "x", 10.0, 100.0, 5.0), ("a", "y", 5.0, 80.0, 5.0), ("b", "x", 12.0, 150.0, 6.0), ("b", "z", 3.0, 30.0, 6.0)], "survey string, grp string, weight double, minutes double, day_weight double")
    r = dc.shift_share(g).collect()
    change = 180 / 6 - 180 / 5
    assert sum(x.mix + x.within + x.interaction for x in r) + r[0].volume == pytest.approx(change)
    t = spark.range(1).select(*(c.alias(k) for k, c in dc.log_terms(F.lit(10.0), F.lit(12.0), {"u": (F.lit(2.0), F.lit(3.0), 1), "v": (F.lit(0.2), F.lit(0.25), -1)}).items())).first()
    assert t.u + t.v == pytest.approx(2.0)
    same = spark.range(1).select(dc.log_mean(F.lit(5.0), F.lit(5.0)), dc.log_mean(F.lit(0.0), F.lit(5.0))).first()
    assert tuple(same) == (5.0, None)


def test_merges():
    m = dc.neighbour_merge({("s", 0): (10, 40), ("s", 1): (25, 5), ("s", 2): (50, 50), ("s", 3): (1, 1), ("t", 0): (1, 1)}, 4)
    assert [m["s", i] for i in range(4)] == [0, 0, 2, 2] and [m["t", i] for i in range(4)] == [0, 0, 0, 0]
    c = dc.smallest_first_merge({1: 100, 2: 3, 3: 50, 4: 60, 5: 1}, 50)
    assert c == {1: 1, 2: 2, 3: 2, 4: 4, 5: 4} and dc.smallest_first_merge({1: 2}, 50) == {1: 1}


def test_wls_against_numpy(spark):
    r = np.random.default_rng(3)
    x, w = r.normal(size=(300, 2)), r.uniform(0.1, 2, 300)
    y = 1 + 2 * x[:, 0] - x[:, 1] + r.normal(size=300) * 0.1
    df = spark.createDataFrame([(float(a), float(b), float(c), float(d)) for a, b, c, d in zip(x[:, 0], x[:, 1], y, w)] + [(None, 1.0, 1.0, 1.0)], "a double, b double, y double, w double")
    got = {d["term"]: d["estimate"] for d in wls(df, F.col("y"), F.col("w"), {"one": F.lit(1.0), "a": F.col("a"), "b": F.col("b"), "twice": F.col("a") * 2}).collect()}
    X = np.c_[np.ones(300), x]
    want = np.linalg.solve(X.T @ (X * w[:, None]), X.T @ (w * y))
    assert [got["one"], got["a"], got["b"]] == pytest.approx(list(want)) and got["twice"] is None
    assert wls(df.limit(0), F.col("y"), F.col("w"), {"one": F.lit(1.0)}).count() == 0
