"""All registered household bootstraps draw the production number of replicates."""

import hashlib
from collections import Counter

import __spark_entry__ as entry
from loomway.operators import bootstrap as bs

FOLDER = "/root/testdata/sf0.001"


def test_production_draws(spark):
    rows = entry.queries()["x_draws"](spark, FOLDER).collect()
    assert {r.rep for r in rows} == set(range(200))
    # A replicate has as many draws as its survey has households.
    n = Counter()
    for r in rows:
        n[r.survey, r.rep] += r.mult
    assert len(n) == 400 and all(len({v for (s, _), v in n.items() if s == x}) == 1 for x in "ab")


def test_interval_against_brute_force(spark):
    from loomway.queries.base import days

    got = {(r.survey, r.band): r for r in entry.queries()["x_bootstrap_means"](spark, FOLDER).collect()}
    rows = days(spark, FOLDER).select("survey", "band", "hh", "w", "x").collect()
    for survey, offset in (("a", 0), ("b", 1000)):
        mine = [r for r in rows if r.survey == survey]
        hh = sorted({r.hh for r in mine}, key=lambda h: (hashlib.md5(h.encode()).hexdigest(), h))
        assert len(hh) <= bs.STRATUM
        est = {}
        for rep in range(200):
            mult = Counter(hh[bs.drawn_index(i, rep + offset, len(hh))] for i in range(len(hh)))
            sums = {}
            for r in mine:
                s = sums.setdefault(r.band, [0.0, 0.0])
                s[0] += r.w * mult[r.hh]
                s[1] += r.w * r.x * mult[r.hh]
            for band, (w, wx) in sums.items():
                if w:
                    est.setdefault(band, []).append(wx / w)
        for band, values in est.items():
            values.sort()
            at = lambda p: (lambda k: values[int(k)] + (k - int(k)) * (values[min(int(k) + 1, len(values) - 1)] - values[int(k)]))(p * (len(values) - 1))  # noqa: B023, E731
            row = got[survey, band]
            assert row.valid == len(values)
            if row.valid >= 190:
                assert abs(row.low - at(0.025)) < 1e-5 and abs(row.high - at(0.975)) < 1e-5
            else:
                assert row.low is None and row.high is None
