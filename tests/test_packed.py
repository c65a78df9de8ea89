from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from loomway.operators import packed
from loomway.tables import table

TEXTS = ['"Ligne ""C""";b', "a|b;;c", "[\"x\", 'y z']", "{39996,27375:b}", " ", None, "", "T2 | bis\t\n9", '"a;b', '"  " ; " q "', "６/é；ñ¦z", 'x"y;z"w', "𝒳𝒴 ;\U0001f600; ok", "a" * 90_000 + ";" + "b,c" * 9_000]


def run(spark, texts, blanks):
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "rec_id long, t string, pos string").withColumn("item", F.lit(0))
    out = {}
    for r in sorted(packed.unpack(df, "t", ["rec_id"], blanks).collect()):
        out.setdefault(r.rec_id, []).append((r.pos, r.item))
    return out


def want(texts, blanks):
    got = {i: list(enumerate(packed.unpack_brute(t, blanks), 1)) for i, t in enumerate(texts)}
    return {i: x for i, x in got.items() if x}


def test_cases(spark):
    for blanks in (True, False):
        assert run(spark, TEXTS, blanks) == want(TEXTS, blanks)
    assert [x for _, x in run(spark, TEXTS, True)[0]] == ['Ligne "C"', "b"]


def test_beyond_the_broadcast_limit(spark, monkeypatch):
    monkeypatch.setattr(packed, "BROADCAST_BYTES", -1)
    assert run(spark, TEXTS * 3, True) == want(TEXTS * 3, True)


@settings(max_examples=10, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet='ab1:-+._ "|;,\t[]{}é', max_size=14), max_size=30))
def test_random(spark, texts):
    for blanks in (True, False):
        assert run(spark, texts, blanks) == want(texts, blanks)


def test_stored_fields(spark):
    df = table(spark, "/root/testdata/sf0.01", "pt_openings_mapping", "rec_id", "candidate_refs")
    texts = {r.rec_id: r.candidate_refs for r in df.collect()}
    got = {}
    for r in sorted(packed.unpack(df, "candidate_refs", ["rec_id"], True).collect()):
        got.setdefault(r.rec_id, []).append(r.item)
    assert got == {i: x for i, t in texts.items() if (x := packed.unpack_brute(t, True))}
