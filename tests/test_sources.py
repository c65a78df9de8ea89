import json
import re
import zipfile

import pytest
from pyspark.sql import functions as F

from loomway.operators.nearby import parse_wkt
from loomway.sources import files, sinks
from loomway.streaming import days


def test_delimited(spark, tmp_path):
    p = tmp_path / "t.csv"
    p.write_bytes("id;w;name\n01;1,5;é€\n02;NA;\"a;b\"\n03;2.5\n".encode("windows-1252"))
    rows = files.read_delimited(spark, str(p), ["id", "w", "name"], types={"w": "double"}, encoding="windows-1252").collect()
    assert [tuple(r) for r in rows] == [("01", None, "é€"), ("02", None, "a;b"), ("03", 2.5, None)]
    wide = files.optional_columns(files.read_feed_table(spark, str(p)).select(F.lit("7").alias("A")), {"a": "int", "b": "double"})
    assert wide.dtypes == [("a", "int"), ("b", "double")] and tuple(wide.first()) == (7, None)


def test_features(spark, tmp_path):
    p = tmp_path / "g.json"
    square = [[[0.0, 0.0], [2.0, 0.0], [2.0, 2.0], [0.0, 0.0]]]
    p.write_text(json.dumps({"type": "FeatureCollection", "features": [{"properties": {"code": "1"}, "geometry": {"type": "Polygon", "coordinates": square}}, {"properties": {"code": "2"}, "geometry": {"type": "MultiPolygon", "coordinates": [square, square]}}, {"properties": {"code": "3"}, "geometry": None}]}))
    got = {r.code: r.wkt for r in files.read_features(spark, str(p), ["code"]).collect()}
    assert len(parse_wkt(got["1"])) == 1 and len(parse_wkt(got["2"])) == 2 and got["3"] is None


def test_archives(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("feed/stops.txt", "id,name\n1,a\r\n2,b\n")
        z.writestr("trips.txt", "x")
    (tmp_path / "b.zip").write_bytes(b"no archive")
    lines = files.read_archived(spark, str(tmp_path / "*.zip"), "stops.txt").orderBy("line_no").collect()
    assert [(r.line_no, r.line) for r in lines] == [(1, "id,name"), (2, "1,a"), (3, "2,b")]
    rep = {r.archive[-5:]: r for r in files.archive_report(spark, str(tmp_path / "*.zip"), ["stops.txt", "agency.txt"]).collect()}
    assert rep["a.zip"].valid and rep["a.zip"].missing == ["agency.txt"] and not rep["b.zip"].valid and rep["b.zip"].error


def test_box_is_pushed_down(spark, tmp_path):
    spark.conf.set("spark.sql.maxMetadataStringLength", "5000")  # else the plan's text is cut
    df = spark.range(4).select(F.col("id"), F.struct(*(F.col("id").cast("double").alias(c) for c in ("xmin", "xmax", "ymin", "ymax"))).alias("bbox"))
    sinks.write_parquet(df, str(tmp_path / "b"))
    got = files.read_box(spark, str(tmp_path / "b"), 1, 1, 2, 2)
    assert sorted(r.id for r in got.collect()) == [1, 2]
    plan = got._jdf.queryExecution().toString()
    pushed = re.search(r"PushedFilters: \[(.*?)\], ReadSchema", plan)[1]
    assert all(f"{op}(bbox.{c},{v}.0)" in pushed for op, c, v in (("LessThanOrEqual", "xmin", 2), ("GreaterThanOrEqual", "xmax", 1), ("LessThanOrEqual", "ymin", 2), ("GreaterThanOrEqual", "ymax", 1)))
    spark.conf.unset("spark.sql.maxMetadataStringLength")


def test_stages_and_signatures(spark, tmp_path):
    built = []

    def build():
        built.append(1)
        return spark.range(3)

    for _ in range(2):
        assert sinks.signed(spark, str(tmp_path), "x", build, a=1).count() == 3
    assert len(built) == 1 and sinks.signed(spark, str(tmp_path), "x", build, a=2).count() == 3 and len(built) == 2
    sinks.stage(spark, str(tmp_path / "s"), build, "id long")
    sinks.stage(spark, str(tmp_path / "s"), build, "id long")
    sinks.stage(spark, str(tmp_path / "s"), build, "id long, x int")
    assert len(built) == 4
    sinks.write_report(spark.createDataFrame([("a", 60, 1.0), ("b", 5, 2.0)], "g string, n int, v double"), str(tmp_path / "r"), ["v"], "n")
    text = next((tmp_path / "r").glob("*.csv")).read_text().split()
    assert text == ["g,n,v", "a,60,1.0", "b,5,"]
    assert files.read_config(str(_json(tmp_path, {"a": 2})), {"a": 1, "b": 3}) == {"a": 2, "b": 3}
    with pytest.raises(ValueError):
        files.read_config(str(_json(tmp_path, {"z": 2})), {"a": 1})
    assert files.inline(spark, [], "a int").dtypes == [("a", "int")]


def _json(tmp_path, d):
    p = tmp_path / "c.json"
    p.write_text(json.dumps(d))
    return p


def test_streams_agree_with_batch(spark, tmp_path):
    e = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    (tmp_path / "in").mkdir()
    e.repartition(3).write.parquet(str(tmp_path / "in" / "events"))
    s = days.read_stream(spark, str(tmp_path / "in" / "events"), e.schema)
    days.run_available(days.daily_totals(s), "totals", str(tmp_path / "c1"), "complete").stop()
    want = e.groupBy("user_id", F.to_date("ts").alias("d")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("t"))
    got = spark.table("totals").select("user_id", F.to_date("start").alias("d"), F.col("events").alias("n"), F.round("total", 4).alias("t"))
    assert got.exceptAll(want).count() == 0 and got.count() == want.count()
    days.run_available(days.sessions(s), "sess", str(tmp_path / "c2"), "complete").stop()
    assert spark.table("sess").agg(F.sum("events")).first()[0] == e.count()
    twice = days.deduplicated(s.union(s), ["event_id"])
    days.run_available(twice, "once", str(tmp_path / "c3")).stop()
    assert spark.table("once").count() == e.count()


def test_features_by_line_and_long_archives(spark, tmp_path):
    shape = {"type": "Polygon", "coordinates": [[[0.0, 0.0], [1.0, 0.0], [1.0, 1.0], [0.0, 0.0]]]}
    p = tmp_path / "lines.json"
    p.write_text("\n".join(json.dumps({"type": "Feature", "properties": {"code": str(i)}, "geometry": shape if i else None}) for i in range(3)) + "\n")
    assert {r.code: r.wkt is None for r in files.read_features(spark, str(p), ["code"], lines=True).collect()} == {"0": True, "1": False, "2": False}
    with zipfile.ZipFile(tmp_path / "long.zip", "w") as z:
        z.writestr("a.txt", "\n".join(map(str, range(25_000))))
    with zipfile.ZipFile(tmp_path / "bad.zip", "w") as z:
        z.writestr("a.txt", b"fine\n" * 20_000 + b"\xff\xfe")
    got = files.read_archived(spark, str(tmp_path / "*.zip"), "a.txt")
    assert got.count() == 25_000 and got.where("line_no != cast(line as long) + 1").count() == 0


def test_publishing_views_and_results(spark, tmp_path):
    path = str(tmp_path / "t")
    sinks.publish(spark, spark.range(3), path)
    sinks.publish(spark, spark.range(9), path)  # the one that is there stays
    assert spark.read.parquet(path).count() == 3 and [x.name for x in tmp_path.iterdir()] == ["t"]
    spark.range(10).createOrReplaceTempView("shadowed")
    before = spark.table("shadowed")
    sinks.shadow(spark, "shadowed", lambda v: v.where("id > 3"))
    assert sinks.shadow(spark, "shadowed", lambda v: v.where("id < 6")).count() == spark.table("shadowed").count() == 2 and before.count() == 10
    assert sinks.fetch(spark.range(4)).num_rows == 4 and sinks.fetch_columns(spark.range(3))["id"].tolist() == [0, 1, 2]
    assert sinks.fetch_one(spark.range(1)) == (0,)
    for bad in (lambda: sinks.fetch(spark.range(4), 3), lambda: sinks.fetch_one(spark.range(2)), lambda: sinks.fetch_one(spark.range(0))):
        with pytest.raises(ValueError):
            bad()
    arrow = pytest.importorskip("pyarrow").table({"a": [1, None], "b": ["x", "y"]})
    assert files.from_arrow(spark, arrow).dtypes == [("a", "bigint"), ("b", "string")]
    pytest.importorskip("yaml")
    (tmp_path / "c.yaml").write_text("a: 2\n# comment\n")
    assert files.read_config(str(tmp_path / "c.yaml"), {"a": 1, "b": [3]}) == {"a": 2, "b": [3]}
