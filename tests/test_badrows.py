import pytest
from pyspark.sql import functions as F

from loomway.operators import badrows as br

LINES = [
    ("calendar", 'S,0,1,1,1,0,1,0,20220803,20230122', None),
    ("calendar", '"S, ""x""",0,1,1,1,0,1,0," 20220803 ",x\r', None),
    ("calendar", '"a\nb",0,1,1,1,0,1,0,20240229,""', None),
    ("calendar", 'S,0,1,1,1,0,1,0,20230229,20230122', "bad_value"),
    ("calendar", 'S,0,1,1,1,0,1,0,18991231,20230122', "bad_value"),
    ("calendar", 'S,0,1,1,1,0,1,20220803,20230122', "column_count"),
    ("calendar", '', "column_count"),
    ("calendar", None, "column_count"),
    ("calendar", 'S "x",0,1,1,1,0,1,0,20220803,20230122', "quoting"),
    ("calendar", '"S"x,0,1,1,1,0,1,0,20220803,20230122', "quoting"),
    ("calendar", '"S,0,1,1,1,0,1,0,20220803,20230122', "quoting"),
    ("calendar", 'S,0,1,1,1,0,1,0,20220803,"20230122"\r\r', "quoting"),
    ("calendar_dates", '"""a",20220101,2', None),
    ("calendar_dates", '"","",1', None),
    ("calendar_dates", '\\s\\b,"\\,",1', None),
    ("calendar_dates", 'a""b,1,1', "quoting"),
    ("calendar_dates", 'service_id,date,exception_type', "bad_value"),
    ("calendar_dates", 'S,20220101,１', "bad_value"),
    ("trips_norm", 'D;J;1;08:00;09:00;"1440";1;x', None),
    ("trips_norm", 'D;J;1;08:00;09:00;;1;"a;b"', None),
    ("trips_norm", 'D;J;1;08:00;09:00;1440.5;1;x', "bad_value"),
    ("trips_norm", 'D;J;1;08:00;09:00;1e2;1;x', "bad_value"),
    ("trips_norm", 'D;J;1;08:00;09:00;4,5;1;x', "bad_value"),
    ("trips_norm", 'D;J;1;08:00;09:00;4;1', "column_count"),
    ("trips_norm", "x" * 300_000 + ";J;1;a;b;4;1;" + '"' + '""' * 50_000 + '"', None),
    ("other", "x", None),
    (None, "x", None),
]


def test_lines(spark):
    rows = [(i, f, line, 9) for i, (f, line, _) in enumerate(LINES)]
    raw = spark.createDataFrame(rows, "rec_id long, file_name string, line string, _f int")
    got = {r.rec_id: r.reason for r in br.rejected_lines(raw, br.LAYOUTS).collect()}
    for name, layout in br.LAYOUTS.items():
        mine = raw.where(F.col("file_name") == name)
        bad = {i for i in got if LINES[i][0] == name}
        good = {r.rec_id for r in br.strict_load(mine, layout).collect()}
        assert not good & bad and good | bad == {i for i, (f, *_) in enumerate(LINES) if f == name}
    assert got == {i: why for i, (*_, why) in enumerate(LINES) if why}


def test_loaded_fields_are_unquoted(spark):
    raw = spark.createDataFrame([(1, '"S, ""x""",0,1,1,1,0,1,0," 20220803 ",\\s@\r')], "rec_id long, line string")
    r = br.strict_load(raw, br.LAYOUTS["calendar"]).first()
    assert (r.service_id, r.start_date, r.end_date) == ('S, "x"', " 20220803 ", "\\s@")


def test_repeated_and_null_offsets(spark):
    raw = spark.createDataFrame([(1, "calendar_dates", "a,b,1"), (1, "calendar_dates", "a,b,3"), (None, "calendar_dates", "a,b,1"), (None, "calendar_dates", "q")], "rec_id long, file_name string, line string")
    got = sorted((tuple(r) for r in br.rejected_lines(raw, {"calendar_dates": br.LAYOUTS["calendar_dates"]}).collect()), key=repr)
    assert got == [("raw_records", 1, "bad_value"), ("raw_records", None, "column_count")]


@pytest.mark.parametrize("value,ok", [(None, True), (0.0, True), (1440.0, True), (1440.5, False), (-1.0, False), (float("nan"), False), (float("inf"), False)])
def test_stored_minutes(spark, value, ok):
    df = spark.createDataFrame([(1, value)], "rec_id long, v double")
    assert br.rejected_values(df, "v", br.is_minutes, "t").count() == (not ok)


def test_empty(spark):
    raw = spark.createDataFrame([], "rec_id long, file_name string, line string")
    assert br.rejected_lines(raw, br.LAYOUTS).count() == 0
