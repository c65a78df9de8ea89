"""Boxes of any width keep their nodes, by the SQL and, where they are wide, by brute force."""

import math
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry

FOLDER = "/root/testdata/sf0.1"


@pytest.mark.parametrize("name", ["g_box_join", "g_segment_distance"])
def test_boxes_against_sql_and_brute_force(spark, name):
    con = duckdb.connect()
    for p in Path(FOLDER).glob("*.parquet"):
        con.execute(f"create view {p.stem} as select * from read_parquet('{p}')")
    got = {r.siren: tuple(r)[1:] for r in entry.queries()[name](spark, FOLDER).collect()}
    sql = {r[0]: r[1:] for r in con.execute(entry.oracle_sql()[name]).fetchall()}
    nodes = con.execute("select min(struct_pack(lon := lon, lat := lat)) from osm_node_coords where isfinite(lon) and isfinite(lat) and lon between -180 and 180 and lat between -90 and 90 and not (lon = 0 and lat = 0) group by id").fetchall()
    wide = {}
    for siren, a, b, c, d in con.execute("select siren, xmin, ymin, xmax, ymax from epci_polygons where isfinite(xmin) and isfinite(xmax) and xmax - xmin >= 3").fetchall():
        inside = [(n["lon"], n["lat"]) for (n,) in nodes if a <= n["lon"] <= c and b <= n["lat"] <= d]
        if inside and name == "g_box_join":
            wide[siren] = (len(inside), min(math.hypot(x - (a + c) / 2, y - (b + d) / 2) for x, y in inside))
        elif inside:
            t = lambda x, y: max(0.0, min(1.0, ((x - a) * (c - a) + (y - b) * (d - b)) / ((c - a) ** 2 + (d - b) ** 2)))  # noqa: B023, E731
            wide[siren] = (min(math.hypot(x - a - t(x, y) * (c - a), y - b - t(x, y) * (d - b)) for x, y in inside),)
    assert wide and set(got) == set(sql) >= set(wide)
    for siren, want in [*sql.items(), *wide.items()]:
        assert got[siren] == pytest.approx(want, abs=2e-9), siren
