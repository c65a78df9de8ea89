"""Nodes outside the projection's domain are counted, and the queries agree with the SQL."""

from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry

FOLDER = "/root/testdata/sf0.01"
OUTSIDE = "select count(distinct id) from osm_node_coords where isfinite(lon) and isfinite(lat) and lon between -180 and 180 and lat between -90 and 90 and not (lon = 0 and lat = 0) and not (lon between -25 and 45 and lat between 30 and 72)"


@pytest.mark.parametrize(("name", "key", "count"), [("g_project", "x", None), ("g_grid_cells", "cell", "points"), ("g_aggregate_cells", "parent", "points"), ("g_assembled_lines", "cell", "points"), ("g_children_and_neighbours", "cell", None)])
def test_outside(spark, name, key, count):
    con = duckdb.connect()
    for p in Path(FOLDER).glob("*.parquet"):
        con.execute(f"create view {p.stem} as select * from read_parquet('{p}')")
    outside = con.execute(OUTSIDE).fetchone()[0]
    got = entry.queries()[name](spark, FOLDER).collect()
    void = [r for r in got if r[key] is None]
    assert outside > 0
    if name != "g_children_and_neighbours":
        assert (len(void) if count is None else sum(r[count] for r in void)) == outside
    cur = con.execute(entry.oracle_sql()[name])
    cols = [d[0] for d in cur.description]
    norm = lambda rows: sorted((tuple(round(v, 1) if isinstance(v, float) else v for v in r) for r in rows), key=repr)
    mine, theirs = norm(tuple(r[c] for c in cols) for r in got), norm(cur.fetchall())
    assert len(mine) == len(theirs)
    assert all(a == pytest.approx(b, abs=0.11) for a, b in zip(mine, theirs, strict=True))
