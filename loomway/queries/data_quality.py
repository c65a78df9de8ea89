"""Queries of the general data problems: orphans, intervals, bad rows, packed fields, nearby points."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomway.operators import badrows as br
from loomway.operators.intervals import periods_and_gaps, survey_minutes
from loomway.operators.nearby import containing_regions, near_pairs, usable_points
from loomway.operators.orphans import orphan_report, orphans
from loomway.operators.packed import unpack
from loomway.session import cut
from loomway.tables import table

QUERIES: dict = {}
SQL: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# --- 1: references to records that do not exist

#: (child table, its key, parent table, its key)
REFERENCES = (
    ("trips_norm", "ident_men", "q_tcm_menage", "ident_men"),
    ("k_deploc", "ident_ind", "k_individu", "ident_ind"),
    ("calendar_dates", "service_id", "calendar", "service_id"),
)

_SPACES = "chr(9)||chr(10)||chr(11)||chr(12)||chr(13)||chr(28)||chr(29)||chr(30)||chr(31)||' '||chr(133)||chr(160)||chr(8195)||chr(8199)||chr(8201)||chr(8239)||chr(12288)"


def _key(c: str) -> str:
    return f"nullif(lower(trim({c}, {_SPACES})), '')"


_P1 = " union all ".join(
    f"""select '{child}' as child_table, strftime(c.loaded_at, '%Y-%m') as period, c.rec_id,
    case when count(p.k) = 0 then 'missing' when bool_or(p.loaded_at <= c.loaded_at) then 'deleted' else 'late' end as reason
    from (select rec_id, loaded_at, {_key(ck)} as k from {child}) c left join (select loaded_at, deleted_at, {_key(pk)} as k from {parent}) p on c.k = p.k
    where c.k is not null group by c.rec_id, c.loaded_at
    having not coalesce(bool_or(p.loaded_at <= c.loaded_at and (p.deleted_at is null or p.deleted_at > c.loaded_at)), false)"""
    for child, ck, parent, pk in REFERENCES
)


@query(_P1)
def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    """Orphan references of the three tables."""
    one = lambda r: orphans(table(spark, folder, r[0], "rec_id", r[1], "loaded_at"), table(spark, folder, r[2], r[3], "loaded_at", "deleted_at"), r[1], r[3], r[0])
    # Each reference is measured before its plan is made: all of them at once.
    with ThreadPoolExecutor(len(REFERENCES)) as pool:
        return reduce(DataFrame.unionByName, pool.map(one, REFERENCES))


@query(f"select child_table, period, reason, count(*) as orphans from ({_P1}) group by all")
def p1_report(spark: SparkSession, folder: str) -> DataFrame:
    """Orphans per table, month and reason."""
    return orphan_report(p1_found(spark, folder))


# --- 2: overlapping and gapped intervals

#: Minutes of a shard of the day's axis.
SHARD_MIN = 240

_CLOCK = r"^([01]?[0-9]|2[0-3]):[0-5][0-9](:[0-5][0-9])?$"
_MIN = lambda c: f"((split_part({c}, ':', 1)::int * 60 + split_part({c}, ':', 2)::int + 1200) % 1440)"
_P2_ISLANDS = f"""with t as (select distinct day_id, {_MIN("departure_time")} as s, {_MIN("arrival_time")} as e0 from trips_norm
    where day_id is not null and regexp_full_match(departure_time, '{_CLOCK}') and regexp_full_match(arrival_time, '{_CLOCK}')),
    i as (select day_id, s, case when e0 < s then e0 + 1440 else e0 end as e from t),
    n as (select *, case when max(e) over (partition by day_id order by s, e rows between unbounded preceding and 1 preceding) >= s then 0 else 1 end as new from i),
    g as (select *, sum(new) over (partition by day_id order by s, e rows unbounded preceding) as island from n),
    p as (select day_id, min(s)::int as s, max(e)::int as e from g group by day_id, island),
    q as (select *, lag(e) over (partition by day_id order by s) as before from p)"""


@query(f"""{_P2_ISLANDS} select day_id, 'period' as kind, s as start_min, e as end_min from q
    union all select day_id, 'gap', before, s from q where before is not null""")
def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    """Travel periods of each day and the gaps between them, in minutes from 04:00."""
    trips = table(spark, folder, "trips_norm", "day_id", "departure_time", "arrival_time")
    s, e = survey_minutes(F.col("departure_time"), F.col("arrival_time"))
    out = periods_and_gaps(trips.select("day_id", s.alias("start_min"), e.alias("end_min")), "day_id", "start_min", "end_min", SHARD_MIN)
    return out.select("day_id", "kind", F.col("start_min").cast("int").alias("start_min"), F.col("end_min").cast("int").alias("end_min"))


# --- 3: rows that fail to parse


def _date_ok(c: str) -> str:
    return f"coalesce(regexp_full_match(trim({c}, {_SPACES}), '[0-9]{{8}}') and try_strptime(trim({c}, {_SPACES}), '%Y%m%d') is not null and substr(trim({c}, {_SPACES}), 1, 4) between '1900' and '2100', false)"


def _type_ok(c: str) -> str:
    return f"coalesce(trim({c}, {_SPACES}) in ('1', '2'), false)"


def _minutes_ok(c: str) -> str:
    t = f"trim({c}, {_SPACES})"
    return f"coalesce({t} = '' or (regexp_full_match({t}, '[0-9]+([.][0-9]+)?') and try_cast({t} as double) <= 1440), false)"


def _p3_file(name: str, sep: str, fields: int, place: int, ok) -> str:
    hidden = f"""array_to_string(list_transform(p, lambda x, i: case when i % 2 = 0 then replace(replace(x, '@', '@a'), '{sep}', '@s') else replace(x, '@', '@a') end), '"')"""
    field = f"string_split({hidden}, '{sep}')[{place}]"
    value = f"""replace(replace(case when starts_with({field}, '"') then replace(substr({field}, 2, length({field}) - 2), '""', '"') else {field} end, '@s', '{sep}'), '@a', '@')"""
    return f"""select rec_id, case when len(p) % 2 = 0 or len(list_filter(p, lambda x, i: i % 2 = 1 and x <> '' and not ((i = 1 or starts_with(x, '{sep}')) and (i = len(p) or ends_with(x, '{sep}'))))) > 0 then 'quoting'
      when 1 + list_sum(list_transform(p, lambda x, i: case when i % 2 = 1 then length(x) - length(replace(x, '{sep}', '')) else 0 end)) <> {fields} then 'column_count'
      when not ({ok(value)}) then 'bad_value' end as reason
      from (select rec_id, string_split(regexp_replace(coalesce(line, ''), '\\r$', ''), '"') as p from raw_records where file_name = '{name}')"""


_P3 = f"""select 'raw_records' as src_table, rec_id, reason from (
    {_p3_file("calendar", ",", 10, 9, _date_ok)} union all {_p3_file("calendar_dates", ",", 3, 3, _type_ok)} union all {_p3_file("trips_norm", ";", 8, 6, _minutes_ok)}) where reason is not null
    union all select 'calendar', rec_id, 'bad_value' from calendar where not {_date_ok("start_date")}
    union all select 'calendar_dates', rec_id, 'bad_value' from calendar_dates where not {_type_ok("exception_type")}
    union all select 'trips_norm', rec_id, 'bad_value' from trips_norm where not (duration_min is null or (isfinite(duration_min) and duration_min between 0 and 1440))"""

STORED_RULES = (("calendar", "start_date", br.is_date8), ("calendar_dates", "exception_type", br.is_exception_type), ("trips_norm", "duration_min", br.is_minutes))


@query(_P3)
def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    """Lines and stored values that can't be read as what they should be."""
    raw = table(spark, folder, "raw_records", "rec_id", "file_name", "line")
    found = [br.rejected_lines(raw, br.LAYOUTS)]
    found += [br.rejected_values(table(spark, folder, t, "rec_id", c), c, rule, t) for t, c, rule in STORED_RULES]
    return reduce(DataFrame.unionByName, found)


@query(f"select src_table, reason, count(*) as rows from ({_P3}) group by all")
def p3_report(spark: SparkSession, folder: str) -> DataFrame:
    """Rejected rows per table and reason."""
    return p3_found(spark, folder).groupBy("src_table", "reason").agg(F.count("*").alias("rows"))


@query(
    f"""with bad as (select rec_id from ({_p3_file("calendar", ",", 10, 9, _date_ok)}) where reason is not null)
    select r.rec_id, length(r.line) as n_chars from raw_records r where r.file_name = 'calendar' and not exists (select 1 from bad b where b.rec_id = r.rec_id)"""
)
def p3_loaded_calendar(spark: SparkSession, folder: str) -> DataFrame:
    """The lines of the calendar file that load, by the strict load alone."""
    raw = table(spark, folder, "raw_records", "rec_id", "file_name", "line").where("file_name = 'calendar'")
    return br.strict_load(raw, br.LAYOUTS["calendar"]).select("rec_id", F.length("_line").cast("long").alias("n_chars"))


# --- 5: several values packed in one field

#: (table, column, whether blanks belong to items)
PACKED = (("pt_openings_mapping", "candidate_route_ids", True), ("pt_openings_mapping", "candidate_refs", True), ("gtfs_multiple_resources", "resource_ids", False))


_QUOTED = '"(?:[^"]|"")*(?:"|$)'


def items_sql(table_: str, column: str, blanks: bool, keys: str = "rec_id") -> str:
    """(keys, pos, item): quoted parts as they are, separators as a control character, and the rest split at it."""
    ordinary = r"[\p{L}\p{N}:\-+._" + (" " if blanks else "") + "]+"
    text = rf"""array_to_string(list_transform(regexp_extract_all({column}, '{_QUOTED}|{ordinary}|[\s\S]', 0), lambda x: case when not starts_with(x, '"') then case when regexp_full_match(x, '{ordinary}') then x else chr(1) end
      when (length(x) - length(replace(x, '"', ''))) % 2 = 0 then replace(substr(x, 2, length(x) - 2), '""', '"') else replace(substr(x, 2), '""', '"') end), '')"""
    return f"""(select {keys}, generate_subscripts(items, 1)::int as pos, unnest(items) as item from (select {keys}, list_filter(list_transform(string_split({text}, chr(1)), lambda x: trim(x, {_SPACES})), lambda x: x <> '') as items from {table_} where {column} is not null))"""


_P5 = " union all ".join(f"select '{t}' as src_table, rec_id, '{c}' as field, pos, item from {items_sql(t, c, blanks)}" for t, c, blanks in PACKED)


@query(_P5)
def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    """Identifiers of the packed fields, one row per place."""
    parts = [
        unpack(table(spark, folder, t, "rec_id", c), c, ["rec_id"], blanks).select(F.lit(t).alias("src_table"), "rec_id", F.lit(c).alias("field"), "pos", "item")
        for t, c, blanks in PACKED
    ]
    return reduce(DataFrame.unionByName, parts)


@query(
    f"""select rec_id, gtfs_resource_count, coalesce(n, 0)::bigint as items from gtfs_multiple_resources left join (select rec_id, count(*) as n from {items_sql("gtfs_multiple_resources", "resource_ids", False)} group by 1) using (rec_id)
    where gtfs_resource_count is distinct from coalesce(n, 0)"""
)
def p5_count_check(spark: SparkSession, folder: str) -> DataFrame:
    """Stored rows whose stated number of resources differs from the items found."""
    rows = table(spark, folder, "gtfs_multiple_resources", "rec_id", "resource_ids", "gtfs_resource_count")
    n = unpack(rows, "resource_ids", ["rec_id"], False).groupBy("rec_id").agg(F.count("*").alias("items"))
    found = rows.select("rec_id", "gtfs_resource_count").join(n, "rec_id", "left").withColumn("items", F.coalesce("items", F.lit(0).cast("long")))
    return found.where(~F.col("gtfs_resource_count").eqNullSafe(F.col("items")))


# --- 6: points near other points or regions

NEAR_M = 25.0

_P6_NODES = "select id, min(lon) as lon, min(lat) as lat from osm_node_coords where isfinite(lon) and isfinite(lat) and lon between -180 and 180 and lat between -90 and 90 and not (lon = 0 and lat = 0) group by id"
_P6_EDGES = r"""rings as (select siren::bigint as siren, r.ring, r.no from (select siren, unnest(list_zip(regexp_extract_all(geom, '\(([^()]+)\)', 1), range(len(regexp_extract_all(geom, '\(([^()]+)\)', 1))))) as z from epci_polygons where geom is not null) as q, lateral (select z[1] as ring, z[2] as no) as r),
    pts as (select siren, no, i, split_part(trim(t), ' ', 1)::double as x, split_part(trim(t), ' ', 2)::double as y, count(*) over (partition by siren, no) as m from (select siren, no, unnest(string_split(ring, ',')) as t, generate_subscripts(string_split(ring, ','), 1) as i from rings)),
    edges as (select a.siren, a.x as x1, a.y as y1, b.x as x2, b.y as y2 from pts a join pts b on a.siren = b.siren and a.no = b.no and b.i = a.i % a.m + 1 where a.x <> b.x)"""


@query(
    f"""with nodes as ({_P6_NODES}), {_P6_EDGES}
    select 'near' as kind, a.id as id_a, b.id as id_b from nodes a join nodes b on a.id < b.id and b.lat between a.lat - 0.00023 and a.lat + 0.00023
    where 2 * 6371008.8 * asin(least(1, sqrt(pow(sin(radians(b.lat - a.lat) / 2), 2) + cos(radians(a.lat)) * cos(radians(b.lat)) * pow(sin(radians(b.lon - a.lon) / 2), 2)))) <= 25
    union all select 'inside', siren, id from edges e join nodes n on n.lon >= least(x1, x2) and n.lon < greatest(x1, x2) and n.lat > y1 + (n.lon - x1) * (y2 - y1) / (x2 - x1)
    group by siren, id having count(*) % 2 = 1"""
)
def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs of nodes at most 25 m apart, and the nodes of each region."""
    nodes = cut(usable_points(table(spark, folder, "osm_node_coords", "id", "lon", "lat")))  # read for the crowded cells, twice for the pairs, and for the regions
    near = near_pairs(nodes, NEAR_M).select(F.lit("near").alias("kind"), "id_a", "id_b")
    inside = containing_regions(nodes, table(spark, folder, "epci_polygons", "siren", "geom"), "siren", "geom")
    return near.unionByName(inside.select(F.lit("inside").alias("kind"), F.col("region").alias("id_a"), F.col("id").alias("id_b")))
