"""Service calendars, patterns, route matching over parameter grids, openings, and spatial operators."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomway.functions import grid as gr
from loomway.functions.exprs import finite, norm_key, safe_div
from loomway.functions.modes import route_type_family
from loomway.functions.text import EXPRESS_WORDS, LETTER_SIGNS, LINE_LETTERS, LINE_WORDS, is_express_bus, normalise_ref, normalise_text
from loomway.operators import chains, feeds, legs
from loomway.operators.nearby import usable_points
from loomway.operators.packed import unpack
from loomway.operators.relational import band_join, first_per_key
from loomway.queries.base import TRIPS, key_sql, registry, trips
from loomway.queries.data_quality import items_sql
from loomway.queries.survey import _MODE
from loomway.session import cut
from loomway.tables import table

QUERIES, SQL, query = registry()

# --- service calendars

_DAY8 = lambda c: f"case when regexp_full_match({c}, '[0-9]{{8}}') then try_strptime({c}, '%Y%m%d')::date end"
_CAL = f"""cal as (select * from (select {key_sql("service_id")} as sid, *, {_DAY8("start_date")} as d0, {_DAY8("end_date")} as d1, row_number() over (partition by {key_sql("service_id")} order by rec_id) as rn from calendar where deleted_at is null and {key_sql("service_id")} is not null) where rn = 1 and d0 is not null and d1 is not null),
    exc as (select distinct {key_sql("service_id")} as sid, {_DAY8("exception_date")} as day, exception_type from calendar_dates where {key_sql("service_id")} is not null)"""
_DAY = date(2023, 5, 17)


def _calendar(spark: SparkSession, folder: str) -> DataFrame:
    """Services that were not withdrawn, once each, with readable dates."""
    c = table(spark, folder, "calendar").where("deleted_at is null").withColumn("service_id", norm_key(F.col("service_id"))).where("service_id is not null")
    c = first_per_key(c, ["service_id"], ["rec_id"])
    return c.where(F.col("start_date").rlike(r"\A[0-9]{8}\z") & F.col("end_date").rlike(r"\A[0-9]{8}\z") & feeds.day8(F.col("start_date")).isNotNull() & feeds.day8(F.col("end_date")).isNotNull())


def _exceptions(spark: SparkSession, folder: str) -> DataFrame:
    day = F.when(F.col("exception_date").rlike(r"\A[0-9]{8}\z"), feeds.day8(F.col("exception_date")))
    e = table(spark, folder, "calendar_dates").select(norm_key(F.col("service_id")).alias("service_id"), day.alias("day"), "exception_type")
    return e.where("service_id is not null").distinct()


@query(f"with {_CAL} select sid as service_id from (select sid from cal where wednesday = '1' and date '{_DAY}' between d0 and d1 and sid not in (select sid from exc where day = date '{_DAY}' and exception_type = '2') union select sid from exc where day = date '{_DAY}' and exception_type = '1')")
def t_active_services(spark: SparkSession, folder: str) -> DataFrame:
    """Services of one day."""
    return feeds.active_services(_calendar(spark, folder), _exceptions(spark, folder), _DAY)


_WD = "case isodow(day) " + " ".join(f"when {i + 1} then {d}" for i, d in enumerate(feeds.WEEKDAYS)) + " end"
_SERVICE_DAYS = f"{_CAL}, reg as (select sid, day from (select *, unnest(generate_series(d0, d1, interval 1 day))::date as day from cal where d0 <= d1) where {_WD} = '1'), sd as (select sid, day from reg r where not exists (select 1 from exc e where e.sid = r.sid and e.day = r.day and e.exception_type = '2') union select sid, day from exc where exception_type = '1' and day is not null)"


@query(f"with {_SERVICE_DAYS} select sid as service_id, min(day) as first_day, max(day) as last_day, count(*) as days, max(day) < date '{_DAY}' as expired from sd group by 1")
def t_service_bounds(spark: SparkSession, folder: str) -> DataFrame:
    """First and last day of each service in effect, and whether it has expired."""
    sd = feeds.service_days(_calendar(spark, folder), _exceptions(spark, folder))
    return sd.groupBy("service_id").agg(F.min("day").alias("first_day"), F.max("day").alias("last_day"), F.count("*").alias("days"), (F.max("day") < F.lit(_DAY)).alias("expired"))


@query(f"with {_SERVICE_DAYS} select year(day)::int as year, isodow(day)::int as weekday, count(*) as service_days, count(distinct sid) as services from sd group by all")
def t_service_calendar_mix(spark: SparkSession, folder: str) -> DataFrame:
    """Service days by year and weekday."""
    sd = feeds.service_days(_calendar(spark, folder), _exceptions(spark, folder))
    return sd.groupBy(F.year("day").alias("year"), (F.weekday("day") + 1).cast("int").alias("weekday")).agg(F.count("*").alias("service_days"), F.count_distinct("service_id").alias("services"))


@query("""select 'osm_node_coords' as feed, count(*) as rows, count(distinct id) as points, min(lon) filter (where isfinite(lon)) as west, min(lat) filter (where isfinite(lat)) as south, max(lon) filter (where isfinite(lon)) as east, max(lat) filter (where isfinite(lat)) as north,
    coalesce(min(lon) filter (where isfinite(lon)) >= -180 and max(lon) filter (where isfinite(lon)) <= 180 and min(lat) filter (where isfinite(lat)) >= -90 and max(lat) filter (where isfinite(lat)) <= 90, false) as within_bounds from osm_node_coords""")
def t_feed_triage(spark: SparkSession, folder: str) -> DataFrame:
    """Counts and extent of a feed's points, and whether they can be degrees."""
    n = table(spark, folder, "osm_node_coords", "id", "lon", "lat")
    lon, lat = F.when(finite(F.col("lon")), F.col("lon")), F.when(finite(F.col("lat")), F.col("lat"))
    ok = (F.min(lon) >= -180) & (F.max(lon) <= 180) & (F.min(lat) >= -90) & (F.max(lat) <= 90)
    return n.agg(F.lit("osm_node_coords").alias("feed"), F.count("*").alias("rows"), F.count_distinct("id").alias("points"), F.min(lon).alias("west"), F.min(lat).alias("south"), F.max(lon).alias("east"), F.max(lat).alias("north"), F.coalesce(ok, F.lit(False)).alias("within_bounds"))


# --- patterns and matching: a day's chain of trips stands for a route's chain of stops

_CHAIN = f"{TRIPS}, ch as (select *, {_MODE} as mode_group, row_number() over (partition by day_id order by num_dep, ident_dep) as ordinal from trips where num_dep is not null)"


def _chain(spark: SparkSession, folder: str) -> DataFrame:
    t = legs.classify(trips(spark, folder)).where("num_dep is not null")
    return t.withColumn("ordinal", F.row_number().over(W.partitionBy("day_id").orderBy("num_dep", "ident_dep")))


@query(f"with {_CHAIN}, per as (select day_id, list(coalesce(destination_purpose, '') order by ordinal) as seq from ch group by 1) select array_to_string(seq, '>') as sequence, count(*) as chains, len(seq)::int as stops from per group by seq")
def t_patterns(spark: SparkSession, folder: str) -> DataFrame:
    """Distinct ordered sequences, with their number of chains."""
    c = _chain(spark, folder).withColumn("item", F.coalesce("destination_purpose", F.lit("")))
    p = feeds.patterns(c, ["day_id"], ["ordinal"], "item")
    return p.select(F.array_join("sequence", ">").alias("sequence"), "chains", F.size("sequence").alias("stops"))


@query(f"with {_CHAIN}, per as (select day_id, list(mode_group order by ordinal) as seq from ch group by 1), pat as (select seq, count(*) as chains from per group by 1), st as (select seq, unnest(seq) as stop, generate_subscripts(seq, 1) as i, chains from pat) select stop, i::int as stop_sequence, sum(chains)::bigint as chains, count(*) as patterns from st group by all")
def t_pattern_stops(spark: SparkSession, folder: str) -> DataFrame:
    """Patterns expanded to their stops, by place."""
    p = feeds.patterns(_chain(spark, folder), ["day_id"], ["ordinal"], "mode_group")
    return feeds.expand_pattern(p, "chains").groupBy("stop", "stop_sequence").agg(F.sum("chains").alias("chains"), F.count("*").alias("patterns"))


@query(f"with {_CHAIN}, per as (select day_id, any_value(survey) as survey, count(*) as n, list(mode_group order by ordinal) as seq from ch group by 1), pat as (select survey, n, array_to_string(seq, '>') as pattern, count(*) as chains from per group by all) select survey, n as length, pattern, chains from (select *, row_number() over (partition by survey, n order by chains desc, pattern) as rn from pat) where rn = 1")
def t_main_pattern(spark: SparkSession, folder: str) -> DataFrame:
    """The pattern most chains of a survey and length run."""
    c = _chain(spark, folder)
    seq = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "mode_group"))), lambda s: s["mode_group"]), ">")
    pat = c.groupBy("day_id").agg(F.min("survey").alias("survey"), F.count("*").alias("length"), seq.alias("pattern")).groupBy("survey", "length", "pattern").agg(F.count("*").alias("chains"))
    return first_per_key(pat, ["survey", "length"], [F.col("chains").desc(), "pattern"])


_COVERED = "coalesce(mobloc = 1 and destination_purpose is not null, false)"


@query(
    f"""with {_CHAIN}, f as (select day_id, ordinal - 1 as pos, {_COVERED} as c from ch), s as (select day_id, count(*) as n, count(*) filter (where c) as matched, min(pos) filter (where c) as f, max(pos) filter (where c) as l from f group by 1),
    g as (select day_id, c, min(pos) as a, max(pos) as z from (select *, row_number() over (partition by day_id order by pos) - row_number() over (partition by day_id, c order by pos) as g from f) group by day_id, c, g),
    o as (select *, matched / n as share, matched / n < 0.4 or f is null as dropped, case when f >= 2 then f else 0 end as s0, case when n - 1 - l >= 2 then l else n - 1 end as e0 from s),
    gap as (select g.day_id, max(least(z, e0) - greatest(a, s0) + 1) as gap from g join o using (day_id) where not c group by 1)
    select day_id, n, matched, round(share, 8) as share, case when dropped then 'dropped' when s0 = 0 and e0 = n - 1 then 'kept' else 'cut' end as outcome, case when dropped then 0 else s0 end::bigint as start, case when dropped then n - 1 else e0 end::bigint as "end", not dropped and coalesce(gap >= 2, false) as flagged from o left join gap using (day_id)"""
)
def t_cut_ends(spark: SparkSession, folder: str) -> DataFrame:
    """Chains rated by covered elements: dropped, cut at the ends or kept, with inner gaps flagged."""
    c = _chain(spark, folder).select("day_id", (F.col("ordinal") - 1).alias("pos"), F.coalesce((F.col("mobloc") == 1) & F.col("destination_purpose").isNotNull(), F.lit(False)).alias("hit"))
    return chains.cut_ends(c, ["day_id"], "pos", "hit", 0.4, 2).withColumn("share", F.round("share", 8))


#: The calibration grid: its shares, k and theta are fixed values; minutes stand for its radii of 25, 50 and 100 m, and the dates lie within and after the loads.
GRID = {"dates": (date(2008, 1, 1), date(2019, 1, 1), date(2021, 1, 1)), "radii": (0.0, 1.0, 5.0), "shares": (0.3, 0.5, 0.7), "ks": (1, 2, 3), "thetas": (0.5, 0.6, 0.7, 0.8, 0.9)}

_VALUES = lambda name, kind: "(select unnest([" + ", ".join(f"date '{v}'" if kind == "date" else str(v) for v in GRID[name]) + f"])::{kind} as v)"
_T17 = f"""{_CHAIN}, stops as (select survey as network, day_id as pattern_id, case mode_group when 'urban_pt' then 'tram' when 'train' then 'rail' else 'bus' end as smode, coalesce(is_loop_trip, false) as sexpress, ordinal, mode_group, mobloc, duration_min, loaded_at, case when departure_s is not null and arrival_s is not null and isfinite(duration_min) then abs(((arrival_s - departure_s) % 86400 + 86400) % 86400 / 60.0 - duration_min) end as d from ch),
    meta as (select network, pattern_id, min(smode) as mode, bool_or(sexpress) as express, count(*) as n from stops group by all), dt as (select v as date from {_VALUES("dates", "date")}), r as (select v as r from {_VALUES("radii", "double")}), s as (select v as share from {_VALUES("shares", "double")}), k as (select v as k from {_VALUES("ks", "int")}), t as (select v as theta from {_VALUES("thetas", "double")}),
    dated as (select * from stops, dt where loaded_at < date),
    names as (select date, network, pattern_id, mode_group as relation_id, count(*) as affiliation from dated where duration_min > 20 group by all),
    hit as (select distinct date, network, pattern_id, ordinal, mode_group as relation_id, mode, r from dated join meta using (network, pattern_id), r where mobloc = 1 and d <= r),
    cov as (select date, network, pattern_id, r, relation_id, count(distinct ordinal) / any_value(n) as cs from hit join meta using (network, pattern_id) group by all),
    named as (select date, network, pattern_id, relation_id from (select *, max(affiliation) over (partition by date, network, pattern_id) as best from names) where affiliation = best),
    name_hits as (select date, network, pattern_id, r, count(distinct ordinal) as c from hit join named using (date, network, pattern_id, relation_id) group by all),
    wn as (select distinct date, network, pattern_id, r.r from named join meta using (network, pattern_id) cross join r left join name_hits nh using (date, network, pattern_id, r) where mode not in ('bus', 'ferry') or coalesce(c / n, 0) >= 0.3),
    bn as (select date, network, pattern_id, r, share, relation_id from named join wn using (date, network, pattern_id), s),
    fr as (select cov.*, share from cov anti join wn using (date, network, pattern_id, r), s where cs >= share),
    bg as (select date, network, pattern_id, r, share, relation_id from (select *, max(cs) over (partition by date, network, pattern_id, r, share) as best from fr) where cs = best),
    mt as (select *, 'name' as way from bn union all select *, 'geometry' from bg), md as (select date, network, pattern_id, r, share, min(way) as way from mt group by all),
    pt as (select * from meta cross join dt cross join r cross join s left join md using (date, network, pattern_id, r, share)),
    st as (select date, network, r, share, count(way) * 2 >= count(*) as testable from pt group by all),
    own as (select date, network, pattern_id, r, share, count(distinct ordinal) as c, min(ordinal) as f, max(ordinal) as l from hit join mt using (date, network, pattern_id, r, relation_id) group by all),
    rail as (select date, network, pattern_id, r, ordinal, true as track from hit where mode in ('tram', 'metro', 'rail') union all select date, network, pattern_id, r, ordinal, false from dated join meta using (network, pattern_id), r where mobloc = 0 and d <= r and mode in ('tram', 'metro', 'rail')),
    tr as (select date, network, pattern_id, r, count(distinct ordinal) filter (where track) as c, min(ordinal) filter (where track) as f, max(ordinal) filter (where track) as l, count(distinct ordinal) as wc, min(ordinal) as wf, max(ordinal) as wl from rail group by all),
    en as (select pt.*, mode in ('tram', 'metro', 'rail') as g, g or (mode = 'bus' and express) as strict, {", ".join(f"case when g and way is not null then tr.{c} when g then tr.w{c} else own.{c} end as {c}{'0' if c == 'c' else ''}" for c in "cfl")} from pt left join own using (date, network, pattern_id, r, share) left join tr using (date, network, pattern_id, r)),
    bo as (select date, network, pattern_id, mode, r, share, k, n, way, strict, coalesce(c0, 0) as covered, testable, case when strict and coalesce(f - 1, n) >= k then coalesce(f, n + 1) else 1 end as s0, case when strict and coalesce(n - l, n) >= k then coalesce(l, 0) else n end as e0 from en join st using (date, network, r, share), k),
    oc as (select date, network, pattern_id, mode, r, share, k, theta, n, covered, s0::bigint as start_idx, e0::bigint as end_idx, case when not testable then 'not-testable' when not strict then case when covered / n >= 0.5 then case when way = 'geometry' then 'kept-renamed' else 'kept' end else 'dropped' end
      when greatest(0, e0 - s0 + 1) < 2 or coalesce(covered / nullif(greatest(0, e0 - s0 + 1), 0), 0) < theta then 'dropped' when e0 - s0 + 1 < n then 'cut' when way = 'geometry' then 'kept-renamed' else 'kept' end as outcome from bo, t)"""


@query(f"with {_T17} select * from oc")
def t_grid_evaluation(spark: SparkSession, folder: str) -> DataFrame:
    """All chains at all 405 points of the grid of date, radius, share, k and theta, in one plan.

    On a date there is what was loaded before it.
    """
    c = _chain(spark, folder)
    mode = F.when(F.col("mode_group") == "urban_pt", "tram").when(F.col("mode_group") == "train", "rail").otherwise("bus")
    gap = F.abs(F.pmod(F.col("arrival_s") - F.col("departure_s"), F.lit(86400)) / 60.0 - F.when(finite(F.col("duration_min")), F.col("duration_min")))
    base = cut(c.select(F.col("survey").alias("network"), F.col("day_id").alias("pattern_id"), "ordinal", mode.alias("smode"), F.coalesce("is_loop_trip", F.lit(False)).alias("express"), F.col("mode_group").alias("relation_id"), (F.col("mobloc") == 1).alias("in_service"), (F.col("mobloc") == 0).alias("is_fallback"), gap.alias("distance_m"), "duration_min", "loaded_at"))
    one = base.groupBy("network", "pattern_id").agg(F.min("smode").alias("mode"))
    stops = base.select("network", "pattern_id", "ordinal", "express").join(one, ["network", "pattern_id"])
    dated = base.crossJoin(F.broadcast(spark.createDataFrame([(d,) for d in GRID["dates"]], "date date"))).where(F.col("loaded_at") < F.col("date"))
    names = dated.where("duration_min > 20").groupBy("date", "network", "pattern_id", "relation_id").agg(F.count("*").alias("affiliation"))
    return feeds.evaluate_grid(stops, dated.where("distance_m is not null"), names, **GRID)


@query(
    f"""with {_T17}, sc as (select mode, r, share, k, theta, count(*) filter (where outcome in ('kept', 'kept-renamed', 'cut') and n > 3) as tp, count(*) filter (where outcome in ('kept', 'kept-renamed', 'cut') and n <= 3) as fp, count(*) filter (where outcome not in ('kept', 'kept-renamed', 'cut') and n > 3) as fn, count(*) filter (where outcome not in ('kept', 'kept-renamed', 'cut') and n <= 3) as tn, count(*) filter (where outcome = 'cut' and n <= 3) / nullif(count(*) filter (where n <= 3), 0) as fc from oc group by all), v as (select *, round(2 * tp / nullif(2 * tp + fp + fn, 0), 8) as f1, round(fc, 8) as false_change_rate from sc)
    select mode, r, share, k, theta, tp, fp, fn, tn, f1, false_change_rate, row_number() over (partition by mode order by tp desc, f1 desc nulls last, false_change_rate nulls first, r, share, k, theta)::int as place from v"""
)
def t_grid_scores(spark: SparkSession, folder: str) -> DataFrame:
    """Points of the grid for each mode, over all dates: known lines that stay, F1, and the share of others that change; ranked by these, then by smaller parameters.

    The tables have no known cases: chains of more than three trips stand for lines that must stay.
    """
    point = ("r", "share", "k", "theta")
    o = t_grid_evaluation(spark, folder)
    stays, known = F.col("outcome").isin("kept", "kept-renamed", "cut"), F.col("n") > 3
    sc = feeds.scores(stays, known)
    changed = safe_div(F.count_if(~known & (F.col("outcome") == "cut")), F.count_if(~known))
    g = o.groupBy("mode", *point).agg(*(sc[x].alias(x) for x in ("tp", "fp", "fn", "tn")), F.round(sc["f1"], 8).alias("f1"), F.round(changed, 8).alias("false_change_rate"))
    # 135 points for each mode.
    best = W.partitionBy("mode").orderBy(F.col("tp").desc(), F.col("f1").desc_nulls_last(), F.col("false_change_rate").asc_nulls_first(), *point)
    return g.withColumn("place", F.row_number().over(best))


# --- text keys, openings and edits

_FOLD = lambda c: f"lower(strip_accents(coalesce({c}, '')))"
_TEXT = lambda c: f"regexp_replace({_FOLD(c)}, '[^a-z0-9]+', '', 'g')"
_LEFT = lambda c: f"ltrim({c}, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))"


def _ref_sql(c: str) -> str:
    """normalise_ref() as nested selects of one value."""
    word = "case " + " ".join(f"when starts_with(t, '{w}') then {_LEFT(f'substr(t, {len(w) + 1})')}" for w in LINE_WORDS) + " else t end"
    sign = f"case when substr(r, 1, 1) in {LETTER_SIGNS} then {_LEFT('substr(r, 2)')} else r end"
    return f"""(select regexp_replace(case when substr(t, 1, 1) in {LINE_LETTERS} and regexp_matches(z, '^[a-z0-9]') then z else t end, '[^a-z0-9]+', '', 'g')
      from (select t, {sign} as z from (select t, {_LEFT("substr(t, 2)")} as r from (select {word} as t from (select {_LEFT(_FOLD(c))} as t)))))"""


@query(f"select rec_id, {_TEXT('network')} as network_key, {_TEXT('section_from')} as from_key, {_ref_sql('line_2026')} as line_key, regexp_matches(regexp_replace({_FOLD('concat_ws(chr(32), line_2026, mode, notes)')}, '[^a-z0-9]+', '', 'g'), '{"|".join(EXPRESS_WORDS)}') as express from pt_openings_mapping")
def t_text_keys(spark: SparkSession, folder: str) -> DataFrame:
    """Normalised names and line references, and the express bus rule."""
    o = table(spark, folder, "pt_openings_mapping")
    return o.select("rec_id", normalise_text(F.col("network")).alias("network_key"), normalise_text(F.col("section_from")).alias("from_key"), normalise_ref(F.col("line_2026")).alias("line_key"), is_express_bus(F.col("line_2026"), F.col("mode"), F.col("notes")).alias("express"))


#: Mode families of an opening's mode (fixed values).
_FAMILIES = {"metro": ["metro"], "tram": ["tram"], "tram_train": ["tram", "rail"], "cable": ["metro"], "rail": ["rail"], "bus": ["bus"], "bhns": ["bus"], "trolleybus": ["bus"], "ferry": ["ferry"]}


_FAMILY_SQL = "case lower(trim(mode)) " + " ".join(f"when '{m}' then {f!r}" for m, f in _FAMILIES.items()) + " end"
_ANY_NAME = lambda h: f"len(list_filter(c.names, lambda n: contains(n, {h}))) > 0"


@query(
    f"""with o as (select rec_id, coalesce(opening_id, rec_id::varchar) as opening, {_TEXT("network")} as network, {_ref_sql("line_2026")} as key, {_FAMILY_SQL} as families, list_distinct(list_filter([{_TEXT("section_from")}, {_TEXT("section_to")}], lambda x: x <> '')) as hints, candidate_refs from pt_openings_mapping),
    c as (select rec_id as candidate, opening, network, families, hints as names, candidate_refs from (select *, row_number() over (partition by opening order by rec_id) as rn from o where network <> '') where rn = 1),
    refs as (select network, key, opening, min(pos) as pos from (select network, opening, pos, {_ref_sql("item")} as key from {items_sql("c", "candidate_refs", True, "network, opening")}) where key <> '' group by all),
    named as (select o.rec_id, {{'candidate': c.candidate, 'pos': refs.pos}} as pick, o.opening <> c.opening and len(list_filter(o.hints, lambda h: {_ANY_NAME("h")})) > 0 as by_stop from o join refs using (network, key) join c on c.opening = refs.opening),
    per as (select rec_id, count(*) as n, min(pick) as one, count(*) filter (where by_stop) as n_stop, min(pick) filter (where by_stop) as stop from named group by 1),
    b as (select o.*, coalesce(n, 0) as n, one, coalesce(n_stop, 0) as n_stop, stop from o left join per using (rec_id)),
    e as (select b.rec_id, count(*) as n_all, min(c.candidate) as pick from b join c on c.network = b.network and c.opening <> b.opening and list_has_any(b.families, c.families) where n <> 1 and n_stop <> 1 and len(hints) > 0 and len(list_filter(b.hints, lambda h: not ({_ANY_NAME("h")}))) = 0 group by 1)
    select rec_id, network, key, case when n = 1 then one.candidate when n_stop = 1 then stop.candidate when n_all = 1 then pick end as candidate, case when n = 1 then one.pos when n_stop = 1 then stop.pos end as pos, case when n = 1 then 'exact' when n_stop = 1 or coalesce(n_all = 1, false) then 'stop-confirmed' when n > 1 then 'ambiguous' else 'none' end as how from b left join e using (rec_id)"""
)
def t_opening_matches(spark: SparkSession, folder: str) -> DataFrame:
    """Every line with the opening of its network that has its reference, by name, by any stop hint or by all hints in its mode.

    The tables have no stops of routes: an opening's section ends stand for them.
    """
    o = table(spark, folder, "pt_openings_mapping", "rec_id", "opening_id", "network", "mode", "line_2026", "section_from", "section_to", "candidate_refs")
    mode = F.lower(F.trim("mode"))
    families = F.coalesce(*(F.when(mode == m, F.array(*map(F.lit, f))) for m, f in _FAMILIES.items()))
    ends = F.array_distinct(F.filter(F.array(normalise_text(F.col("section_from")), normalise_text(F.col("section_to"))), lambda x: x != ""))
    o = o.select("rec_id", F.coalesce("opening_id", F.col("rec_id").cast("string")).alias("opening"), normalise_text(F.col("network")).alias("network"), normalise_ref(F.col("line_2026")).alias("key"), families.alias("families"), ends.alias("hints"), "candidate_refs")
    # An opening may be stored twice: it is one candidate.
    first = first_per_key(o.where("network != ''"), ["opening"], ["rec_id"])
    items = unpack(first, "candidate_refs", ["network", "opening"], True).select("network", normalise_ref(F.col("item")).alias("key"), "opening", "pos").where("key != ''")
    refs = items.groupBy("network", "key", "opening").agg(F.min("pos").alias("pos"))
    return feeds.match_openings(o.drop("candidate_refs"), first.select("opening", "network", "families", F.col("hints").alias("names"), F.col("rec_id").alias("candidate")), refs)


@query(
    f"""with o as (select rec_id, {_ref_sql("line_2026")} as key, {_TEXT("network")} as network from pt_openings_mapping), r as (select rec_id as relation, {_ref_sql("item")} as key, network from {items_sql(f"(select rec_id, {_TEXT('network')} as network, candidate_refs from pt_openings_mapping)", "candidate_refs", True, "rec_id, network")}),
    own as (select key, network, count(distinct relation) as n, min(relation) as first from r where key <> '' group by all), every as (select key, count(distinct relation) as n, min(relation) as first from r where key <> '' group by 1)
    select o.rec_id as line, case when own.n is not null then 1 when every.n is not null then 0 end as affiliation, coalesce(own.n, every.n, 0) as relations, coalesce(own.first, every.first) as first from o left join own on own.key = o.key and own.network = o.network left join every on every.key = o.key"""
)
def t_name_matches(spark: SparkSession, folder: str) -> DataFrame:
    """References of openings that a line's own has, within its network before others; an opening's references stand for relations."""
    o = table(spark, folder, "pt_openings_mapping", "rec_id", "network", "line_2026", "candidate_refs").withColumn("network", normalise_text(F.col("network")))
    lines = o.select(F.col("rec_id").alias("line"), normalise_ref(F.col("line_2026")).alias("key"), "network")
    relations = unpack(o, "candidate_refs", ["rec_id", "network"], True).select(F.col("rec_id").alias("relation"), normalise_ref(F.col("item")).alias("key"), "network")
    return feeds.name_matches(lines, relations)


@query(
    """with m as (select network, lower(trim(mode)) as mode, case match_confidence when 'exact' then 3 when 'stop-confirmed' then 2 when 'ambiguous' then 1 else 0 end as score, rec_id from pt_openings_mapping where network is not null),
    b as (select *, max(score) over (partition by network) as best from m) select network, count(*) filter (where score = best) as best_rows, max(score)::int as best, coalesce(max(case when score = 3 then 'opening' end), max(case when mode = 'tram' then 'tram-rule' end), 'keep') as decision,
    case when bool_or(score >= 2) then 'dedicated' when bool_or(score = 1) then 'indirect' else 'uncovered' end as coverage from b group by 1"""
)
def t_presence_and_coverage(spark: SparkSession, folder: str) -> DataFrame:
    """Precedence of three sources, and three levels of coverage, per network."""
    conf = F.col("match_confidence")
    score = F.when(conf == "exact", 3).when(conf == "stop-confirmed", 2).when(conf == "ambiguous", 1).otherwise(0)
    m = table(spark, folder, "pt_openings_mapping").where("network is not null").select("network", F.lower(F.trim("mode")).alias("mode"), score.alias("score"))
    # The best score is a second aggregate over a few values, not a window over a network.
    per = m.groupBy("network", "score").agg(F.count("*").alias("rows"), F.bool_or(F.coalesce(F.col("mode") == "tram", F.lit(False))).alias("tram"))
    s = F.col("score")
    decision = feeds.presence(F.max(F.when(s == 3, F.lit("opening"))), F.max(F.when(F.col("tram"), F.lit("tram-rule"))))
    return per.groupBy("network").agg(F.max_by("rows", "score").alias("best_rows"), F.max("score").alias("best"), decision.alias("decision"), F.when(F.bool_or(s >= 2), "dedicated").when(F.bool_or(s == 1), "indirect").otherwise("uncovered").alias("coverage"))


@query(f"with {_CHAIN}, e as (select day_id, ordinal, case when mobloc = 1 then ordinal else 1 end as a, case when mobloc = 0 then ordinal else 99 end as z from ch) select day_id, max(a)::int as a, min(z)::int as z from e group by 1")
def t_edit_ranges(spark: SparkSession, folder: str) -> DataFrame:
    """Edits of a chain narrowed to one index range."""
    o, m = F.col("ordinal"), F.col("mobloc")
    e = _chain(spark, folder).select("day_id", F.when(m == 1, o).otherwise(1).alias("a"), F.when(m == 0, o).otherwise(99).alias("z"))
    return feeds.narrow(e, ["day_id"], "a", "z")


@query("select i::int as route_type, case when i in (0, 5) then 'tram' when i in (1, 6, 7, 12) then 'metro' when i = 2 then 'rail' when i in (3, 11) then 'bus' when i = 4 then 'ferry' when i between 100 and 117 or i between 400 and 405 then 'rail' when i between 200 and 209 or i between 700 and 716 then 'bus' when i between 900 and 906 then 'tram' when i between 1000 and 1021 then 'ferry' when i between 1300 and 1307 or i between 1400 and 1402 then 'metro' end as family from range(0, 1500) t(i)")
def t_route_types(spark: SparkSession, folder: str) -> DataFrame:
    """Mode family of every route type."""
    return spark.range(1500).select(F.col("id").cast("int").alias("route_type")).withColumn("family", route_type_family(F.col("route_type")))


@query(
    f"""with o as (select {key_sql("ident_men")} as k, min(rec_id) as rec_id, max(tu99) as tu99, max(nbuc) as checked from q_tcm_menage where deleted_at is not null and {key_sql("ident_men")} is not null group by 1), n as (select {key_sql("ident_men")} as k, min(rec_id) as rec_id, max(tu99) as tu99 from q_tcm_menage where deleted_at is null and {key_sql("ident_men")} is not null group by 1)
    select coalesce(o.k, n.k) as k, case when n.k is not null then n.rec_id else o.rec_id end as rec_id, case when n.k is not null then n.tu99 else o.tu99 end as tu99, case when o.tu99 is not distinct from n.tu99 or n.k is null then o.checked end as checked from o full outer join n on o.k = n.k"""
)
def t_upsert(spark: SparkSession, folder: str) -> DataFrame:
    """Withdrawn and live households merged by key: refreshed records, kept checks where nothing changed."""
    h = table(spark, folder, "q_tcm_menage").withColumn("k", norm_key(F.col("ident_men"))).where("k is not null")
    load = lambda when: h.where(when).groupBy("k").agg(F.min("rec_id").alias("rec_id"), F.max("tu99").alias("tu99"), F.max("nbuc").alias("checked"))
    return feeds.upsert(load("deleted_at is not null"), load("deleted_at is null"), "k", ["rec_id", "tu99"], "tu99", ["checked"])


@query("""with o as (select rec_id, replace(coalesce(notes, ''), ' ', ':') || ':x' as k, '20' || substr(opening_id, 3, 2) as opening, date '2012-06-30' as snapshot from pt_openings_mapping) select rec_id, starts_with(k, 'to:') or starts_with(k, 'unique:') as excluded, coalesce(try_cast(opening as date) > snapshot, false) or coalesce(try_cast(substr(opening, 1, 4) as int) > 2012, false) as future from o""")
def t_lifecycle(spark: SparkSession, folder: str) -> DataFrame:
    """Tags that exclude an object, and dates after the snapshot."""
    o = table(spark, folder, "pt_openings_mapping")
    tags = F.create_map(F.concat(F.replace(F.coalesce("notes", F.lit("")), F.lit(" "), F.lit(":")), F.lit(":x")), F.lit("yes"))
    opening = F.concat(F.lit("20"), F.substring("opening_id", 3, 2))
    return o.select("rec_id", feeds.lifecycle_excluded(tags, ("to:", "unique:")).alias("excluded"), feeds.opens_after(opening, F.lit(date(2012, 6, 30))).alias("future"))


# --- grid and geometry

_NODES = "nodes as (select id, min(struct_pack(lon := lon, lat := lat)).lon as lon, min(struct_pack(lon := lon, lat := lat)).lat as lat from osm_node_coords where isfinite(lon) and isfinite(lat) and lon between -180 and 180 and lat between -90 and 90 and not (lon = 0 and lat = 0) group by id)"
_Q = lambda s: f"({1 - gr._E2!r} * ({s} / (1 - {gr._E2!r} * {s} * {s}) - {1 / (2 * gr._E)!r} * ln((1 - {gr._E!r} * {s}) / (1 + {gr._E!r} * {s}))))"


def _laea() -> str:
    import math

    s0 = math.sin(math.radians(gr._LAT0))
    qp, q0 = gr._q(1.0), gr._q(s0)
    b0, rq = math.asin(q0 / qp), gr._A * math.sqrt(qp / 2)
    d = gr._A * math.cos(math.radians(gr._LAT0)) / math.sqrt(1 - gr._E2 * s0 * s0) / (rq * math.cos(b0))
    return f"""{_NODES}, q as (select *, asin(greatest(-1.0, least(1.0, {_Q("sin(radians(lat))")} / {qp!r}))) as b, radians(lon - 10) as dl, lon between -25 and 45 and lat between 30 and 72 as inside from nodes),
      k as (select *, {rq!r} * sqrt(2 / (1 + {math.sin(b0)!r} * sin(b) + {math.cos(b0)!r} * cos(b) * cos(dl))) as k from q), xy as (select id, lon, lat, case when inside then 4321000 + k * {d!r} * cos(b) * sin(dl) end as x, case when inside then 3210000 + k / {d!r} * ({math.cos(b0)!r} * sin(b) - {math.sin(b0)!r} * cos(b) * cos(dl)) end as y from k)"""


def _projected(spark: SparkSession, folder: str) -> DataFrame:
    """All usable nodes; x and y are null outside EPSG:3035's domain here, lon -25 to 45 and lat 30 to 72."""
    n = usable_points(table(spark, folder, "osm_node_coords", "id", "lon", "lat"))
    inside = F.col("lon").between(-25, 45) & F.col("lat").between(30, 72)
    x, y = gr.project(F.col("lon"), F.col("lat"))
    return n.withColumns({"x": F.when(inside, x), "y": F.when(inside, y)})


@query(f"with {_laea()} select id, round(x, 2) as x, round(y, 2) as y from xy")
def g_project(spark: SparkSession, folder: str) -> DataFrame:
    """Degrees to metres of the European equal-area projection; null outside its domain."""
    return _projected(spark, folder).select("id", F.round("x", 2).alias("x"), F.round("y", 2).alias("y"))


@query(f"with {_laea()}, c as (select (floor(y / 1000) * 100000 + floor(x / 1000))::bigint as cell, count(*) as points from xy group by 1) select cell, points, (cell // 100000 * 1000)::bigint as north, (cell % 100000 * 1000)::bigint as east, 'CRS3035RES1000mN' || (cell // 100000 * 1000)::varchar || 'E' || (cell % 100000 * 1000)::varchar as code, (cell // 100000 * 5 * 100000 + cell % 100000 * 5)::bigint as first_child, cell - 200002 as first_neighbour, (cell // 100000 * 1000 // 10000 * 10000 - 500)::bigint as tile_north from c")
def g_grid_cells(spark: SparkSession, folder: str) -> DataFrame:
    """Points per cell, with the cell's corner, code, first child, first neighbour and tile; those outside the domain are counted in a null cell."""
    c = _projected(spark, folder).groupBy(gr.cell_id(F.col("y"), F.col("x"), 1000).alias("cell")).agg(F.count("*").alias("points"))
    n, e = gr.cell_origin(F.col("cell"), 1000)
    c = c.withColumns({"north": n, "east": e})
    return c.select("cell", "points", "north", "east", gr.cell_code(F.col("north"), F.col("east"), 1000).alias("code"), F.get(gr.children(F.col("cell"), 1000, 200), F.lit(0)).alias("first_child"), F.get(gr.neighbours(F.col("cell")), F.lit(0)).alias("first_neighbour"), gr.tile_bounds(F.col("north"), F.col("east"), 10_000, 500)["north_min"].cast("long").alias("tile_north"))


@query(f"with {_laea()}, c as (select distinct (floor(y / 1000) * 100000 + floor(x / 1000))::bigint as cell from xy where x is not null), kids as (select cell, unnest(range(0, 25)) as i from c) select cell, ((cell // 100000 * 5 + i // 5) * 100000 + cell % 100000 * 5 + i % 5)::bigint as child, (select count(*) from c d where d.cell = kids.cell + (i // 5 - 2) * 100000 + i % 5 - 2) - (i = 12)::int as neighbour_used from kids")
def g_children_and_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    """All children of the used cells, and whether the neighbour at the same place of the stencil is used."""
    cells = _projected(spark, folder).where("x is not null").select(gr.cell_id(F.col("y"), F.col("x"), 1000).alias("cell")).distinct()  # outside there are no cells
    k = cells.select("cell", F.posexplode(gr.children(F.col("cell"), 1000, 200)).alias("i", "child"))
    k = k.withColumn("other", F.col("cell") + (F.floor(F.col("i") / 5).cast("long") - 2) * gr.BASE + F.col("i") % 5 - 2)
    used = cells.select(F.col("cell").alias("other"), F.lit(1).alias("u"))
    hit = k.join(used, "other", "left")
    return hit.select("cell", "child", F.when(F.col("i") == 12, 0).otherwise(F.coalesce("u", F.lit(0))).cast("long").alias("neighbour_used"))


_BOX = "box as (select siren, xmin, ymin, xmax, ymax from epci_polygons where isfinite(xmin) and isfinite(xmax))"


@query(f"with {_NODES}, {_BOX} select siren, count(*) as nodes, round(min(sqrt(pow(n.lon - (xmin + xmax) / 2, 2) + pow(n.lat - (ymin + ymax) / 2, 2))), 9) as nearest from nodes n join box b on n.lon between xmin and xmax and n.lat between ymin and ymax group by 1")
def g_box_join(spark: SparkSession, folder: str) -> DataFrame:
    """Nodes within each region's box, however wide, by a bucketed range join, and the one nearest its middle."""
    n = usable_points(table(spark, folder, "osm_node_coords", "id", "lon", "lat"))
    b = table(spark, folder, "epci_polygons", "siren", "xmin", "ymin", "xmax", "ymax").where(finite(F.col("xmin")) & finite(F.col("xmax")))
    j = band_join(n, b, "lon", "xmin", "xmax", 0.25).where("lat between ymin and ymax")
    d = F.sqrt(F.pow(F.col("lon") - (F.col("xmin") + F.col("xmax")) / 2, F.lit(2)) + F.pow(F.col("lat") - (F.col("ymin") + F.col("ymax")) / 2, F.lit(2)))
    return j.groupBy("siren").agg(F.count("*").alias("nodes"), F.round(F.min(d), 9).alias("nearest"))


@query(f"with {_NODES}, {_BOX}, d as (select siren, id, greatest(0.0, least(1.0, ((lon - xmin) * (xmax - xmin) + (lat - ymin) * (ymax - ymin)) / nullif((xmax - xmin) * (xmax - xmin) + (ymax - ymin) * (ymax - ymin), 0))) as t, lon, lat, xmin, ymin, xmax, ymax from nodes join box on lon between xmin and xmax and lat between ymin and ymax) select siren, round(min(sqrt(pow(lon - xmin - t * (xmax - xmin), 2) + pow(lat - ymin - t * (ymax - ymin), 2))), 9) as distance from d group by 1")
def g_segment_distance(spark: SparkSession, folder: str) -> DataFrame:
    """Least distance of a region's nodes from the diagonal of its box, however wide."""
    n = usable_points(table(spark, folder, "osm_node_coords", "id", "lon", "lat"))
    b = table(spark, folder, "epci_polygons", "siren", "xmin", "ymin", "xmax", "ymax").where(finite(F.col("xmin")) & finite(F.col("xmax")))
    j = band_join(n, b, "lon", "xmin", "xmax", 0.25).where("lat between ymin and ymax")
    d = gr.segment_distance(*(F.col(c) for c in ("lon", "lat", "xmin", "ymin", "xmax", "ymax")))
    return j.groupBy("siren").agg(F.round(F.min(d), 9).alias("distance"))


@query(f"with {_laea()}, c as (select (floor(y / 200) * 100000 + floor(x / 200))::bigint as cell, count(*) as n from xy group by 1) select (cell // 100000 // 5 * 100000 + cell % 100000 // 5)::bigint as parent, count(cell) as children, sum(n)::bigint as points, case when count(cell) > 0 then round(sum(n * n) / sum(n), 8) end as crowding from c group by 1")
def g_aggregate_cells(spark: SparkSession, folder: str) -> DataFrame:
    """Cells of 200 m summed to their kilometre cells; points outside the domain are counted under a null one, without children."""
    c = _projected(spark, folder).groupBy(gr.cell_id(F.col("y"), F.col("x"), 200).alias("cell")).agg(F.count("*").alias("n"))
    parent = F.floor(F.floor(F.col("cell") / gr.BASE) / 5) * gr.BASE + F.floor(F.pmod(F.col("cell"), F.lit(gr.BASE)) / 5)
    return c.groupBy(parent.cast("long").alias("parent")).agg(F.count("cell").alias("children"), F.sum("n").alias("points"), F.round(F.when(F.count("cell") > 0, safe_div(F.sum(F.col("n") * F.col("n")), F.sum("n"))), 8).alias("crowding"))
