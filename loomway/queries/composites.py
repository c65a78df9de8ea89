"""Composite statistics over several operators, sources and sinks, and streams."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomway.functions.exprs import finite, norm_key, safe_div
from loomway.operators import bootstrap as bs
from loomway.operators import chains
from loomway.operators import decompose as dc
from loomway.operators import weighted as wt
from loomway.operators.relational import first_per_key, repeated_keys, require_empty
from loomway.plans.scope_cube import COMPONENTS, INDICATORS, REFERENCE, SWITCHES, WEEKDAYS, components, cube, switch_effects
from loomway.queries.base import DAYS, TRIPS, days, key_sql, registry, trips
from loomway.queries.stats import _BOTH, REPS, draw_sql, replicated
from loomway.queries.survey import _SCOPED, _scope_sql, _scoped
from loomway.session import checkpoint_dir, cut
from loomway.sources import sinks
from loomway.tables import table

QUERIES, SQL, query = registry()

# --- scope cube (flagship)

_TRIP_OK = "isfinite(duration_min) and duration_min between 0 and 1440 and isfinite(pond_jour) and pond_jour > 0"
_NOT_NEGATIVE = lambda c: f"case when isfinite({c}) and {c} >= 0 then {c} end"
_DAY_OF = lambda s: f"""select '{s}' as scope, survey, min(h2) as hh, min(category) as category, max(w) as w, {"bool_or(is_round)" if s.startswith("round") else "true"} as is_kept, count(*) filter (where {_scope_sql(s)}) as n,
    coalesce(sum(m) filter (where {_scope_sql(s)}), 0) as m, count(m) filter (where {_scope_sql(s)}) as mn, coalesce(sum(pk) filter (where {_scope_sql(s)}), 0) as pk, count(pk) filter (where {_scope_sql(s)}) as pn, coalesce(sum(ck) filter (where {_scope_sql(s)}), 0) as ck, count(ck) filter (where {_scope_sql(s)}) as cn from cr group by survey, day_id"""  # noqa: E731
_PARTS = f"""{_SCOPED}, ct as (select *, coalesce(hh, 'none') as h2, coalesce(age_band, 'unknown') as category, {key_sql("ident_ind")} as person from scoped),
    crow as (select ident_dep, v2_dvo_loc from (select *, row_number() over (partition by ident_dep order by rec_id) as n from k_deploc where ident_dep is not null) where n = 1),
    cr as (select survey, day_id, h2, category, pond_jour as w, is_round, is_destination, mobloc, case when isfinite(duration_min) and duration_min between 0 and 1440 then duration_min end as m, {_NOT_NEGATIVE("distance_km_declared")} as pk, {_NOT_NEGATIVE("v2_dvo_loc")} as ck from ct left join crow using (ident_dep) where isfinite(pond_jour) and pond_jour > 0 and typejour = 1),
    dy as ({" union all ".join(_DAY_OF(s) for s in chains.SCOPES)}),
    mine as (select survey, person, min(h2) as hh, min(category) as category, max(pond_ind) filter (where isfinite(pond_ind)) as w from ct where person is not null group by all),
    ki as (select {key_sql("ident_ind")} as person, coalesce({key_sql("ident_men")}, 'none') as hh, case when isfinite(pondki) then pondki end as w, row_number() over (partition by {key_sql("ident_ind")} order by rec_id) as n from k_individu where deleted_at is null and {key_sql("ident_ind")} is not null),
    ro as (select 'J' as survey, ki.hh, coalesce(category, 'unknown') as category, ki.w from ki left join mine on mine.person = ki.person and survey = 'J' where n = 1 union all select survey, hh, category, w from mine where survey = 'P'),
    un as (select scope, survey, hh, category, 0.0::double as universe, coalesce(sum(w) filter (where not is_kept), 0) as dropped, coalesce(sum(w) filter (where is_kept), 0) as kept, coalesce(sum(w) filter (where is_kept and n > 0), 0) as travel, {", ".join(f"coalesce(sum(w * {c}) filter (where is_kept), 0) as {n}" for c, n in zip(("n", "m", "mn", "pk", "pn", "ck", "cn"), COMPONENTS[4:]))}, count(*) filter (where is_kept and n > 0) as rows from dy group by all
      union all select scope, survey, hh, category, sum({WEEKDAYS} * w), {", ".join("0" for _ in COMPONENTS)} from ro, (select unnest([{", ".join(f"'{s}'" for s in chains.SCOPES)}]) as scope) where w > 0 group by all),
    parts as (select scope, survey, hh, category, {", ".join(f"sum({c}) as {c}" for c in COMPONENTS)}, sum(rows) as rows from un group by all),
    {draw_sql("dj", "select distinct hh from parts where survey = 'J'", 0, "'J' as survey,")}, {draw_sql("dp", "select distinct hh from parts where survey = 'P'", 1000, "'P' as survey,")}, dr as (select * from dj union all select * from dp)"""
_SUMS = ", ".join(f"sum({c}) as {c}" for c in COMPONENTS)
_DRAWN = ", ".join(f"sum({c} * mult) as {c}" for c in COMPONENTS)
_IND = lambda src: " union all ".join(f"select *, '{i}' as indicator, {a} / nullif({b}, 0) as value from (select *, universe - dropped as person_days from {src})" for i, (a, b) in INDICATORS.items())


def _cube_parts(spark: SparkSession, folder: str) -> DataFrame:
    """Crow-fly distances are in the raw trips of 2008 (J) only. 2008 has a roster of persons; that of 2019 (P) are the persons of its trips."""
    known = lambda c, ok: F.when(finite(F.col(c)) & ok, F.col(c))
    crow = first_per_key(table(spark, folder, "k_deploc", "rec_id", "ident_dep", "v2_dvo_loc").where("ident_dep is not null"), ["ident_dep"], ["rec_id"]).select("ident_dep", "v2_dvo_loc")
    known_by = {"hh": F.coalesce("hh", F.lit("none")), "category": F.coalesce("age_band", F.lit("unknown"))}
    rows = _scoped(spark, folder).withColumns(known_by).where(finite(F.col("pond_jour")) & (F.col("typejour") == 1)).join(crow, "ident_dep", "left")
    d, km, cf = "duration_min", "distance_km_declared", "v2_dvo_loc"
    rows = rows.withColumns({"w": F.col("pond_jour"), "minutes": known(d, F.col(d).between(0, 1440)), "producer_km": known(km, F.col(km) >= 0), "crow_km": known(cf, F.col(cf) >= 0)})
    t = trips(spark, folder).withColumns({**known_by, "person": norm_key(F.col("ident_ind"))})
    mine = t.where("person is not null and day_id is not null").groupBy("survey", "person").agg(F.min("hh").alias("hh"), F.min("category").alias("category"), F.max(F.when(finite(F.col("pond_ind")), F.col("pond_ind"))).alias("w"))
    i = table(spark, folder, "k_individu", "rec_id", "ident_ind", "ident_men", "pondki", "deleted_at").where("deleted_at is null").withColumn("person", norm_key(F.col("ident_ind"))).where("person is not null")
    i = first_per_key(i, ["person"], ["rec_id"]).select("person", F.coalesce(norm_key(F.col("ident_men")), F.lit("none")).alias("hh"), F.when(finite(F.col("pondki")), F.col("pondki")).alias("w"))
    j = i.join(mine.where("survey = 'J'").select("person", "category"), "person", "left").select(F.lit("J").alias("survey"), "hh", F.coalesce("category", F.lit("unknown")).alias("category"), "w")
    roster = j.unionByName(mine.where("survey = 'P'").select("survey", "hh", "category", "w")).where("w > 0")
    return components(rows, roster)


def _cube(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Component sums, kept as they are read by the draws, the point estimates and the replicates; and the draws of both surveys."""
    parts = cut(_cube_parts(spark, folder))
    return parts, bs.draws(parts, "hh", REPS, "survey", {"J": 0, "P": 1000})


@query(
    f"""with {_PARTS}, pt as (select scope, survey, category, sum(rows)::bigint as n, {_SUMS} from parts group by all), pl as (select scope, survey, category, n, indicator, value from ({_IND("pt")})),
    rs as (select scope, survey, category, rep, {_DRAWN} from parts join dr using (survey, hh) group by all),
    ci as (select scope, survey, category, indicator, quantile_cont(value, 0.025) as low, quantile_cont(value, 0.975) as high, count(value) as valid from ({_IND("rs")}) group by all)
    select scope, survey, category, indicator, n, case when n < 50 then 'blank' when n < 100 then 'caution' else 'ok' end as reading, case when n >= 50 then round(value, 6) end as value, case when n >= 50 and valid >= {0.95 * REPS} then round(low, 6) end as low, case when n >= 50 and valid >= {0.95 * REPS} then round(high, 6) end as high from pl left join ci using (scope, survey, category, indicator)"""
)
def y_scope_cube(spark: SparkSession, folder: str) -> DataFrame:
    """Eight scopes, two surveys, age bands, eight indicators of weekdays, with household-bootstrap intervals."""
    out = cube(*_cube(spark, folder), REPS)
    return out.select("scope", "survey", "category", "indicator", "n", "reading", *(F.round(c, 6).alias(c) for c in ("value", "low", "high")))


_EFFECTS = lambda src, at: f"select {at}, indicator, switch, ref.value as reference, v.value - ref.value as effect from ({_IND(src)}) v join ({_IND(src)}) ref using ({at}, indicator) join (select unnest(['days', 'purpose', 'distance']) as switch, unnest([{', '.join(repr(s) for s in SWITCHES.values())}]) as scope) k on k.scope = v.scope where ref.scope = '{REFERENCE}'"


@query(
    f"""with {_PARTS}, pt as (select scope, survey, {_SUMS} from parts group by all), rs as (select scope, survey, rep, {_DRAWN} from parts join dr using (survey, hh) group by all), p as ({_EFFECTS("pt", "survey")}), r as ({_EFFECTS("rs", "survey, rep")}),
    ci as (select survey, indicator, switch, quantile_cont(effect, 0.025) as low, quantile_cont(effect, 0.975) as high, count(effect) as valid from r group by all)
    select survey, indicator, switch, round(reference, 6) as reference, round(effect, 6) as effect, case when valid >= {0.95 * REPS} then round(low, 6) end as low, case when valid >= {0.95 * REPS} then round(high, 6) end as high from p left join ci using (survey, indicator, switch)"""
)
def y_scope_switches(spark: SparkSession, folder: str) -> DataFrame:
    """What each of the three switches adds to the reference scope, with intervals of the effect itself."""
    out = switch_effects(*_cube(spark, folder), REPS)
    return out.select("survey", "indicator", "switch", *(F.round(c, 6).alias(c) for c in ("reference", "effect", "low", "high")))


# --- reports of several parts


@query(f"with {DAYS}, m as (select mode, survey, sum(w * x) / sum(w) as m, count(*) as n from days group by all), p as (select mode, max(m) filter (where survey = 'a') as a, max(m) filter (where survey = 'b') as b, sum(n)::bigint as n from m group by 1) select mode, n, round(b / a, 8) as ratio, case when abs(ln(b / a)) < 0.05 then 'stable' else 'moved' end as label, round(avg(abs(ln(b / a))) over (), 8) as mean_abs_log, round(max(abs(ln(b / a))) over (), 8) as max_abs_log from p where a is not null and b is not null")
def y_constancy(spark: SparkSession, folder: str) -> DataFrame:
    """Ratios of the surveys by mode, and how far they move on average and at most."""
    g = days(spark, folder).groupBy("mode", "survey").agg((F.sum(F.col("w") * F.col("x")) / F.sum("w")).alias("m"), F.count("*").alias("k"))
    p = g.groupBy("mode").agg(*(F.max(F.when(F.col("survey") == s, F.col("m"))).alias(s) for s in "ab"), F.sum("k").alias("n")).where("a is not null and b is not null")
    ln, all_ = F.abs(F.ln(F.col("b") / F.col("a"))), W.partitionBy()  # one row per mode
    return p.select("mode", "n", F.round(F.col("b") / F.col("a"), 8).alias("ratio"), F.when(ln < 0.05, "stable").otherwise("moved").alias("label"), F.round(F.avg(ln).over(all_), 8).alias("mean_abs_log"), F.round(F.max(ln).over(all_), 8).alias("max_abs_log"))


@query(f"with {TRIPS}, d as (select survey, case when isfinite(distance_km_declared) and distance_km_declared >= 0 then least(floor(distance_km_declared / 0.5), 60) end::bigint as half_km, duration_min from trips where isfinite(duration_min) and duration_min between 0 and 1440) select survey, half_km, count(*) as trips, round(count(*) / sum(count(*)) over (partition by survey), 8) as share, round(quantile_cont(duration_min, 0.5), 6) as median_min, count(*) filter (where duration_min % 15 = 0) as multiples from d where half_km is not null group by survey, half_km")
def y_distance_distribution(spark: SparkSession, folder: str) -> DataFrame:
    """Half-kilometre bands, the last one open: shares, median minutes and multiples of 15."""
    k, d = F.col("distance_km_declared"), F.col("duration_min")
    rows = trips(spark, folder).where(finite(d) & d.between(0, 1440) & finite(k) & (k >= 0)).withColumn("half_km", F.least(F.floor(k / 0.5), F.lit(60).cast("long")))
    g = rows.groupBy("survey", "half_km").agg(F.count("*").alias("trips"), F.round(F.expr("percentile(duration_min, 0.5)"), 6).alias("median_min"), F.count(F.when(d % 15 == 0, 1)).alias("multiples"))
    return g.withColumn("share", F.round(F.col("trips") / F.sum("trips").over(W.partitionBy("survey")), 8))


@query(f"with {TRIPS}, t as (select survey, coalesce(floor(motive), -1)::bigint as motive, departure_s // 3600 as hour, pond_jour * distance_km_declared as wk, pond_jour * duration_min as wm, pond_jour as w from trips where {_TRIP_OK} and isfinite(distance_km_declared) and departure_s is not null) select survey, motive, case when hour between 7 and 9 then 'morning' when hour between 16 and 19 then 'evening' else 'other' end as part, count(*) as trips, round(60 * sum(wk) / nullif(sum(wm), 0), 6) as speed_kmh, round(sum(wk) / sum(w), 6) as km_per_trip, round(sum(wm) / sum(w), 6) as min_per_trip from t group by all")
def y_door_to_door_speed(spark: SparkSession, folder: str) -> DataFrame:
    """Speed, length and duration by purpose and part of the day, as ratios of weighted sums."""
    d, k, w = F.col("duration_min"), F.col("distance_km_declared"), F.col("pond_jour")
    rows = trips(spark, folder).where(finite(d) & d.between(0, 1440) & finite(w) & (w > 0) & finite(k) & F.col("departure_s").isNotNull())
    hour = F.floor(F.col("departure_s") / 3600)
    part = F.when(hour.between(7, 9), "morning").when(hour.between(16, 19), "evening").otherwise("other")
    wk, wm = F.sum(w * k), F.sum(w * d)
    return rows.groupBy("survey", F.coalesce(F.floor("motive"), F.lit(-1)).cast("long").alias("motive"), part.alias("part")).agg(F.count("*").alias("trips"), F.round(60 * safe_div(wk, wm), 6).alias("speed_kmh"), F.round(wk / F.sum(w), 6).alias("km_per_trip"), F.round(wm / F.sum(w), 6).alias("min_per_trip"))


@query(f"with {DAYS}, f as (select survey, hh, bool_or(typejour = 1 and x > 120) as long_weekday from days group by all) select d.survey, long_weekday, count(*) as weekend_days, round(sum(w * x) / sum(w), 6) as weekend_min from days d join f using (survey, hh) where typejour <> 1 group by all")
def y_compensation(spark: SparkSession, folder: str) -> DataFrame:
    """Weekend minutes of households with and without a long weekday."""
    d = days(spark, folder)
    f = d.groupBy("survey", "hh").agg(F.bool_or((F.col("typejour") == 1) & (F.col("x") > 120)).alias("long_weekday"))
    return d.where("typejour <> 1").join(f, ["survey", "hh"]).groupBy("survey", "long_weekday").agg(F.count("*").alias("weekend_days"), F.round(F.sum(F.col("w") * F.col("x")) / F.sum("w"), 6).alias("weekend_min"))


@query(f"with {DAYS}, m as (select survey, mode, sum(w * e) as e, sum(w * x) as x, sum(w) as w from days where isfinite(e) group by all) select survey, mode, round(e / sum(e) over (partition by survey), 8) as energy_share, round(x / sum(x) over (partition by survey), 8) as time_share, round(e / nullif(x, 0), 6) as kj_per_min, round(sum(e) over (partition by survey) / sum(w) over (partition by survey), 4) as total_per_day from m")
def y_energy_accounts(spark: SparkSession, folder: str) -> DataFrame:
    """Energy by mode, adding up to the total."""
    g = days(spark, folder).where(finite(F.col("e"))).groupBy("survey", "mode").agg(F.sum(F.col("w") * F.col("e")).alias("e"), F.sum(F.col("w") * F.col("x")).alias("x"), F.sum("w").alias("w"))
    s = W.partitionBy("survey")
    return g.select("survey", "mode", F.round(F.col("e") / F.sum("e").over(s), 8).alias("energy_share"), F.round(F.col("x") / F.sum("x").over(s), 8).alias("time_share"), F.round(safe_div(F.col("e"), F.col("x")), 6).alias("kj_per_min"), F.round(F.sum("e").over(s) / F.sum("w").over(s), 4).alias("total_per_day"))


@query(f"with {_BOTH}, k as (select survey, rep, sum(w * x * mult) filter (where x > 180) / sum(w * mult) as tail from (select * from da join dra using (hh) union all select * from db join drb using (hh)) group by all), p as (select rep, max(tail) filter (where survey = 'b') - max(tail) filter (where survey = 'a') as d from k group by 1) select round(quantile_cont(d, 0.025), 6) as low, round(quantile_cont(d, 0.975), 6) as high from p")
def y_tail_difference(spark: SparkSession, folder: str) -> DataFrame:
    """Difference of the minutes that days above three hours give, with its interval."""
    d = days(spark, folder)
    w, x = F.col("w"), F.col("x")
    r = replicated(d, [], {"t": F.when(x > 180, w * x), "w0": w}).withColumn("tail", safe_div(F.col("t"), F.col("w0")))
    p = dc.side_by_side(r, ["rep"], "survey", "a", "b", ("tail",)).withColumn("d", F.col("tail_b") - F.col("tail_a"))
    return p.agg(*(F.round(F.expr(f"percentile(d, {q})"), 6).alias(n) for q, n in ((0.025, "low"), (0.975, "high"))))


@query(f"with {DAYS}, g as (select survey, income, density, sum(w) as weight, sum(w * x) as total from days group by all), c as (select density, income, max(weight) filter (where survey = 'a') as wa, max(weight) filter (where survey = 'b') as wb, max(total) filter (where survey = 'a') as ta, max(total) filter (where survey = 'b') as tb from g group by all), k as (select *, (wa / sum(wa) over (partition by income) + wb / sum(wb) over (partition by income)) / 2 as mix from c where wa > 0 and wb > 0) select income, round(sum(mix * ta / wa), 6) as a, round(sum(mix * tb / wb), 6) as b, count(*) as cells from k group by 1")
def y_reweighted_levels(spark: SparkSession, folder: str) -> DataFrame:
    """Income levels at the surveys' mean mix of densities."""
    g = days(spark, folder).groupBy("survey", "income", "density").agg(F.sum("w").alias("weight"), F.sum(F.col("w") * F.col("x")).alias("total"))
    c = dc.side_by_side(g, ["income", "density"], "survey", "a", "b", ("weight", "total")).where("weight_a > 0 and weight_b > 0")
    i = W.partitionBy("income")
    c = c.withColumn("mix", (F.col("weight_a") / F.sum("weight_a").over(i) + F.col("weight_b") / F.sum("weight_b").over(i)) / 2)
    return c.groupBy("income").agg(F.round(F.sum(F.col("mix") * F.col("total_a") / F.col("weight_a")), 6).alias("a"), F.round(F.sum(F.col("mix") * F.col("total_b") / F.col("weight_b")), 6).alias("b"), F.count("*").alias("cells"))


@query("select rec_id, case when candidate_route_ids is null or trim(candidate_route_ids, chr(9)||chr(10)||' ') = '' then 'no-candidate' when match_confidence = 'exact' then 'applied' when match_confidence = 'stop-confirmed' then 'confirmed' when match_confidence = 'ambiguous' then 'review' else 'open' end as category from pt_openings_mapping")
def y_openings_categories(spark: SparkSession, folder: str) -> DataFrame:
    """Every opening in exactly one category."""
    c, m = F.col("candidate_route_ids"), F.col("match_confidence")
    cat = F.when(c.isNull() | ~c.rlike(r"[^ \t\n]"), "no-candidate").when(m == "exact", "applied").when(m == "stop-confirmed", "confirmed").when(m == "ambiguous", "review").otherwise("open")
    return table(spark, folder, "pt_openings_mapping", "rec_id", "candidate_route_ids", "match_confidence").select("rec_id", cat.alias("category"))


# --- sources, sinks and streams


@query("select o_orderpriority, count(*) as orders, round(sum(o_totalprice), 2) as total from orders group by 1")
def k_signed_cache(spark: SparkSession, folder: str) -> DataFrame:
    """Orders through a signed cache, partitioned by priority, in the shared folder: built once, and read a second time with partition discovery."""
    root = f"{checkpoint_dir(spark)}/loomway-cache"
    df = table(spark, folder, "orders", "o_orderkey", "o_orderpriority", "o_totalprice")
    of = {"source": folder, "columns": df.columns, "partition_by": ["o_orderpriority"]}
    sinks.signed(spark, root, "orders", lambda: df, **of)

    def again() -> DataFrame:
        raise RuntimeError("built twice")

    cached = sinks.signed(spark, root, "orders", again, **of)
    return cached.groupBy("o_orderpriority").agg(F.count("*").alias("orders"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("select n_name, count(*) as customers from customer join nation on c_nationkey = n_nationkey where c_acctbal > 0 and n_nationkey >= 5 group by 1")
def k_shadowed_view(spark: SparkSession, folder: str) -> DataFrame:
    """A view that is narrowed twice under its own name."""
    name = f"customers_{uuid.uuid4().hex}"
    table(spark, folder, "customer", "c_nationkey", "c_acctbal").createOrReplaceTempView(name)
    sinks.shadow(spark, name, lambda v: v.where("c_acctbal > 0"))
    v = sinks.shadow(spark, name, lambda v: v.where("c_nationkey >= 5"))
    spark.catalog.dropTempView(name)
    n = table(spark, folder, "nation", "n_nationkey", "n_name")
    return v.join(n, v["c_nationkey"] == n["n_nationkey"]).groupBy("n_name").agg(F.count("*").alias("customers"))


@query("select r_name, count(*) as nations from nation join region on n_regionkey = r_regionkey group by 1")
def k_validated(spark: SparkSession, folder: str) -> DataFrame:
    """A join behind its checks, which are errors: keys that repeat, references without a target."""
    n, r = table(spark, folder, "nation", "n_nationkey", "n_regionkey"), table(spark, folder, "region", "r_regionkey", "r_name")
    require_empty(repeated_keys(r, ["r_regionkey"]), "regions repeat")
    require_empty(n.join(r, n["n_regionkey"] == r["r_regionkey"], "left_anti"), "nations without a region")
    return n.join(r, n["n_regionkey"] == r["r_regionkey"]).groupBy("r_name").agg(F.count("*").alias("nations"))
