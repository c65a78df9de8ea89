"""Code conversion, scaled legs, and reports of trips with intervals: rules, speeds, rates, restorations, gaps, fits, review lists."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomway.functions import codes
from loomway.functions.exprs import finite, looked_up, norm_key, safe_div
from loomway.functions.text import ascii_fold
from loomway.operators import bootstrap as bs
from loomway.operators import chains, feeds, legs
from loomway.operators import decompose as dc
from loomway.operators.relational import first_per_key
from loomway.plans.scope_cube import CAUTION, LEAST, survey_ratios
from loomway.queries import feeds as feed_queries
from loomway.queries.base import DAYS, TRIPS, days, key_sql, registry, trips
from loomway.queries.composites import _DRAWN as _CUBE_DRAWN
from loomway.queries.composites import _IND, _PARTS, _SUMS, _TRIP_OK, _cube
from loomway.queries.stats import REPS, draw_sql
from loomway.queries.survey import _FINITE_TRIP, _SCOPED, RULE_SQL, _case, _legs_sql, _scope_sql, _scoped, rule
from loomway.tables import table

QUERIES, SQL, query = registry()

# --- codes of the two surveys


@query(
    f"""with c as (select rec_id, v2_mtp, v2_mmotifdes, {_case("v2_mtp", codes.by_old_code(codes.MODE_CODES))} as mtp, {_case("v2_mmotifdes", codes.by_old_code(codes.PURPOSE_CODES))} as des, {_case("v2_mmotifori", codes.by_old_code(codes.PURPOSE_CODES))} as ori from k_deploc)
    select rec_id, mtp, case when des in (1.1::double, 1.2::double, 1.3::double) then ori else des end as motive, des = 7.7::double as is_loop_trip, v2_mtp is not null and mtp is null as mode_unknown, v2_mmotifdes is not null and des is null as purpose_unknown from c"""
)
def s_converted_codes(spark: SparkSession, folder: str) -> DataFrame:
    """Raw trips of the older survey in the newer one's codes of mode and motive; codes without a counterpart are flagged."""
    d = table(spark, folder, "k_deploc", "rec_id", "v2_mtp", "v2_mmotifdes", "v2_mmotifori")
    c = d.select("rec_id", "v2_mtp", "v2_mmotifdes", codes.new_mode(F.col("v2_mtp")).alias("mtp"), codes.new_purpose(F.col("v2_mmotifdes")).alias("des"), codes.new_purpose(F.col("v2_mmotifori")).alias("ori"))
    lost = lambda old, new: F.col(old).isNotNull() & F.col(new).isNull()
    return c.select("rec_id", "mtp", codes.motive(F.col("des"), F.col("ori")).alias("motive"), (F.col("des") == codes.LOOP).alias("is_loop_trip"), lost("v2_mtp", "mtp").alias("mode_unknown"), lost("v2_mmotifdes", "des").alias("purpose_unknown"))


@query(
    f"""with {TRIPS}, r as (select survey, motive, destination_motive in (1.1::double, 1.2::double, 1.3::double) as home, case when destination_motive in (1.1::double, 1.2::double, 1.3::double) then nullif(try_cast(origin_purpose as double), 9999) else nullif(destination_motive, 9999) end as m from trips)
    select survey, floor(m)::bigint as motive_group, count(*) as trips, count(*) filter (where home) as ways_home, count(*) filter (where m is not distinct from motive) as as_stored from r group by all"""
)
def s_motive_rule(spark: SparkSession, folder: str) -> DataFrame:
    """Motives by the rule for ways home, and how many are stored alike."""
    m = codes.motive(F.col("destination_motive"), F.col("origin_purpose").try_cast("double"))
    r = trips(spark, folder).withColumn("m", m)
    home = F.col("destination_motive").isin(1.1, 1.2, 1.3)
    return r.groupBy("survey", F.floor("m").alias("motive_group")).agg(F.count("*").alias("trips"), F.count_if(home).alias("ways_home"), F.count_if(F.col("m").eqNullSafe(F.col("motive"))).alias("as_stored"))


# Names of the income classes.
INCOME_NAMES = {"1": "lowest", "2": "low", "3": "middle", "4": "high", "5": "highest"}


@query(f"with {DAYS} select survey, {_case('income', INCOME_NAMES)} as income_name, count(*) as days from days where income <> 'unknown' group by all")
def j_strict_lookup(spark: SparkSession, folder: str) -> DataFrame:
    """A look-up that fails on a code without an entry."""
    d = days(spark, folder).where("income <> 'unknown'")
    return d.groupBy("survey", looked_up(F.col("income"), INCOME_NAMES, "income class").alias("income_name")).agg(F.count("*").alias("days"))


@query("select r_name, e.n_name as missing, s.first_nation from region left join (select n_name from nation where n_nationkey < 0) e on true left join (select min(n_name) as first_nation from nation) s on true")
def j_left_on_true(spark: SparkSession, folder: str) -> DataFrame:
    """A left join on nothing: rows stay, with nulls, where the one-row side is empty."""
    n = table(spark, folder, "nation", "n_nationkey", "n_name")
    out = table(spark, folder, "region", "r_name")
    for one in (n.where("n_nationkey < 0").select(F.col("n_name").alias("missing")), n.agg(F.min("n_name").alias("first_nation"))):
        out = out.join(one, F.lit(True), "left")
    return out


# --- legs with scaled ends

SCALES = (0.5, 1.0, 1.5)
#: Cyclists' power, W, instead of the calibrated one.
OTHER_POWER_W = 50.0


@query(
    " union all ".join(
        f"select {s}::double as scale, * from (with {_legs_sql('defaults', s, OTHER_POWER_W)} select mode_group, count(*) as trips, count(bike_ride_s) as with_ride_time, round(avg(implied_power_w), 4) as implied_power_w, round(avg(energy_kh_kj), 4) as energy_kh_kj, round(avg(energy_cp_kj), 4) as energy_cp_kj from legs where {_FINITE_TRIP} group by 1)"
        for s in SCALES
    )
)
def s_legs_scaled(spark: SparkSession, folder: str) -> DataFrame:
    """Default terminal legs times 0.5, 1 and 1.5, at another power of cyclists; the power that each ride implies."""
    t = trips(spark, folder)
    out = None
    for s in SCALES:
        ok = finite(F.col("duration_min")) & F.col("duration_min").between(0, 1440) & (F.col("distance_km_declared").isNull() | finite(F.col("distance_km_declared")))
        rows = legs.trip_legs(t, "defaults", scale=s, bike_power_w=OTHER_POWER_W).where(ok)
        mean = lambda c: F.round(F.avg(c), 4).alias(c)
        one = rows.groupBy("mode_group").agg(F.count("*").alias("trips"), F.count("bike_ride_s").alias("with_ride_time"), mean("implied_power_w"), mean("energy_kh_kj"), mean("energy_cp_kj")).withColumn("scale", F.lit(s))
        out = one if out is None else out.unionByName(one)
    return out


# --- trips with draws

_RT = f"{_SCOPED}, rt as (select *, coalesce(hh, 'none') as h2, pond_jour as w, duration_min as d, case when isfinite(distance_km_declared) and distance_km_declared >= 0 then distance_km_declared end as km, departure_s // 3600 as hour from scoped where {_TRIP_OK})"
_ROSTER = lambda s: f"select distinct h2 as hh from rt where survey = '{s}'"
_RD = f"""{_RT}, {draw_sql("dj", _ROSTER("J"), 0, "'J' as survey,")}, {draw_sql("dp", _ROSTER("P"), 1000, "'P' as survey,")}, dr as (select * from dj union all select * from dp)"""
_OFFSETS = {"J": 0, "P": 1000}


def _rows(spark: SparkSession, folder: str) -> DataFrame:
    """Scoped trips with a usable duration and weight: hh, w, d, km (null where unknown) and the hour of departure."""
    d, k, w = F.col("duration_min"), F.col("distance_km_declared"), F.col("pond_jour")
    rows = _scoped(spark, folder).where(finite(d) & d.between(0, 1440) & finite(w) & (w > 0))
    return rows.withColumns({"hh": F.coalesce("hh", F.lit("none")), "w": w, "d": d, "km": F.when(finite(k) & (k >= 0), k), "hour": F.floor(F.col("departure_s") / 3600)})


def _replicated(all_rows: DataFrame, rows: DataFrame, keys: list[str], sums: dict) -> DataFrame:
    """Replicates of some rows, with the draws of all."""
    return bs.replicates(rows, keys, ["survey", "hh"], sums, bs.draws(all_rows, "hh", REPS, "survey", _OFFSETS), REPS)


def _shown(c: str, n: str = "n", digits: int = 6):
    return F.round(bs.suppressed(F.col(c), F.col(n), LEAST), digits).alias(c)


_CI = lambda c: f"quantile_cont({c}, 0.025) as low, quantile_cont({c}, 0.975) as high, count({c}) as valid"
_ENDS = lambda digits=6: ", ".join(f"case when n >= {LEAST} and valid >= {0.95 * REPS} then round({c}, {digits}) end as {c}" for c in ("low", "high"))


@query(
    f"""with {_RD}, rl as (select survey, h2 as hh, w, unnest([mode_group, 'all']) as mode, {RULE_SQL} as rule from rt), pt as (select survey, mode, rule, count(*) as trips, sum(w) as w from rl group by all), p as (select survey, mode, rule, trips, (sum(trips) over k)::bigint as n, w / sum(w) over k as share from pt window k as (partition by survey, mode)),
    rs as (select survey, mode, rule, rep, sum(w * mult) as w from rl join dr using (survey, hh) group by all), g as (select pt.survey, pt.mode, pt.rule, r.rep, coalesce(rs.w, 0) as w from pt cross join (select unnest(range(0, {REPS})) as rep) r left join rs on rs.survey = pt.survey and rs.mode = pt.mode and rs.rule = pt.rule and rs.rep = r.rep),
    v as (select survey, mode, rule, w / nullif(sum(w) over (partition by survey, mode, rep), 0) as s from g), ci as (select survey, mode, rule, {_CI("s")} from v group by all)
    select survey, mode, rule, trips, n, case when n >= {LEAST} then round(share, 8) end as share, {_ENDS(8)} from p join ci using (survey, mode, rule)"""
)
def y_rule_shares(spark: SparkSession, folder: str) -> DataFrame:
    """Which share of each mode's weighted trips a rule takes out, with household-bootstrap intervals."""
    rows = _rows(spark, folder)
    long = rows.select("survey", "hh", "w", rule().alias("rule"), F.explode(F.array("mode_group", F.lit("all"))).alias("mode"))
    keys = ["survey", "mode", "rule"]
    # One row per survey, mode and rule, and as many for each replicate.
    of = W.partitionBy("survey", "mode")
    p = long.groupBy(*keys).agg(F.count("*").alias("trips"), F.sum("w").alias("w")).withColumns({"n": F.sum("trips").over(of), "share": safe_div(F.col("w"), F.sum("w").over(of))})
    v = _replicated(rows, long, keys, {"w": F.col("w")}).withColumn("s", safe_div(F.col("w"), F.sum("w").over(W.partitionBy("survey", "mode", "rep"))))
    out = p.join(bs.interval(v, keys, F.col("s"), 0.95, REPS), keys)
    return out.select(*keys, "trips", "n", *(_shown(c, digits=8) for c in ("share", "low", "high")))


_OFFICIAL = {"trips_per_day": "n / nullif(w, 0)", "minutes_per_trip": "m / nullif(n, 0)", "km_per_trip": "k / nullif(kn, 0)", "zero_share": "z / nullif(w, 0)"}
_OFFICIAL_IND = lambda src: " union all ".join(f"select *, '{i}' as indicator, {e} as value from {src}" for i, e in _OFFICIAL.items())
_OFFICIAL_SUMS = lambda m: ", ".join(f"sum({e}{m}) as {n}" for n, e in (("w", "w"), ("n", "w * n"), ("m", "w * m"), ("k", "w * k"), ("kn", "w * kn"), ("z", "(case when n = 0 then w else 0 end)")))


@query(
    f"""with {_RD}, dy as (select survey, day_id, min(h2) as hh, max(w) as w, min(typejour)::int as period, count(*) filter (where {_scope_sql("round-dest-local")}) as n, coalesce(sum(d) filter (where {_scope_sql("round-dest-local")}), 0) as m, coalesce(sum(km) filter (where {_scope_sql("round-dest-local")}), 0) as k, count(km) filter (where {_scope_sql("round-dest-local")}) as kn from rt group by survey, day_id),
    l as (select survey, hh, w, n, m, k, kn, unnest([0, period]) as period from dy where period in (1, 2, 3)), pt as (select survey, period, count(*) as days, {_OFFICIAL_SUMS("")} from l group by all), rs as (select survey, period, rep, {_OFFICIAL_SUMS(" * mult")} from l join dr using (survey, hh) group by all),
    p as (select survey, period, days as n, indicator, value from ({_OFFICIAL_IND("pt")})), ci as (select survey, period, indicator, {_CI("value")} from ({_OFFICIAL_IND("rs")}) group by all)
    select survey, period, indicator, n, case when n >= {LEAST} then round(value, 6) end as value, {_ENDS()} from p left join ci using (survey, period, indicator)"""
)
def y_official_scope(spark: SparkSession, folder: str) -> DataFrame:
    """Trips a day, minutes and kilometres a trip and the share of days without a trip, in the reference scope: by kind of day, 0 being all of them, with intervals."""
    rows = _rows(spark, folder)
    f, d, k = chains.scope_filter("round-dest-local"), F.col("d"), F.col("km")
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    dy = rows.groupBy("survey", "day_id").agg(F.min("hh").alias("hh"), F.max("w").alias("w"), F.min("typejour").cast("int").alias("kind"), F.count_if(f).alias("n"), zero(F.sum(F.when(f, d))).alias("m"), zero(F.sum(F.when(f, k))).alias("k"), F.count(F.when(f, k)).alias("kn"))
    long = dy.where(F.col("kind").isin(1, 2, 3)).withColumn("period", F.explode(F.array(F.lit(0), "kind")))
    w, keys = F.col("w"), ["survey", "period"]
    sums = {"sw": w, **{f"s{c}": w * F.col(c) for c in ("n", "m", "k", "kn")}, "sz": F.when(F.col("n") == 0, w).otherwise(0.0)}
    parts = {"trips_per_day": ("sn", "sw"), "minutes_per_trip": ("sm", "sn"), "km_per_trip": ("sk", "skn"), "zero_share": ("sz", "sw")}
    each = lambda df, *more: df.select(*keys, *more, F.explode(F.array(*(F.struct(F.lit(i).alias("indicator"), safe_div(F.col(a), F.col(b)).alias("value")) for i, (a, b) in parts.items()))).alias("z")).select(*keys, *more, "z.*")
    p = each(long.groupBy(*keys).agg(F.count("*").alias("n"), *(F.sum(c).alias(a) for a, c in sums.items())), "n")
    ci = bs.interval(each(_replicated(rows, long, keys, sums), "rep"), [*keys, "indicator"], F.col("value"), 0.95, REPS)
    return p.join(ci, [*keys, "indicator"], "left").select(*keys, "indicator", "n", *(_shown(c) for c in ("value", "low", "high")))


_V = lambda lo, hi, m: f"case when {lo} >= 1 / (1 + {m}) and {hi} <= 1 + {m} then 'equivalent' when {lo} > 1 or {hi} < 1 then 'different' when {lo} is not null then 'inconclusive' end"


@query(
    f"""with {_PARTS}, pt as (select scope, survey, {_SUMS} from parts group by all), rs as (select scope, survey, rep, {_CUBE_DRAWN} from parts join dr using (survey, hh) group by all), pl as (select scope, survey, indicator, value from ({_IND("pt")})), rl as (select scope, survey, rep, indicator, value from ({_IND("rs")})),
    p as (select scope, indicator, max(value) filter (where survey = 'J') as a, max(value) filter (where survey = 'P') as b from pl group by all), r as (select scope, indicator, rep, max(value) filter (where survey = 'P') / nullif(max(value) filter (where survey = 'J'), 0) as q from rl group by all),
    ci as (select scope, indicator, quantile_cont(q, 0.05) as low, quantile_cont(q, 0.95) as high, count(q) as valid from r group by all), o as (select scope, indicator, a, b, b / nullif(a, 0) as ratio, case when valid >= {0.95 * REPS} then low end as low, case when valid >= {0.95 * REPS} then high end as high from p left join ci using (scope, indicator))
    select scope, indicator, round(a, 6) as a, round(b, 6) as b, round(ratio, 8) as ratio, round(low, 8) as low, round(high, 8) as high, {_V("low", "high", 0.1)} as verdict from o"""
)
def y_budget_bases(spark: SparkSession, folder: str) -> DataFrame:
    """Both surveys' indicators on their bases of persons, days and travel days, in every scope: ratio, 90 % interval and verdict."""
    out = survey_ratios(*_cube(spark, folder), REPS, "J", "P")
    r = lambda c, k: F.round(c, k).alias(c)
    return out.select("scope", "indicator", r("a", 6), r("b", 6), r("ratio", 8), r("low", 8), r("high", 8), bs.verdict(F.col("low"), F.col("high"), 0.1).alias("verdict"))


_SPEED_PARTS = {"speed_kmh": "60 * k / nullif(m, 0)", "km_per_trip": "k / nullif(w, 0)", "min_per_trip": "m / nullif(w, 0)", "zero_share": "z / nullif(w, 0)"}
_SPEEDS = lambda src: " union all ".join(f"select *, '{i}' as indicator, {e} as value from {src}" for i, e in _SPEED_PARTS.items())
_SPEED_SUMS = lambda m: ", ".join(f"sum({e}{m}) as {n}" for n, e in (("w", "w"), ("k", "w * km"), ("m", "w * d"), ("z", "(case when km = 0 then w else 0 end)")))


@query(
    f"""with {_RD}, t as (select survey, h2 as hh, w, d, km, unnest([mode_group, 'all']) as mode from rt where km is not null), pt as (select survey, mode, count(*) as n, {_SPEED_SUMS("")} from t group by all), rs as (select survey, mode, rep, {_SPEED_SUMS(" * mult")} from t join dr using (survey, hh) group by all),
    p as (select survey, mode, n, indicator, value from ({_SPEEDS("pt")})), ci as (select survey, mode, indicator, {_CI("value")} from ({_SPEEDS("rs")}) group by all)
    select survey, mode, indicator, n, case when n >= {LEAST} then round(value, 6) end as value, {_ENDS()} from p left join ci using (survey, mode, indicator)"""
)
def y_speed_intervals(spark: SparkSession, folder: str) -> DataFrame:
    """Door-to-door speed, length, minutes and share of zero kilometres, by mode, with intervals."""
    rows = _rows(spark, folder)
    t = rows.where("km is not null").select("survey", "hh", "w", "d", "km", F.explode(F.array("mode_group", F.lit("all"))).alias("mode"))
    w, k, d = F.col("w"), F.col("km"), F.col("d")
    sums = {"sw": w, "sk": w * k, "sm": w * d, "sz": F.when(k == 0, w)}
    keys = ["survey", "mode"]
    parts = {"speed_kmh": 60 * safe_div(F.col("sk"), F.col("sm")), "km_per_trip": safe_div(F.col("sk"), F.col("sw")), "min_per_trip": safe_div(F.col("sm"), F.col("sw")), "zero_share": safe_div(F.coalesce("sz", F.lit(0.0)), F.col("sw"))}
    long = lambda df, *more: df.select(*keys, *more, F.explode(F.array(*(F.struct(F.lit(i).alias("indicator"), c.alias("value")) for i, c in parts.items()))).alias("z")).select(*keys, *more, "z.*")
    p = long(t.groupBy(*keys).agg(F.count("*").alias("n"), *(F.sum(c).alias(a) for a, c in sums.items())), "n")
    ci = bs.interval(long(_replicated(rows, t, keys, sums), "rep"), [*keys, "indicator"], F.col("value"), 0.95, REPS)
    return p.join(ci, [*keys, "indicator"], "left").select(*keys, "indicator", "n", *(_shown(c) for c in ("value", "low", "high")))


# --- standardised speeds

#: Lower ends of the distance bands whose mix is held equal, km.
SPEED_BANDS = (0, 2, 5, 10, 20, 50)
#: The later survey is cut here, for before and after.
CUT_DAY = date(2018, 11, 29)
_BAND = "case " + " ".join(f"when km >= {b} then {i}" for i, b in reversed(list(enumerate(SPEED_BANDS)))) + " end"
#: Comparisons as conditions of their sides and of the sample whose mix of trips is held: the surveys with draws of their own and the earlier one's mix; before and after, which share draws, at the other survey's mix or at their own; days with a round at the mix of all days.
_ROLES = {
    "surveys": ("survey = 'J'", "survey = 'P'", "survey = 'J'"),
    "date": (f"survey = 'P' and loaded_at < date '{CUT_DAY}'", f"survey = 'P' and loaded_at >= date '{CUT_DAY}'", "survey = 'J'"),
    "date, own mix": (f"survey = 'P' and loaded_at < date '{CUT_DAY}'", f"survey = 'P' and loaded_at >= date '{CUT_DAY}'", "survey = 'P'"),
    "round days": ("survey = 'J' and is_round", "survey = 'P' and is_round", "survey = 'J'"),
}
_ROLE_SQL = " union all ".join(f"select survey, hh, w, k, h, cell, selection, '{c}' as comparison, '{r}' as role from c0 where {cond}" for c, conds in _ROLES.items() for r, cond in zip(("a", "b", "mix"), conds))
_PIVOT = ", ".join(f"sum({c}) filter (where role = '{r}') as {c}{r}" for r in ("a", "b") for c in "wkh") + ", sum(w) filter (where role = 'mix') as wm"
_SIDE = lambda s: f"case when bool_and(coalesce(w{s} > 0, false)) then sum(coalesce(wm, 0) * k{s} / w{s}) filter (where w{s} > 0) / nullif(sum(coalesce(wm, 0) * h{s} / w{s}) filter (where w{s} > 0), 0) end as speed_{s}"


@query(
    f"""with {_RD}, c0 as (select survey, h2 as hh, loaded_at, is_round, w, w * km as k, w * d / 60 as h, {_BAND} as cell, unnest(['all', case when hour between 7 and 9 or hour between 16 and 19 then 'peak' else 'other hours' end, case when floor(motive) = 9 then 'work' else 'other motive' end]) as selection from rt where mode_group = 'car_driver' and km > 0 and d > 0),
    ca as ({_ROLE_SQL}), ps as (select comparison, selection, cell, {_PIVOT} from ca group by all), cm as (select * from ps where wa > 0 and wb > 0 and wm > 0), p as (select comparison, selection, count(*) as cells, {_SIDE("a")}, {_SIDE("b")} from cm group by all),
    rs as (select comparison, selection, cell, rep, role, sum(w * mult) as w, sum(k * mult) as k, sum(h * mult) as h from ca join dr using (survey, hh) group by all), rp as (select comparison, selection, cell, rep, {_PIVOT} from rs group by all),
    g as (select cm.comparison, cm.selection, cm.cell, r.rep from cm cross join (select unnest(range(0, {REPS})) as rep) r), q as (select comparison, selection, rep, {_SIDE("a")}, {_SIDE("b")} from g left join rp using (comparison, selection, cell, rep) group by all),
    ci as (select comparison, selection, {_CI("speed_b / speed_a")} from q group by all) select comparison, selection, cells, round(speed_a, 6) as speed_a, round(speed_b, 6) as speed_b, round(speed_b / speed_a, 8) as ratio, case when valid >= {0.95 * REPS} then round(low, 8) end as low, case when valid >= {0.95 * REPS} then round(high, 8) end as high from p left join ci using (comparison, selection)"""
)
def y_car_speed_standardised(spark: SparkSession, folder: str) -> DataFrame:
    """Car drivers' speed at an equal mix of distances, for several comparisons and selections, with intervals.

    A household has the same draws in whatever samples it stands, so samples of
    one survey share them and those of two surveys do not.
    """
    rows = _rows(spark, folder)
    h, flag = F.col("hour"), lambda c, a, b: F.when(c, a).otherwise(b)
    band = F.coalesce(*(F.when(F.col("km") >= b, i) for i, b in reversed(list(enumerate(SPEED_BANDS)))))
    pick = F.array(F.lit("all"), flag(h.between(7, 9) | h.between(16, 19), "peak", "other hours"), flag(F.floor("motive") == 9, "work", "other motive"))
    c = rows.where("mode_group = 'car_driver' and km > 0 and d > 0")
    roles = F.array_compact(F.array(*(F.when(F.expr(cond), F.struct(F.lit(n).alias("comparison"), F.lit(r).alias("role"))) for n, conds in _ROLES.items() for r, cond in zip(("a", "b", "mix"), conds))))
    c = c.select("survey", "hh", "w", (F.col("w") * F.col("km")).alias("k"), (F.col("w") * F.col("d") / 60).alias("h"), band.alias("cell"), roles.alias("roles"), F.explode(pick).alias("selection"))
    ca = c.select("survey", "hh", "w", "k", "h", "cell", "selection", F.explode("roles").alias("z")).select("survey", "hh", "w", "k", "h", "cell", "selection", "z.*")
    keys, sums = ["comparison", "selection"], {x: F.col(x) for x in "wkh"}
    cells = ca.groupBy(*keys, "role", "cell").agg(*(F.sum(x).alias(a) for a, x in sums.items()))
    common = dc.common_cells(cells, keys)
    p = dc.standard_speeds(cells, common, keys)
    q = dc.standard_speeds(_replicated(rows, ca, [*keys, "role", "cell"], sums), common, keys, ["rep"])
    ci = bs.interval(q, keys, safe_div(F.col("speed_b"), F.col("speed_a")), 0.95, REPS)
    r = lambda c, k: F.round(c, k)
    return p.join(ci, keys, "left").select(*keys, "cells", r("speed_a", 6).alias("speed_a"), r("speed_b", 6).alias("speed_b"), r(safe_div(F.col("speed_b"), F.col("speed_a")), 8).alias("ratio"), r("low", 8).alias("low"), r("high", 8).alias("high"))


@query(
    f"""with {_RT}, s as (select survey, day_id, w, d, km, unnest(['all', case when floor(motive) = 9 then 'commute' end, case when hour between 7 and 9 then 'morning' when hour between 16 and 19 then 'evening' else 'other hours' end, case when not coalesce(destination_purpose in ('9.4', '9.95'), false) then 'no rounds' end]) as subset from rt where km is not null),
    dy as (select survey, subset, day_id, max(w) as w, count(*) as n, sum(km) as km, sum(d) as d from s where subset is not null group by all) select survey, subset, sum(n)::bigint as trips, count(*) as days, round(60 * sum(w * km) / nullif(sum(w * d), 0), 6) as speed_kmh, round(sum(w * n) / sum(w), 6) as trips_per_day, round(sum(w * km) / sum(w), 6) as km_per_day, round(sum(w * d) / sum(w), 6) as min_per_day from dy group by all"""
)
def y_subset_speeds(spark: SparkSession, folder: str) -> DataFrame:
    """Speeds and daily sums of subsets by purpose and hour; days are summed anew without the trips left out."""
    h = F.col("hour")
    names = F.array(F.lit("all"), F.when(F.floor("motive") == 9, "commute"), F.when(h.between(7, 9), "morning").when(h.between(16, 19), "evening").otherwise("other hours"), F.when(~F.coalesce(F.col("destination_purpose").isin("9.4", "9.95"), F.lit(False)), "no rounds"))
    s = _rows(spark, folder).where("km is not null").select("survey", "day_id", "w", "d", "km", F.explode(F.array_compact(names)).alias("subset"))
    dy = s.groupBy("survey", "subset", "day_id").agg(F.max("w").alias("w"), F.count("*").alias("n"), F.sum("km").alias("km"), F.sum("d").alias("d"))
    w = F.col("w")
    mean = lambda c, a: F.round(safe_div(F.sum(w * F.col(c)), F.sum(w)), 6).alias(a)
    return dy.groupBy("survey", "subset").agg(F.sum("n").alias("trips"), F.count("*").alias("days"), F.round(60 * safe_div(F.sum(w * F.col("km")), F.sum(w * F.col("d"))), 6).alias("speed_kmh"), mean("n", "trips_per_day"), mean("km", "km_per_day"), mean("d", "min_per_day"))


@query(
    f"with {_RT} select survey, mode_group, count(*) as trips, count(*) filter (where km = floor(km)) as whole, round(sum(w * km) / sum(w), 6) as km, round(sum(w * floor(km + 0.5)) / sum(w), 6) as km_whole, round(60 * sum(w * km) / nullif(sum(w * d), 0), 6) as speed_kmh, round(60 * sum(w * floor(km + 0.5)) / nullif(sum(w * d), 0), 6) as speed_whole_kmh, round(sum(w * floor(km + 0.5)) / nullif(sum(w * km), 0) - 1, 8) as effect from rt where km is not null group by all"
)
def y_whole_km(spark: SparkSession, folder: str) -> DataFrame:
    """How much lengths and speeds depend on whole kilometres, halves going up."""
    w, k, d = F.col("w"), F.col("km"), F.col("d")
    whole = F.floor(k + 0.5)
    r = lambda c, a, n=6: F.round(c, n).alias(a)
    return _rows(spark, folder).where("km is not null").groupBy("survey", "mode_group").agg(
        F.count("*").alias("trips"), F.count_if(k == F.floor(k)).alias("whole"), r(safe_div(F.sum(w * k), F.sum(w)), "km"), r(safe_div(F.sum(w * whole), F.sum(w)), "km_whole"),
        r(60 * safe_div(F.sum(w * k), F.sum(w * d)), "speed_kmh"), r(60 * safe_div(F.sum(w * whole), F.sum(w * d)), "speed_whole_kmh"), r(safe_div(F.sum(w * whole), F.sum(w * k)) - 1, "effect", 8),
    )


# --- rates per day


@query(
    f"""with {_RD}, lim as (select min(m) as km from (select survey, max(km) as m from rt group by 1)), dy as (select survey, day_id, min(h2) as hh, max(w) as w, {", ".join(f"count(*) filter (where floor(motive) = {m} and rt.km <= lim.km) as c{m}" for m in range(1, 10))} from rt, lim group by survey, day_id),
    l as (select survey, hh, w, unnest(range(1, 10))::int as motive, unnest([{", ".join(f"c{m}" for m in range(1, 10))}]) as c from dy), pt as (select survey, motive, count(*) as days, count(*) filter (where c = 0) as zero_days, sum(w * c) / sum(w) as rate from l group by all),
    rs as (select survey, motive, rep, sum(w * c * mult) / nullif(sum(w * mult), 0) as rate from l join dr using (survey, hh) group by all), q as (select motive, rep, max(rate) filter (where survey = 'P') - max(rate) filter (where survey = 'J') as e from rs group by all), ci as (select motive, {_CI("e")} from q group by all),
    p as (select motive, sum(days)::bigint as days, sum(zero_days)::bigint as zero_days, max(rate) filter (where survey = 'J') as a, max(rate) filter (where survey = 'P') as b from pt group by 1) select motive, days, zero_days, round(a, 8) as a, round(b, 8) as b, round(b - a, 8) as change, case when valid >= {0.95 * REPS} then round(low, 8) end as low, case when valid >= {0.95 * REPS} then round(high, 8) end as high from p join ci using (motive)"""
)
def y_motive_rates(spark: SparkSession, folder: str) -> DataFrame:
    """Trips a day by motive, of distances that both surveys have; days without such a trip count as zero. Change and interval."""
    rows = _rows(spark, folder)
    limit = rows.groupBy("survey").agg(F.max("km").alias("m")).agg(F.min("m").alias("limit"))  # one row
    motives = range(1, 10)
    c = lambda m: F.count_if((F.floor("motive") == m) & (F.col("km") <= F.col("limit")))
    dy = rows.crossJoin(F.broadcast(limit)).groupBy("survey", "day_id").agg(F.min("hh").alias("hh"), F.max("w").alias("w"), *(c(m).alias(f"c{m}") for m in motives))
    long = dy.select("survey", "hh", "w", F.explode(F.array(*(F.struct(F.lit(m).alias("motive"), F.col(f"c{m}").alias("c")) for m in motives))).alias("z")).select("survey", "hh", "w", "z.*")
    w = F.col("w")
    both = lambda df, keys, cols: dc.side_by_side(df, keys, "survey", "J", "P", cols)
    p = long.groupBy("survey", "motive").agg(F.count("*").alias("days"), F.count_if(F.col("c") == 0).alias("zero"), safe_div(F.sum(w * F.col("c")), F.sum(w)).alias("rate"))
    p = both(p, ["motive"], ("days", "zero", "rate"))
    reps = _replicated(rows, long, ["survey", "motive"], {"t": w * F.col("c"), "sw": w}).withColumn("rate", safe_div(F.col("t"), F.col("sw")))
    ci = bs.interval(both(reps, ["motive", "rep"], ("rate",)), ["motive"], F.col("rate_b") - F.col("rate_a"), 0.95, REPS)
    add = lambda x: (F.coalesce(f"{x}_a", F.lit(0)) + F.coalesce(f"{x}_b", F.lit(0))).cast("long")
    r = lambda c, a: F.round(c, 8).alias(a)
    return p.join(ci, "motive").select("motive", add("days").alias("days"), add("zero").alias("zero_days"), r("rate_a", "a"), r("rate_b", "b"), r(F.col("rate_b") - F.col("rate_a"), "change"), r("low", "low"), r("high", "high"))


@query(
    f"""with {_RT}, v as (select survey, mode_group, sum(w * km) / nullif(sum(w * d), 0) as v from rt where km is not null group by all), f as (select survey, mode_group, w, km, coalesce(km, d * v) as full_km from rt left join v using (survey, mode_group))
    select survey, mode_group, count(*) as trips, count(*) filter (where km is null) as unknown, round(coalesce(sum(w * km), 0), 3) as km, round(coalesce(sum(w * full_km), 0), 3) as km_restored, round(1 - coalesce(sum(w * km), 0) / nullif(sum(w * full_km), 0), 8) as gain from f group by all"""
)
def y_km_restoration(spark: SparkSession, folder: str) -> DataFrame:
    """Unknown distances from the minutes and the mode's speed, as ratio of sums: what they add."""
    rows = _rows(spark, folder)
    w, k = F.col("w"), F.col("km")
    v = rows.where("km is not null").groupBy("survey", "mode_group").agg(safe_div(F.sum(w * k), F.sum(w * F.col("d"))).alias("v"))
    f = rows.join(v, ["survey", "mode_group"], "left").withColumn("full_km", F.coalesce(k, F.col("d") * F.col("v")))
    total = lambda c: F.coalesce(F.sum(w * F.col(c)), F.lit(0.0))
    return f.groupBy("survey", "mode_group").agg(F.count("*").alias("trips"), F.count_if(k.isNull()).alias("unknown"), F.round(total("km"), 3).alias("km"), F.round(total("full_km"), 3).alias("km_restored"), F.round(1 - safe_div(total("km"), F.sum(w * F.col("full_km"))), 8).alias("gain"))


_CALENDAR = "isodow(loaded_at) * 100 + month(loaded_at)"


@query(
    f"""with {_RT}, dy as (select survey, day_id, min({_CALENDAR})::int as cell, max(w) as w, sum(km) as km from rt group by all), c as (select survey, cell, sum(w) as w, sum(w * km) as t from dy where km is not null group by all), x as (select cell, max(w) filter (where survey = 'J') as wa, max(t) filter (where survey = 'J') as ta, max(w) filter (where survey = 'P') as wb, max(t) filter (where survey = 'P') as tb from c group by 1),
    o as (select sum(ta) / sum(wa) as mean_a, sum(tb) / sum(wb) as mean_b, sum(wb * ta / wa) filter (where wa > 0 and wb is not null) / sum(wb) filter (where wa > 0 and wb is not null) as counterfactual, count(*) filter (where wa > 0 and wb is not null) as cells, 1 - sum(wb) filter (where wa > 0 and wb is not null) / sum(wb) as lost_share from x)
    select round(mean_a, 6) as mean_a, round(mean_b, 6) as mean_b, round(counterfactual, 6) as counterfactual, cells, round(lost_share, 8) as lost_share, round(counterfactual - mean_a, 6) as composition, round(mean_b - counterfactual, 6) as behaviour from o"""
)
def y_calendar_effect(spark: SparkSession, folder: str) -> DataFrame:
    """The older survey's kilometres a day at the newer one's mix of weekdays and months."""
    at = (F.weekday("loaded_at") + 1) * 100 + F.month("loaded_at")
    dy = _rows(spark, folder).groupBy("survey", "day_id").agg(F.min(at).alias("cell"), F.max("w").alias("w"), F.sum("km").alias("km")).where("km is not null")
    c = dy.groupBy("survey", "cell").agg(F.sum("w").alias("weight"), F.sum(F.col("w") * F.col("km")).alias("total"))
    out = dc.reweight(c, "J", "P")
    return out.select(*((c if c == "cells" else F.round(c, 8 if c == "lost_share" else 6).alias(c)) for c in ("mean_a", "mean_b", "counterfactual", "cells", "lost_share", "composition", "behaviour")))


_LAG = "date_diff('day', try_strptime(v2_datesemref, '%d/%m/%Y')::date, try_strptime(mdatenq2v, '%d/%m/%Y')::date)"


@query(
    f"""with {_RT}, ps as (select k, lag from (select {key_sql("ident_ind")} as k, {_LAG} as lag, row_number() over (partition by {key_sql("ident_ind")} order by rec_id) as rn from k_individu where {key_sql("ident_ind")} is not null) where rn = 1),
    t as (select case when lag is null then 'unknown' when lag <= 2 then '0-2' when lag <= 7 then '3-7' else '8+' end as recall, rt.day_id, rt.w, rt.km, rt.d from rt left join ps on ps.k = {key_sql("rt.ident_ind")} where survey = 'J'), dy as (select recall, day_id, max(w) as w, sum(km) as km, sum(d) as d, count(*) as n from t group by all),
    g as (select recall, count(*) as days, sum(w * coalesce(km, 0)) / sum(w) as km_per_day, sum(w * n) / sum(w) as trips_per_day from dy group by 1), b as (select sum(w * coalesce(km, 0)) / sum(w) as all_km from dy)
    select recall, days, round(km_per_day, 6) as km_per_day, round(trips_per_day, 6) as trips_per_day, round(km_per_day / nullif(all_km, 0) - 1, 8) as effect from g, b"""
)
def y_recall_effect(spark: SparkSession, folder: str) -> DataFrame:
    """Kilometres and trips a day of the older survey by the days between the week asked about and the interview, against all of its days."""
    d = lambda c: F.expr(f"try_to_date({c}, 'dd/MM/yyyy')")
    i = table(spark, folder, "k_individu", "rec_id", "ident_ind", "mdatenq2v", "v2_datesemref").withColumn("k", norm_key(F.col("ident_ind"))).where("k is not null")
    i = first_per_key(i, ["k"], ["rec_id"]).select("k", F.datediff(d("mdatenq2v"), d("v2_datesemref")).alias("lag"))
    lag = F.col("lag")
    recall = F.when(lag.isNull(), "unknown").when(lag <= 2, "0-2").when(lag <= 7, "3-7").otherwise("8+")
    t = _rows(spark, folder).where("survey = 'J'").withColumn("k", norm_key(F.col("ident_ind"))).join(i, "k", "left")
    dy = t.groupBy(recall.alias("recall"), "day_id").agg(F.max("w").alias("w"), F.coalesce(F.sum("km"), F.lit(0.0)).alias("km"), F.count("*").alias("n"))
    w = F.col("w")
    every = F.sum("s_km").over(W.partitionBy()) / F.sum("s_w").over(W.partitionBy())  # four rows
    g = dy.groupBy("recall").agg(F.count("*").alias("days"), F.sum(w).alias("s_w"), F.sum(w * F.col("km")).alias("s_km"), F.sum(w * F.col("n")).alias("s_n"))
    r = lambda e, n, k=6: F.round(e, k).alias(n)
    return g.select("recall", "days", r(F.col("s_km") / F.col("s_w"), "km_per_day"), r(F.col("s_n") / F.col("s_w"), "trips_per_day"), r(safe_div(F.col("s_km") / F.col("s_w"), every) - 1, "effect", 8))


@query(
    f"""with {DAYS}, g as (select survey, income, density, grouping(density)::int as all_densities, count(*) as n, sum(w * x) / sum(w) as minutes, sum(w * n) / sum(w) as trips, sum(w * e) filter (where isfinite(e)) / sum(w) filter (where isfinite(e)) as kj, coalesce(sum(w) filter (where mode = 'car_driver'), 0) / sum(w) as car_share from days group by grouping sets ((survey, income), (survey, income, density)))
    select survey, income, density, all_densities, n, case when n < {LEAST} then 'blank' when n < {CAUTION} then 'caution' else 'ok' end as reading, {", ".join(f"case when n >= {LEAST} then round({c}, {k}) end as {c}" for c, k in (("minutes", 6), ("trips", 6), ("kj", 4), ("car_share", 8)))} from g"""
)
def y_income_metrics(spark: SparkSession, folder: str) -> DataFrame:
    """Minutes, trips, energy and the share of driving days by income class, and by income and density."""
    w, e = F.col("w"), F.col("e")
    mean = lambda c: safe_div(F.sum(w * F.col(c)), F.sum(w))
    g = days(spark, folder).groupingSets([["survey", "income"], ["survey", "income", "density"]], "survey", "income", "density").agg(
        F.grouping("density").cast("int").alias("all_densities"), F.count("*").alias("cell_n"), mean("x").alias("minutes"), mean("n").alias("trips"), safe_div(F.sum(F.when(finite(e), w * e)), F.sum(F.when(finite(e), w))).alias("kj"), safe_div(F.coalesce(F.sum(F.when(F.col("mode") == "car_driver", w)), F.lit(0.0)), F.sum(w)).alias("car_share")
    )
    n = F.col("n")
    g = g.withColumnRenamed("cell_n", "n")
    return g.select("survey", "income", "density", "all_densities", "n", F.when(n < LEAST, "blank").when(n < CAUTION, "caution").otherwise("ok").alias("reading"), *(_shown(c, digits=k) for c, k in (("minutes", 6), ("trips", 6), ("kj", 4), ("car_share", 8))))


@query(
    f"""with {DAYS}, m as (select survey, mode, sum(w) as w, sum(w * x) as t, sum(w * greatest(x - case when x % 15 = 0 then 7.5 else 0 end, 0)) as lo, sum(w * (x + case when x % 15 = 0 then 7.5 else 0 end)) as hi from days group by all), s as (select *, w / sum(w) over (partition by survey) as p from m), c as (select mode, coalesce(max(p) filter (where survey = 'a'), 0) as pa, coalesce(max(p) filter (where survey = 'b'), 0) as pb, max(t / w) filter (where survey = 'a') as ta, max(t / w) filter (where survey = 'b') as tb, max(lo / w) filter (where survey = 'b') as least, max(hi / w) filter (where survey = 'b') as most from s group by 1),
    f as (select *, coalesce(ta, tb) as a, coalesce(tb, ta) as b from c) select mode, round(pa, 8) as share_a, round(pb, 8) as share_b, round((pb - pa) * (a + b) / 2, 8) as composition, round((b - a) * (pa + pb) / 2, 8) as level, round(sum(pb * b - pa * a) over (), 8) as national, round(least, 6) as least_b, round(most, 6) as most_b from f"""
)
def y_mode_gap(spark: SparkSession, folder: str) -> DataFrame:
    """The change of the national mean by mode, split without a rest into composition and level; the bounds that rounding to quarter hours leaves."""
    w, x = F.col("w"), F.col("x")
    off = F.when(x % 15 == 0, 7.5).otherwise(0.0)
    m = days(spark, folder).groupBy("survey", "mode").agg(F.sum("w").alias("sw"), *((F.sum(w * c) / F.sum(w)).alias(a) for a, c in (("t", x), ("lo", F.greatest(x - off, F.lit(0.0))), ("hi", x + off))))
    m = m.withColumn("p", F.col("sw") / F.sum("sw").over(W.partitionBy("survey")))  # one row per mode
    c = dc.side_by_side(m, ["mode"], "survey", "a", "b", ("p", "t", "lo", "hi"))
    pa, pb = F.coalesce("p_a", F.lit(0.0)), F.coalesce("p_b", F.lit(0.0))
    a, b = F.coalesce("t_a", "t_b"), F.coalesce("t_b", "t_a")
    r = lambda e, n, k=8: F.round(e, k).alias(n)
    return c.select("mode", r(pa, "share_a"), r(pb, "share_b"), r((pb - pa) * (a + b) / 2, "composition"), r((b - a) * (pa + pb) / 2, "level"), r(F.sum(pb * b - pa * a).over(W.partitionBy()), "national"), r("lo_b", "least_b", 6), r("hi_b", "most_b", 6))


_FIT = lambda y: f"(sum(w) * sum(w * km * {y}) - sum(w * km) * sum(w * {y})) / nullif(sum(w) * sum(w * km * km) - sum(w * km) * sum(w * km), 0)"


@query(
    f"""with {_legs_sql("declared")}, l as (select mode_group, pond_jour as w, distance_km as km, duration_min as m, energy_kh_kj as e from legs where {_FINITE_TRIP} and isfinite(pond_jour) and pond_jour > 0 and distance_km >= 0 and energy_kh_kj is not null), f as (select mode_group, count(*) as trips, sum(w) as sw, sum(w * km) as sk, sum(w * m) as sm, sum(w * e) as se, {_FIT("m")} as min_per_km, {_FIT("e")} as kj_per_km from l group by 1),
    g as (select *, (sm - min_per_km * sk) / sw as terminal_min, (se - kj_per_km * sk) / sw as terminal_kj from f) select g.mode_group, g.trips, round(g.terminal_min, 5) as terminal_min, round(g.min_per_km, 6) as min_per_km, round(g.terminal_kj, 3) as terminal_kj, round(g.kj_per_km, 4) as kj_per_km, round(case when (c.terminal_kj - g.terminal_kj) / nullif(g.kj_per_km - c.kj_per_km, 0) > 0 then (c.terminal_kj - g.terminal_kj) / (g.kj_per_km - c.kj_per_km) end, 4) as iso_energy_km from g cross join (select * from g where mode_group = 'car_driver') c"""
)
def y_affine_legs(spark: SparkSession, folder: str) -> DataFrame:
    """A terminal and a per-kilometre part of minutes and energy by mode, by weighted least squares; the distance at which a mode costs what driving does."""
    d, k, p = F.col("duration_min"), F.col("distance_km_declared"), F.col("pond_jour")
    l = legs.trip_legs(trips(spark, folder)).where(finite(d) & d.between(0, 1440) & (k.isNull() | finite(k)) & finite(p) & (p > 0) & (F.col("distance_km") >= 0) & F.col("energy_kh_kj").isNotNull())  # noqa: E741
    w, x = F.col("pond_jour"), F.col("distance_km")
    y = {"min": F.col("duration_min"), "kj": F.col("energy_kh_kj")}
    s = l.groupBy("mode_group").agg(F.count("*").alias("trips"), F.sum(w).alias("s"), F.sum(w * x).alias("sx"), F.sum(w * x * x).alias("sxx"), *(c for n, v in y.items() for c in (F.sum(w * v).alias(f"s_{n}"), F.sum(w * x * v).alias(f"sx_{n}"))))
    c = F.col
    slope = lambda n: safe_div(c("s") * c(f"sx_{n}") - c("sx") * c(f"s_{n}"), c("s") * c("sxx") - c("sx") * c("sx"))
    f = s.withColumns({f"{n}_per_km": slope(n) for n in y}).withColumns({f"terminal_{n}": safe_div(c(f"s_{n}") - c(f"{n}_per_km") * c("sx"), c("s")) for n in y})
    car = f.where("mode_group = 'car_driver'").select(c("terminal_kj").alias("ct"), c("kj_per_km").alias("ck"))  # one row
    iso = safe_div(c("ct") - c("terminal_kj"), c("kj_per_km") - c("ck"))
    r = lambda e, n, k: F.round(e, k).alias(n)
    return f.crossJoin(F.broadcast(car)).select("mode_group", "trips", r("terminal_min", "terminal_min", 5), r("min_per_km", "min_per_km", 6), r("terminal_kj", "terminal_kj", 3), r("kj_per_km", "kj_per_km", 4), r(F.when(iso > 0, iso), "iso_energy_km", 4))


# --- lists for review, and frames

#: Share of covered stops from which a line needs no review.
REVIEW_GATE = 0.9


@query(
    f"""with c as ({feed_queries.SQL["t_cut_ends"]}), l as (select substr(day_id, 1, 1) as network, share, case when outcome = 'dropped' then 'dropped' when flagged then 'gap' else outcome end as reason, case when share >= {REVIEW_GATE} then 'automatic' else 'review' end as list from c),
    g as (select network, list, reason, count(*) as lines, round(min(share), 8) as least_share from l group by all) select *, row_number() over (order by case reason when 'dropped' then 0 when 'gap' then 1 when 'cut' then 2 else 3 end, list desc, network)::int as place from g"""
)
def t_review_lists(spark: SparkSession, folder: str) -> DataFrame:
    """Lines split by the coverage gate, with what is wrong with them, the worst first."""
    c = feed_queries.t_cut_ends(spark, folder)
    reason = F.when(F.col("outcome") == "dropped", "dropped").when(F.col("flagged"), "gap").otherwise(F.col("outcome"))
    g = feeds.review_lists(c.withColumn("network", F.substring("day_id", 1, 1)).withColumn("reason", reason), "share", REVIEW_GATE).groupBy("network", "list", "reason").agg(F.count("*").alias("lines"), F.round(F.min("share"), 8).alias("least_share"))
    # A few rows: networks, two lists, four reasons.
    return g.withColumn("place", F.row_number().over(W.orderBy(feeds.severity(F.col("reason"), ("dropped", "gap", "cut")), F.col("list").desc(), "network")))


_STATES, _CHANGES = ("keep", "modify", "remove"), ("new_line", "reopening", "extension", "new_station", "restructuring", "suspension")


@query(
    f"""with g as (select state, change from (select unnest([{", ".join(f"'{s}'" for s in _STATES)}]) as state), (select unnest([{", ".join(f"'{s}'" for s in _CHANGES)}]) as change)), i as (select *, case when state = 'remove' then case when change in ('new_line', 'reopening') then 'drop' when change = 'extension' then 'cut' when change = 'new_station' then 'new_station' end end as instruction from g)
    select state, change, instruction, coalesce(instruction = 'drop', false) as removed, state = 'remove' and instruction is null as unhandled from i"""
)
def t_instructions(spark: SparkSession, folder: str) -> DataFrame:
    """What a change and its state on a date make of a line: dropped, cut, without a station, or as it is."""
    grid = lambda name, values: spark.createDataFrame([(v,) for v in values], f"{name} string")
    g = grid("state", _STATES).crossJoin(grid("change", _CHANGES))  # values of an enumeration
    g = g.withColumn("instruction", feeds.edit_instruction(F.col("state"), F.col("change")))
    return g.select("state", "change", "instruction", F.coalesce(F.col("instruction") == "drop", F.lit(False)).alias("removed"), ((F.col("state") == "remove") & F.col("instruction").isNull()).alias("unhandled"))


@query(
    """with f as (select rec_id, list_distinct(list_filter(string_split(dataset_slug, '-'), lambda x: length(x) > 2)) as areas from gtfs_multiple_resources where dataset_slug is not null), a as (select distinct lower(strip_accents(unnest(string_split(network, ' ')))) as authority from pt_openings_mapping where network is not null),
    e as (select unnest(areas) as authority, len(areas) as n, rec_id from f) select a.authority, case when min(n) = 3 then 'dedicated' when min(n) is not null then 'indirect' else 'uncovered' end as coverage, count(distinct rec_id) as feeds from a left join e using (authority) where length(a.authority) > 2 group by 1"""
)
def t_area_coverage(spark: SparkSession, folder: str) -> DataFrame:
    """Whether an authority has a feed of its own, shares one or has none, from the feeds' JSON lists of areas.

    The tables have no such lists: words of the feeds' slugs stand for areas, and three of them for a feed of one authority.
    """
    slug = F.array_distinct(F.filter(F.split("dataset_slug", "-"), lambda x: F.length(x) > 2))
    f = table(spark, folder, "gtfs_multiple_resources", "rec_id", "dataset_slug").where("dataset_slug is not null").select("rec_id", F.to_json(slug).alias("areas"))
    a = table(spark, folder, "pt_openings_mapping", "network").where("network is not null").select(F.explode(F.split("network", " ")).alias("a")).select(F.lower(ascii_fold(F.col("a"))).alias("authority")).where("length(authority) > 2").distinct()
    return feeds.area_coverage(a, f, "rec_id", 3)


@query(
    f"""with {DAYS}, {TRIPS}, t as (select day_id, count(*) as listed, sum(distance_km_declared) filter (where isfinite(distance_km_declared)) as km, count(*) filter (where mobloc = 1) as local from trips group by 1)
    select d.day_id, d.survey, d.category, d.w, d.n as trips, coalesce(t.listed, 0) as listed, coalesce(t.local, 0) as local_trips, round(t.km, 6) as km from days d left join t using (day_id) where d.typejour = 1"""
)
def s_weekday_frames(spark: SparkSession, folder: str) -> DataFrame:
    """Frame of described weekdays for reports: every day with its listed trips, also where there are none."""
    k = F.col("distance_km_declared")
    t = trips(spark, folder).groupBy("day_id").agg(F.count("*").alias("listed"), F.sum(F.when(finite(k), k)).alias("km"), F.count_if(F.col("mobloc") == 1).alias("local"))
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long"))
    d = days(spark, folder).where("typejour = 1").select("day_id", "survey", "category", "w", F.col("n").alias("trips"))
    return d.join(t, "day_id", "left").select("day_id", "survey", "category", "w", "trips", zero("listed").alias("listed"), zero("local").alias("local_trips"), F.round("km", 6).alias("km"))
