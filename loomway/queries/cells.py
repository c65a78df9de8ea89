"""Statistics by cells with intervals: quartiles, budgets by day type, decile tables, tails, catalogues of groupings; conditional existence, cubes and distances from lines."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomway.functions import grid as gr
from loomway.functions.exprs import finite, safe_div
from loomway.operators import bootstrap as bs
from loomway.operators import decompose as dc
from loomway.operators import weighted as wt
from loomway.operators.lines import near_lines
from loomway.operators.relational import first_per_key
from loomway.plans.scope_cube import LEAST
from loomway.queries.base import DAYS, TRIPS, days, registry, trips
from loomway.queries.feeds import _laea, _projected
from loomway.queries.reports import _CI, _RT, _rows, _shown
from loomway.queries.stats import _BOTH, REPS, merge_sql, replicated, x_level_merge
from loomway.tables import table

QUERIES, SQL, query = registry()

_DRAWN = "(select days.*, rep, mult from da as days join dra using (hh) union all select days.*, rep, mult from db as days join drb using (hh))"
_VALID = f"valid >= {0.95 * REPS}"
_QUARTERS = (0.25, 0.5, 0.75)
_P3 = "(select unnest([0.25, 0.5, 0.75])::double as p)"


def _step(groups: str, source: str) -> str:
    """Weighted quartiles by the step rule of (groups, v, w)."""
    return f"select {groups}, p, coalesce(min(v) filter (where upto >= p * total), max(v)) as value from (select *, sum(w) over (partition by {groups} order by v rows unbounded preceding) as upto, sum(w) over (partition by {groups}) as total from {source}), {_P3} where total > 0 group by {groups}, p"


@query(
    f"""with {_BOTH}, s as (select survey, band, x as v, sum(w) as w from days group by all), n as (select survey, band, count(*) as n from days group by all), pt as ({_step("survey, band", "s")}), rs as (select survey, band, x as v, rep, sum(w * mult) as w from {_DRAWN} group by all), q as ({_step("survey, band, rep", "rs")}), ci as (select survey, band, p, {_CI("value")} from q group by all)
    select survey, band, p, n, case when n >= {LEAST} then round(value, 6) end as value, case when n >= {LEAST} and {_VALID} then round(low, 6) end as low, case when n >= {LEAST} and {_VALID} then round(high, 6) end as high from pt join n using (survey, band) join ci using (survey, band, p)"""
)
def x_group_statistics(spark: SparkSession, folder: str) -> DataFrame:
    """Weighted quartiles of minutes by age band, with household-bootstrap intervals."""
    d, g = days(spark, folder), ["survey", "band"]
    point = wt.quantiles_step(wt.running(d, g, "x", "w"), g, _QUARTERS)
    reps = replicated(d.withColumn("v", F.col("x")), ["band", "v"], {"w": F.col("w")})
    # A replicate has one row for each value of minutes.
    of = W.partitionBy(*g, "rep")
    run = reps.withColumns({"upto": F.sum("w").over(of.orderBy("v").rowsBetween(W.unboundedPreceding, 0)), "total": F.sum("w").over(of)}).where("total > 0")
    ci = bs.interval(wt.quantiles_step(run, [*g, "rep"], _QUARTERS), [*g, "p"], F.col("value"), 0.95, REPS)
    n = d.groupBy(*g).agg(F.count("*").alias("n"))
    return point.join(n, g).join(ci, [*g, "p"]).select(*g, "p", "n", *(_shown(c) for c in ("value", "low", "high")))


@query(
    f"""with recursive {DAYS}, c as (select n, count(*)::bigint as days from days group by 1), {merge_sql("", "n", "days", "c", 100)}, p as (select days.survey, list_max(list_filter(firsts, lambda f: f <= n)) as level, w, x from days, (select arg_min(firsts, len(firsts)) as firsts from m) where x > 0),
    g as (select level, count(*) as n, sum(w * ln(x)) / sum(w) as m from p group by 1) select level, n, round(m - (select arg_min(m, level) from g), 6) as estimate, round(100 * (exp(m - (select arg_min(m, level) from g)) - 1), 4) as effect_pct from g"""
)
def x_pooled_levels(spark: SparkSession, folder: str) -> DataFrame:
    """Effects of the number of trips on log minutes against its lowest level, after levels of few days are pooled: the weighted regression on their dummies is one mean for each."""
    d = days(spark, folder)
    pooled = x_level_merge(spark, folder)  # one row for each number of trips
    rows = d.where("x > 0").join(F.broadcast(pooled), d["n"] == pooled["level"]).select(F.col("cluster").alias("level"), "w", "x")
    g = rows.groupBy("level").agg(F.count("*").alias("n"), safe_div(F.sum(F.col("w") * F.ln("x")), F.sum("w")).alias("m"))
    off = F.col("m") - F.min_by("m", "level").over(W.partitionBy())  # a few levels
    return g.select("level", "n", F.round(off, 6).alias("estimate"), F.round(100 * (F.exp(off) - 1), 4).alias("effect_pct"))


#: Days of a week by the kind of the described day.
PERIODS = {1: 5, 2: 1, 3: 1}


@query(
    f"""with {DAYS}, ppl as (select survey, category, sum(pw) as persons from (select survey, category, hh, max(w) as pw from days group by all) group by all), t as (select survey, category, typejour::int as day_type, count(*) as n, sum(w * x) as num from days where typejour in (1, 2, 3) group by all)
    select survey, category, day_type, n, case when n >= {LEAST} then round(num / nullif(persons * case day_type {" ".join(f"when {k} then {v}" for k, v in PERIODS.items())} end, 0), 6) end as minutes_per_person from t join ppl using (survey, category)"""
)
def x_person_budget(spark: SparkSession, folder: str) -> DataFrame:
    """Minutes per person and day by kind of day and category; cells of few days are blank."""
    d = days(spark, folder)
    people = d.groupBy("survey", "category", "hh").agg(F.max("w").alias("pw")).groupBy("survey", "category").agg(F.sum("pw").alias("persons"))
    t = d.where(F.col("typejour").isin(1.0, 2.0, 3.0)).groupBy("survey", "category", F.col("typejour").cast("int").alias("day_type")).agg(F.count("*").alias("n"), F.sum(F.col("w") * F.col("x")).alias("num"))
    period = F.coalesce(*(F.when(F.col("day_type") == k, F.lit(v)) for k, v in PERIODS.items()))
    rows = t.join(people, ["survey", "category"]).withColumn("minutes_per_person", safe_div(F.col("num"), F.col("persons") * period))
    return rows.select("survey", "category", "day_type", "n", _shown("minutes_per_person"))


@query(
    f"""with {_RT}, dw as (select survey, sum(w) as dw from (select survey, day_id, max(w) as w from rt group by all) group by 1), g as (select survey, mode_group as grp, sum(w) as w, sum(w * d) as m, sum(w) filter (where km is not null) as kw, sum(w * km) as k, sum(w * d) filter (where km is not null) as km_m from rt group by all),
    s as (select grp, survey, w / sum(w) over (partition by survey) as share, m / w as t, k / nullif(kw, 0) as l, km_m / nullif(k, 0) as pace, (m / w) / nullif(km_m / nullif(kw, 0), 0) as r, sum(w) over (partition by survey) / dw as per_day from g join dw using (survey)),
    p as (select grp, {", ".join(f"max({c}) filter (where survey = '{s}') as {c}{n}" for c in ("share", "t", "l", "pace", "r", "per_day") for s, n in (("J", "a"), ("P", "b")))} from s group by 1), f as (select *, sharea * per_dayb * case when abs(ln(tb / ta)) < 1e-14 then ta else (tb - ta) / ln(tb / ta) end as k from p where ta > 0 and tb > 0 and la > 0 and lb > 0 and pacea > 0 and paceb > 0)
    select grp, round(sharea * (tb - ta) * per_dayb, 6) as within, round(k * ln(lb / la), 6) as km, round(k * ln(paceb / pacea), 6) as pace, round(k * ln(rb / ra), 6) as selection from f"""
)
def x_shift_share_within(spark: SparkSession, folder: str) -> DataFrame:
    """The part of a mode's change that lies within it, split without a rest into kilometres, minutes per kilometre and what is known of part of the trips only."""
    rows = _rows(spark, folder)
    w, d, k = F.col("w"), F.col("d"), F.col("km")
    known = k.isNotNull()
    dw = rows.groupBy("survey", "day_id").agg(F.max("w").alias("w")).groupBy("survey").agg(F.sum("w").alias("dw"))
    g = rows.groupBy("survey", F.col("mode_group").alias("grp")).agg(F.sum(w).alias("sw"), F.sum(w * d).alias("sm"), F.sum(F.when(known, w)).alias("kw"), F.sum(w * k).alias("sk"), F.sum(F.when(known, w * d)).alias("km_m")).join(dw, "survey")
    of = W.partitionBy("survey")  # one row for each mode
    s = g.withColumns({"share": F.col("sw") / F.sum("sw").over(of), "t": F.col("sm") / F.col("sw"), "l": safe_div(F.col("sk"), F.col("kw")), "pace": safe_div(F.col("km_m"), F.col("sk")), "r": safe_div(F.col("sm") / F.col("sw"), safe_div(F.col("km_m"), F.col("kw"))), "per_day": F.sum("sw").over(of) / F.col("dw")})
    p = dc.side_by_side(s, ["grp"], "survey", "J", "P", ("share", "t", "l", "pace", "r", "per_day")).where("t_a > 0 and t_b > 0 and l_a > 0 and l_b > 0 and pace_a > 0 and pace_b > 0")
    c = lambda x: (F.col(f"{x}_a"), F.col(f"{x}_b"))
    scale = F.col("share_a") * F.col("per_day_b")
    terms = dc.log_terms(*c("t"), {"km": (*c("l"), 1), "pace": (*c("pace"), 1), "selection": (*c("r"), 1)})
    return p.select("grp", F.round(F.col("share_a") * (F.col("t_b") - F.col("t_a")) * F.col("per_day_b"), 6).alias("within"), *(F.round(scale * t, 6).alias(n) for n, t in terms.items()))


@query(f"with {DAYS}, c as (select mode || '|' || income as cell, sum(w) filter (where survey = 'a') as wa, sum(w * x) filter (where survey = 'a') as ta, sum(w) filter (where survey = 'b') as wb from days where mode <> 'unknown' group by 1) select round(sum(wb * ta / wa) / sum(wb), 6) as value from c where wb > 0")
def x_joint_mix(spark: SparkSession, folder: str) -> DataFrame:
    """Survey a at b's joint mix of modes and incomes; a cell without support would be an error."""
    c = days(spark, folder).where("mode != 'unknown'").groupBy("survey", F.concat_ws("|", "mode", "income").alias("cell")).agg(F.sum("w").alias("weight"), F.sum(F.col("w") * F.col("x")).alias("total"))
    return dc.to_joint_mix(c).select(F.round("value", 6).alias("value"))


#: The groupings that are compared.
CATALOGUE = ("mode", "income", "density", "band", "category")


def _grouping_sql(g: str) -> str:
    return f"""select '{g}' as grouping, count(*) as cells, count(*) filter (where least(na, nb) < {LEAST}) as thin, round(sum(wb * (tb / wb - mb) * (tb / wb - mb)) / sum(wb), 6) as between_b, round(sum(wb) filter (where (tb / wb) / (ta / wa) between 1 / 1.1 and 1.1) / sum(wb), 8) as equivalent_share, round(sum(wb * ta / wa) / sum(wb), 6) as counterfactual, round(any_value(mb), 6) as mean_b
      from (select *, sum(tb) over () / sum(wb) over () as mb from (select {g}, count(*) filter (where survey = 'a') as na, count(*) filter (where survey = 'b') as nb, sum(w) filter (where survey = 'a') as wa, sum(w) filter (where survey = 'b') as wb, sum(w * x) filter (where survey = 'a') as ta, sum(w * x) filter (where survey = 'b') as tb from days group by 1) where wa > 0 and wb > 0 and ta > 0)"""


@query(f"with {DAYS} " + " union all ".join(_grouping_sql(g) for g in CATALOGUE))
def y_grouping_catalogue(spark: SparkSession, folder: str) -> DataFrame:
    """Every grouping of the catalogue: its cells, those with few days, what lies between them, how much of b keeps a's level, and b at a's levels."""
    d = days(spark, folder)
    each = F.explode(F.array(*(F.struct(F.lit(g).alias("grouping"), F.col(g).alias("cell")) for g in CATALOGUE))).alias("z")
    s = d.select("survey", "w", "x", each).select("survey", "w", "x", "z.*").groupBy("grouping", "cell", "survey").agg(F.count("*").alias("n"), F.sum("w").alias("sw"), F.sum(F.col("w") * F.col("x")).alias("t"))
    c = dc.side_by_side(s, ["grouping", "cell"], "survey", "a", "b", ("n", "sw", "t")).where("sw_a > 0 and sw_b > 0 and t_a > 0")
    of = W.partitionBy("grouping")  # a few cells
    c = c.withColumn("mb", F.sum("t_b").over(of) / F.sum("sw_b").over(of))
    wb, a, b = F.col("sw_b"), F.col("t_a") / F.col("sw_a"), F.col("t_b") / F.col("sw_b")
    off = b - F.col("mb")
    r = lambda e, n, k=6: F.round(e, k).alias(n)
    return c.groupBy("grouping").agg(F.count("*").alias("cells"), F.count_if(F.least("n_a", "n_b") < LEAST).alias("thin"), r(F.sum(wb * off * off) / F.sum(wb), "between_b"), r(F.sum(F.when((b / a).between(1 / 1.1, 1.1), wb)) / F.sum(wb), "equivalent_share", 8), r(F.sum(wb * a) / F.sum(wb), "counterfactual"), r(F.max("mb"), "mean_b"))


@query(
    f"""with {TRIPS}, k as (select ident_dep, v2_mmotifdes as old from (select *, row_number() over (partition by ident_dep order by rec_id) as rn from k_deploc where ident_dep is not null) where rn = 1)
    select old, destination_motive as new, count(*) as trips, round(count(*) / sum(count(*)) over (partition by old), 8) as share from k join trips using (ident_dep) group by old, destination_motive"""
)
def x_motive_crosswalk(spark: SparkSession, folder: str) -> DataFrame:
    """Purposes of the older survey's raw trips against the motives they have in the common table, with shares of each."""
    k = first_per_key(table(spark, folder, "k_deploc", "rec_id", "ident_dep", "v2_mmotifdes").where("ident_dep is not null"), ["ident_dep"], ["rec_id"]).select("ident_dep", F.col("v2_mmotifdes").alias("old"))
    g = k.join(trips(spark, folder).select("ident_dep", F.col("destination_motive").alias("new")), "ident_dep").groupBy("old", "new").agg(F.count("*").alias("trips"))
    return g.withColumn("share", F.round(F.col("trips") / F.sum("trips").over(W.partitionBy("old")), 8))  # one row for each pair of codes


_BANDS_KM = (0, 2, 5, 10, 20)
_KM_BAND = "case " + " ".join(f"when km >= {b} then {i}" for i, b in reversed(list(enumerate(_BANDS_KM)))) + " end"
_TENTHS = tuple(i / 10 for i in range(1, 10))


@query(
    f"""with {_RT}, t as (select survey, {_KM_BAND} as band, d as v, w from rt where km is not null and d > 0), s as (select survey, band, v, sum(w) as w from t group by all), r as (select *, sum(w) over (partition by survey, band order by v rows unbounded preceding) as upto, sum(w) over (partition by survey, band) as total from s),
    q as (select survey, band, p, coalesce(min(v) filter (where upto >= p * total), max(v)) as minutes from r, (select unnest([{", ".join(map(str, _TENTHS))}])::double as p) group by survey, band, p), m as (select survey, band, count(*) as trips, round(avg((v % 15 = 0)::int::double), 8) as multiples_15, round(avg((v % 30 = 0)::int::double), 8) as multiples_30 from t group by all)
    select survey, band, p, round(minutes, 6) as minutes, trips, multiples_15, multiples_30 from q join m using (survey, band)"""
)
def y_duration_deciles(spark: SparkSession, folder: str) -> DataFrame:
    """Weighted deciles of minutes and the shares of quarter and half hours, within distance bands."""
    band = F.coalesce(*(F.when(F.col("km") >= b, i) for i, b in reversed(list(enumerate(_BANDS_KM)))))
    t = _rows(spark, folder).where("km is not null and d > 0").select("survey", band.alias("band"), "d", "w")
    g, share = ["survey", "band"], lambda k: F.round(F.avg((F.col("d") % k == 0).cast("int").cast("double")), 8).alias(f"multiples_{k}")
    q = wt.quantiles_step(wt.running(t, g, "d", "w"), g, _TENTHS)
    return q.join(t.groupBy(*g).agg(F.count("*").alias("trips"), share(15), share(30)), g).select(*g, "p", F.round("value", 6).alias("minutes"), "trips", "multiples_15", "multiples_30")


@query(
    f"""with {DAYS}, g as (select survey, density, income, count(*) as n, sum(w) filter (where x > 180) / sum(w) as share, sum(w * x) filter (where x > 180) / sum(w) as minutes, sum(w * x) / sum(w) as mean from days group by all)
    select survey, density, income, n, {", ".join(f"case when n >= {LEAST} then round(coalesce({c}, 0), {k}) end as {c}" for c, k in (("share", 8), ("minutes", 6), ("mean", 6)))} from g"""
)
def y_tail_cells(spark: SparkSession, folder: str) -> DataFrame:
    """Share of days above three hours and the minutes they give, by density and income."""
    w, x = F.col("w"), F.col("x")
    far = F.when(x > 180, w)
    g = days(spark, folder).groupBy("survey", "density", "income").agg(F.count("*").alias("n"), *(safe_div(F.coalesce(F.sum(c), F.lit(0.0)), F.sum(w)).alias(a) for a, c in (("share", far), ("minutes", far * x), ("mean", w * x))))
    return g.select("survey", "density", "income", "n", _shown("share", digits=8), _shown("minutes"), _shown("mean"))


def _distance(at: str, source: str) -> str:
    return f"""select {at} max(abs(fa - fb)) as ks from (select {at} sum(a) over o / nullif(sum(a) over p, 0) as fa, sum(b) over o / nullif(sum(b) over p, 0) as fb from (select {at} v, coalesce(sum(w) filter (where survey = 'a'), 0) as a, coalesce(sum(w) filter (where survey = 'b'), 0) as b from {source} group by all) window o as ({"partition by " + at.rstrip(", ") if at else ""} order by v rows unbounded preceding), p as ({"partition by " + at.rstrip(", ") if at else ""})) {"group by " + at.rstrip(", ") if at else ""}"""


@query(
    f"""with {_BOTH}, s as (select survey, x as v, w from days), pt as ({_distance("", "s")}), rs as (select survey, x as v, rep, w * mult as w from {_DRAWN}), q as ({_distance("rep, ", "rs")})
    select round((select ks from pt), 8) as ks, round(quantile_cont(ks, 0.025), 8) as low, round(quantile_cont(ks, 0.5), 8) as middle, round(quantile_cont(ks, 0.975), 8) as high, count(ks) as valid from q"""
)
def x_ks_intervals(spark: SparkSession, folder: str) -> DataFrame:
    """Distance of both surveys' distributions of minutes, with its interval from draws paired by replicate over one support."""

    def distance(rows: DataFrame, at: list[str]) -> DataFrame:
        s = rows.groupBy(*at, "v").agg(*(F.coalesce(F.sum(F.when(F.col("survey") == x, F.col("w"))), F.lit(0.0)).alias(x) for x in "ab"))
        # One row for each value of minutes.
        of = W.partitionBy(*at)
        share = lambda x: safe_div(F.sum(x).over(of.orderBy("v").rowsBetween(W.unboundedPreceding, 0)), F.sum(x).over(of))
        return s.withColumn("gap", F.abs(share("a") - share("b"))).groupBy(*at).agg(F.max("gap").alias("ks"))

    d = days(spark, folder).withColumn("v", F.col("x"))
    q = distance(replicated(d, ["v"], {"w": F.col("w")}), ["rep"])
    r = lambda e, n: F.round(e, 8).alias(n)
    ends = q.agg(*(r(F.expr(f"percentile(ks, {p})"), n) for p, n in ((0.025, "low"), (0.5, "middle"), (0.975, "high"))), F.count("ks").alias("valid"))
    return distance(d, []).select(r("ks", "ks")).crossJoin(ends)  # one row each


@query(
    f"""with {DAYS}, s as (select survey, mode, band, x as v, sum(w) as w from days group by all), n as (select survey, mode, band, count(*) as n from days group by all), r as (select *, sum(w) over (partition by survey, mode, band order by v rows unbounded preceding) as upto, sum(w) over (partition by survey, mode, band) as total from s),
    q as (select survey, mode, band, p, coalesce(min(v) filter (where upto >= p * total), max(v)) as minutes from r, (select unnest([{", ".join(map(str, _TENTHS))}])::double as p) group by survey, mode, band, p)
    select survey, mode, band, p, n, case when n >= {LEAST} then round(minutes, 6) end as minutes from q join n using (survey, mode, band)"""
)
def y_decile_table(spark: SparkSession, folder: str) -> DataFrame:
    """Deciles of minutes by kind of day and age band; cells of few days keep their number only."""
    d, g = days(spark, folder), ["survey", "mode", "band"]
    q = wt.quantiles_step(wt.running(d, g, "x", "w"), g, _TENTHS).withColumnRenamed("value", "minutes")
    return q.join(d.groupBy(*g).agg(F.count("*").alias("n")), g).select(*g, "p", "n", _shown("minutes"))


_LOG = lambda x: f"ln({x}b / {x}a)"


@query(
    f"""with {_BOTH}, r as (select survey, band, rep, sum(w * x * mult) / nullif(sum(w * mult), 0) as t, sum(w * n * mult) / nullif(sum(w * mult), 0) as n from {_DRAWN} group by all), p as (select band, rep, {", ".join(f"nullif(max({c}) filter (where survey = '{s}'), 0) as {c}{s}" for c in "tn" for s in "ab")} from r group by all),
    e as (select band, (tb - ta) / {_LOG("t")} * {_LOG("n")} as trips, (tb - ta) / {_LOG("t")} * ({_LOG("t")} - {_LOG("n")}) as minutes, tb / ta as ratio from p where ta > 0 and tb > 0 and na > 0 and nb > 0)
    select band, count(*) as complete, {", ".join(f"round(quantile_cont({c}, {p}), 6) as {c}_{n}" for c in ("trips", "minutes", "ratio") for p, n in ((0.025, "low"), (0.975, "high")))} from e group by 1"""
)
def y_decomposition_by_band(spark: SparkSession, folder: str) -> DataFrame:
    """The change of daily minutes by age band as trips and minutes a trip, and the ratio, over complete replicates."""
    w = F.col("w")
    r = replicated(days(spark, folder), ["band"], {"sw": w, "sx": w * F.col("x"), "sn": w * F.col("n")})
    r = r.select("survey", "band", "rep", safe_div(F.col("sx"), F.col("sw")).alias("t"), safe_div(F.col("sn"), F.col("sw")).alias("n"), safe_div(F.col("sx"), F.col("sn")).alias("m"))
    p = dc.side_by_side(r, ["band", "rep"], "survey", "a", "b", ("t", "n", "m")).where("t_a > 0 and t_b > 0 and n_a > 0 and n_b > 0")
    c = lambda x: (F.col(f"{x}_a"), F.col(f"{x}_b"))
    e = p.select("band", *(v.alias(k) for k, v in dc.log_terms(*c("t"), {"trips": (*c("n"), 1), "minutes": (*c("m"), 1)}).items()), (F.col("t_b") / F.col("t_a")).alias("ratio"))
    return e.groupBy("band").agg(F.count("*").alias("complete"), *(F.round(F.expr(f"percentile({k}, {q})"), 6).alias(f"{k}_{n}") for k in ("trips", "minutes", "ratio") for q, n in ((0.025, "low"), (0.975, "high"))))


def _effects(at: str, source: str) -> str:
    f = "filter (where wa > 0 and wb is not null)"
    return f"select {at} sum(wb * ta / wa) {f} / sum(wb) {f} - sum(ta) / sum(wa) as composition, sum(tb) / sum(wb) - sum(wb * ta / wa) {f} / sum(wb) {f} as behaviour from (select {at} cell, sum(w) filter (where survey = 'a') as wa, sum(t) filter (where survey = 'a') as ta, sum(w) filter (where survey = 'b') as wb, sum(t) filter (where survey = 'b') as tb from {source} group by all) {'group by ' + at.rstrip(', ') if at else ''}"


@query(
    f"""with {_BOTH}, c as (select survey, band || '|' || density as cell, w, w * x as t from days), pt as ({_effects("", "c")}), rs as (select survey, band || '|' || density as cell, rep, w * mult as w, w * x * mult as t from {_DRAWN}), q as ({_effects("rep, ", "rs")})
    select {", ".join(f"round((select {c} from pt), 6) as {c}, round(quantile_cont({c}, 0.025), 6) as {c}_low, round(quantile_cont({c}, 0.975), 6) as {c}_high" for c in ("composition", "behaviour"))} from q"""
)
def y_composition_intervals(spark: SparkSession, folder: str) -> DataFrame:
    """What the mix of ages and densities, and what behaviour within them, changes of daily minutes, with intervals."""

    def effects(cells: DataFrame, at: list[str]) -> DataFrame:
        x = dc.side_by_side(cells, [*at, "cell"], "survey", "a", "b", ("weight", "total"))
        wb = F.when((F.col("weight_a") > 0) & F.col("weight_b").isNotNull(), F.col("weight_b"))
        cf = safe_div(F.sum(wb * F.col("total_a") / F.col("weight_a")), F.sum(wb))
        mean = lambda s: safe_div(F.sum(f"total_{s}"), F.sum(f"weight_{s}"))
        return x.groupBy(*at).agg((cf - mean("a")).alias("composition"), (mean("b") - cf).alias("behaviour"))

    d = days(spark, folder).withColumn("cell", F.concat_ws("|", "band", "density"))
    sums = {"weight": F.col("w"), "total": F.col("w") * F.col("x")}
    point = effects(d.groupBy("survey", "cell").agg(*(F.sum(c).alias(a) for a, c in sums.items())), [])
    q = effects(replicated(d, ["cell"], sums), ["rep"])
    names = ("composition", "behaviour")
    ends = q.agg(*(F.round(F.expr(f"percentile({c}, {p})"), 6).alias(f"{c}_{n}") for c in names for p, n in ((0.025, "low"), (0.975, "high"))))
    return point.select(*(F.round(c, 6).alias(c) for c in names)).crossJoin(ends)  # one row each


@query(
    f"""with {DAYS}, m as (select survey, mode, typejour, sum(w * x) / sum(w) as m from days where typejour in (1, 2, 3) group by all) select survey, mode, round(max(m) filter (where typejour = 2) / nullif(max(m) filter (where typejour = 1), 0), 8) as saturday_to_weekday, round(max(m) filter (where typejour = 3) / nullif(max(m) filter (where typejour = 1), 0), 8) as sunday_to_weekday, round(max(m) / nullif(min(m), 0), 8) as most_to_least, round(stddev_pop(m) / nullif(avg(m), 0), 8) as cv from m group by all"""
)
def y_temporal_ratios(spark: SparkSession, folder: str) -> DataFrame:
    """Minutes of the kinds of day against each other: named pairs, most to least, and the coefficient of variation."""
    m = days(spark, folder).where(F.col("typejour").isin(1.0, 2.0, 3.0)).groupBy("survey", "mode", "typejour").agg((F.sum(F.col("w") * F.col("x")) / F.sum("w")).alias("m"))
    at = lambda t: F.max(F.when(F.col("typejour") == t, F.col("m")))
    r = lambda e, n: F.round(e, 8).alias(n)
    return m.groupBy("survey", "mode").agg(r(safe_div(at(2), at(1)), "saturday_to_weekday"), r(safe_div(at(3), at(1)), "sunday_to_weekday"), r(safe_div(F.max("m"), F.min("m")), "most_to_least"), r(safe_div(F.stddev_pop("m"), F.avg("m")), "cv"))


@query(
    """select o_orderpriority, count(*) as orders from orders o where case when o_orderstatus = 'F' then not exists (select 1 from lineitem l where l.l_orderkey = o.o_orderkey and l.l_returnflag = 'R') else o_totalprice > 1000 end group by 1"""
)
def j_case_exists(spark: SparkSession, folder: str) -> DataFrame:
    """A rule that asks for missing partners in one case only: one left join with a flag instead of a subquery in CASE."""
    o = table(spark, folder, "orders", "o_orderkey", "o_orderstatus", "o_totalprice", "o_orderpriority")
    back = table(spark, folder, "lineitem", "l_orderkey", "l_returnflag").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey")).distinct().withColumn("back", F.lit(True))
    keep = F.when(F.col("o_orderstatus") == "F", F.col("back").isNull()).otherwise(F.col("o_totalprice") > 1000)
    return o.join(back, "o_orderkey", "left").where(keep).groupBy("o_orderpriority").agg(F.count("*").alias("orders"))


@query(
    """with o as (select o_orderstatus as status, o_orderpriority as priority, o_totalprice as price from orders) select 'cube' as kind, status, priority, (grouping(status) * 2 + grouping(priority))::bigint as level, count(*) as orders, round(sum(price), 2) as total from o group by cube (status, priority)
    union all select 'rollup', status, priority, (grouping(status) * 2 + grouping(priority))::bigint, count(*), round(sum(price), 2) from o group by rollup (status, priority)"""
)
def a_cube_rollup(spark: SparkSession, folder: str) -> DataFrame:
    """All subtotals of two keys, and those of their hierarchy."""
    o = table(spark, folder, "orders", "o_orderstatus", "o_orderpriority", "o_totalprice").toDF("status", "priority", "price")
    sums = [F.grouping_id().alias("level"), F.count("*").alias("orders"), F.round(F.sum("price"), 2).alias("total")]
    out = {"cube": o.cube("status", "priority"), "rollup": o.rollup("status", "priority")}
    return reduce(DataFrame.unionByName, (g.agg(*sums).select(F.lit(k).alias("kind"), "status", "priority", "level", "orders", "total") for k, g in out.items()))


#: Metres within which a node counts for a line.
LINE_M = 60.0


@query(
    f"""with {_laea()}, c as (select (floor(y / 1000) * 100000 + floor(x / 1000))::bigint as line, id, x, y from xy where x is not null), s as (select line, lag(x) over o as x0, lag(y) over o as y0, x as x1, y as y1 from c window o as (partition by line order by id)), l as (select line, min(x) as xmin, max(x) as xmax, min(y) as ymin, max(y) as ymax from c group by 1 having count(*) > 1),
    p as (select l.line, c.id, c.x, c.y from l join c on c.x between xmin - {LINE_M} and xmax + {LINE_M} and c.y between ymin - {LINE_M} and ymax + {LINE_M} and c.line <> l.line),
    t as (select p.line, p.id, x, y, x0, y0, x1, y1, case when (x1 - x0) * (x1 - x0) + (y1 - y0) * (y1 - y0) > 0 then greatest(0.0, least(1.0, ((x - x0) * (x1 - x0) + (y - y0) * (y1 - y0)) / ((x1 - x0) * (x1 - x0) + (y1 - y0) * (y1 - y0)))) else 0.0 end as t from p join s on s.line = p.line where x0 is not null),
    d as (select line, id, min(sqrt((x - x0 - t * (x1 - x0)) * (x - x0 - t * (x1 - x0)) + (y - y0 - t * (y1 - y0)) * (y - y0 - t * (y1 - y0)))) as m from t group by all) select line, id, round(m, 2) as metres from d where m <= {LINE_M}"""
)
def g_line_distances(spark: SparkSession, folder: str) -> DataFrame:
    """Nodes near the line through another cell's nodes: boxes meet first, then the exact distance from its segments."""
    c = _projected(spark, folder).where("x is not null").select(gr.cell_id(F.col("y"), F.col("x"), 1000).alias("line"), "id", "x", "y")
    near = near_lines(c, c.select("id", "x", "y", F.col("line").alias("own")), "line", ["id"], LINE_M)
    return near.where("line != own").select("line", "id", F.round("metres", 2).alias("metres"))
