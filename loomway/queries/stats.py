"""Weighted statistics of described days: distributions, bootstrap, decompositions, regressions."""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomway.functions.exprs import clock_seconds, finite, safe_div
from loomway.operators import bootstrap as bs
from loomway.operators import decompose as dc
from loomway.operators import rounding as rd
from loomway.operators import weighted as wt
from loomway.operators.regression import wls
from loomway.operators.relational import first_per_key, sum_if_complete
from loomway.queries.base import DAYS, TRIPS, days, registry, trips

QUERIES, SQL, query = registry()

#: Household draws of a survey (fixed value).
REPS = 200

# --- distributions

_RUN = f"{DAYS}, sup as (select survey, mode, x as v, sum(w) as w from days group by all), run as (select *, sum(w) over (partition by survey, mode order by v rows unbounded preceding) as upto, sum(w) over (partition by survey, mode) as total from sup)"


@query(f"with {_RUN}, q as (select unnest([0.25, 0.5, 0.75])::double as p) select survey, mode, p, round(coalesce(min(v) filter (where upto >= p * total), max(v)), 6) as value from run, q group by survey, mode, p")
def x_quantiles_step(spark: SparkSession, folder: str) -> DataFrame:
    """Weighted quartiles by the step rule."""
    g = ["survey", "mode"]
    return wt.quantiles_step(wt.running(days(spark, folder), g, "x", "w"), g, (0.25, 0.5, 0.75)).select(*g, "p", F.round("value", 6).alias("value"))


_DECILES = tuple(i / 10 for i in range(1, 10))


@query(
    f"""with {_RUN}, q as (select unnest([{", ".join(map(str, _DECILES))}])::double as p), c as (select survey, mode, p, v, upto / total as c from run, q),
    z as (select survey, mode, p, max(c) filter (where c <= p) as c0, max(v) filter (where c <= p) as v0, min(c) filter (where c >= p) as c1, min(v) filter (where c >= p) as v1 from c group by all)
    select survey, mode, p, round(case when v0 is null then v1 when v1 is null or c0 = c1 then v0 else v0 + (p - c0) / (c1 - c0) * (v1 - v0) end, 6) as value from z"""
)
def x_deciles_interpolated(spark: SparkSession, folder: str) -> DataFrame:
    """Weighted deciles by interpolation over cumulative shares."""
    g = ["survey", "mode"]
    return wt.quantiles_interpolated(wt.running(days(spark, folder), g, "x", "w"), g, _DECILES).select(*g, "p", F.round("value", 6).alias("value"))


@query(f"with {DAYS}, m as (select band, sum(w) as sw, sum(w * x) / sum(w) as mean from days group by 1), v as (select d.band, sum(d.w * (d.x - m.mean) * (d.x - m.mean)) / any_value(m.sw) as var, any_value(m.mean) as mean from days d join m using (band) group by 1) select band, round(mean, 6) as mean, round(var, 4) as variance, round(mean * mean / nullif(var, 0), 6) as shape, round(var / nullif(mean, 0), 6) as scale from v")
def x_moments_gamma(spark: SparkSession, folder: str) -> DataFrame:
    """Mean, population variance and the gamma distribution with these moments."""
    m = wt.moments(wt.support(days(spark, folder), ["band"], "x", "w"), ["band"])
    shape, scale = wt.gamma_fit(F.col("mean"), F.col("variance"))
    return m.select("band", F.round("mean", 6).alias("mean"), F.round("variance", 4).alias("variance"), F.round(shape, 6).alias("shape"), F.round(scale, 6).alias("scale"))


@query(f"with {_RUN}, k as (select *, total * 0.99 as keep from run), kept as (select *, case when upto <= keep then w else greatest(0, keep - (upto - w)) end as kw from k) select survey, mode, round(sum(kw * v) / nullif(sum(kw), 0), 6) as trimmed from kept group by all")
def x_trimmed_mean(spark: SparkSession, folder: str) -> DataFrame:
    """Means without the longest hundredth of weight."""
    g = ["survey", "mode"]
    return wt.trimmed_mean(wt.running(days(spark, folder), g, "x", "w"), g, 0.01).select(*g, F.round("trimmed", 6).alias("trimmed"))


@query(f"with {DAYS} select band, t as threshold, round(sum(w) filter (where x >= t) / sum(w), 8) as share, round(coalesce(sum(w * x) filter (where x > t), 0) / sum(w), 6) as minutes_above from days, (select unnest([30.0, 60.0, 180.0])::double as t) group by band, t")
def x_thresholds(spark: SparkSession, folder: str) -> DataFrame:
    """Shares of days at or above thresholds, and the minutes that days above give per day."""
    rows = days(spark, folder).withColumn("threshold", F.explode(F.array(F.lit(30.0), F.lit(60.0), F.lit(180.0))))
    x, w, t = F.col("x"), F.col("w"), F.col("threshold")
    return rows.groupBy("band", "threshold").agg(F.round(safe_div(F.sum(F.when(x >= t, w)), F.sum(w)), 8).alias("share"), F.round(F.coalesce(F.sum(F.when(x > t, w * x)), F.lit(0.0)) / F.sum(w), 6).alias("minutes_above"))


@query(
    f"""with {DAYS}, m as (select sum(w) as sw, sum(w * w) as sw2, sum(w * x) / sum(w) as mean from days), bw as (select 0.9 * sqrt(sum(w * (x - mean) * (x - mean)) / any_value(sw)) * pow(any_value(sw) * any_value(sw) / any_value(sw2), -0.2) as h from days, m),
    sup as (select survey, x as v, sum(w) as w from days group by all), g as (select (i * 30)::double as point from range(0, 11) t(i))
    select survey, point, round(sum(exp(-0.5 * ((point - v) / h) * ((point - v) / h)) / sqrt(2 * pi()) * w / h) / sum(w), 10) as density from sup, g, bw group by survey, point"""
)
def x_kde(spark: SparkSession, folder: str) -> DataFrame:
    """Weighted densities of both surveys with one bandwidth."""
    d = days(spark, folder)
    m = wt.moments(wt.support(d, [], "x", "w"), []).crossJoin(F.broadcast(d.agg(F.sum(F.col("w") * F.col("w")).alias("w2"))))  # one row each
    h = m.select(wt.silverman(F.col("variance"), F.col("weight"), F.col("w2")).alias("h"))
    sup = wt.support(d, ["survey"], "x", "w").crossJoin(F.broadcast(h))
    return wt.kde(sup, ["survey"], F.col("h"), [30.0 * i for i in range(11)]).select("survey", "point", F.round("density", 10).alias("density"))


@query(f"with {DAYS}, g as (select (i * 5)::double as point from range(0, 61) t(i)) select survey, point, round(coalesce(sum(w) filter (where x <= point), 0) / sum(w), 8) as share from days, g group by survey, point")
def x_ecdf(spark: SparkSession, folder: str) -> DataFrame:
    """Weighted distribution on a grid of five minutes."""
    return wt.ecdf(wt.support(days(spark, folder), ["survey"], "x", "w"), ["survey"], 5.0, 300.0).select("survey", "point", F.round("share", 8).alias("share"))


_KS = lambda value: f"""with {DAYS}, s as (select mode, {value} as v, sum(case when survey = 'a' then w else 0 end) as a, sum(case when survey = 'a' then 0 else w end) as b from days where isfinite({value}) group by all),
    c as (select mode, sum(a) over o / nullif(sum(a) over (partition by mode), 0) as fa, sum(b) over o / nullif(sum(b) over (partition by mode), 0) as fb from s window o as (partition by mode order by v rows unbounded preceding))
    select mode, round(max(abs(fa - fb)), 8) as ks from c group by 1"""  # noqa: E731


@query(_KS("x"))
def x_ks(spark: SparkSession, folder: str) -> DataFrame:
    """Distance of both surveys' distributions of minutes, by mode."""
    return wt.ks_distance(days(spark, folder), ["mode"], "x", "w", F.col("survey") == "a").select("mode", F.round("ks", 8).alias("ks"))


@query(_KS("e"))
def x_ks_energy(spark: SparkSession, folder: str) -> DataFrame:
    """The same distance for energy, to be set against that of minutes."""
    return wt.ks_distance(days(spark, folder), ["mode"], "e", "w", F.col("survey") == "a").select("mode", F.round("ks", 8).alias("ks"))


@query(f"with {DAYS}, r as (select day_id, sum(w) over (order by e, day_id rows unbounded preceding) / sum(w) over () as c from days where isfinite(e)) select d.day_id, case when c is null then 0 else greatest(1, least(5, ceil(round(c * 5, 9))))::int end as class from days d left join r using (day_id)")
def x_quintiles(spark: SparkSession, folder: str) -> DataFrame:
    """Classes of equal weight; here ties go by the id itself."""
    return wt.weighted_classes(days(spark, folder), "day_id", "e", "w", tie=F.lit(0))


@query(f"with {DAYS} select survey, category, count(*) as days, round(sum(w) / sum(sum(w)) over (partition by survey), 8) as share, round(sum(w * x) / sum(w) / (sum(sum(w * x)) over (partition by survey) / sum(sum(w)) over (partition by survey)), 8) as ratio_to_all from days group by survey, category")
def x_group_ratios(spark: SparkSession, folder: str) -> DataFrame:
    """Each category's share and its mean against the survey's."""
    s = W.partitionBy("survey")
    g = days(spark, folder).groupBy("survey", "category").agg(F.count("*").alias("days"), F.sum("w").alias("sw"), F.sum(F.col("w") * F.col("x")).alias("sx"))
    return g.select("survey", "category", "days", F.round(F.col("sw") / F.sum("sw").over(s), 8).alias("share"), F.round(F.col("sx") / F.col("sw") / (F.sum("sx").over(s) / F.sum("sw").over(s)), 8).alias("ratio_to_all"))


@query(f"with {DAYS}, c as (select mode as cell, sum(w) as weight, sum(w * x) as total, sum(w * x * x) as squares from days group by 1) select round((sum(total * total / weight) / sum(weight) - (sum(total) / sum(weight)) * (sum(total) / sum(weight))) / (sum(squares) / sum(weight) - (sum(total) / sum(weight)) * (sum(total) / sum(weight))), 8) as eta2 from c")
def x_eta2(spark: SparkSession, folder: str) -> DataFrame:
    """Share of the variance of minutes between modes."""
    w, x = F.col("w"), F.col("x")
    c = days(spark, folder).groupBy("mode").agg(F.sum("w").alias("weight"), F.sum(w * x).alias("total"), F.sum(w * x * x).alias("squares"))
    return dc.between_share(c).select(F.round("eta2", 8).alias("eta2"))


@query(f"with {DAYS}, m as (select survey, mode, sum(w * x) / sum(w) as mean from days group by all) select survey, round(max(mean) / min(mean), 8) as max_to_min, round(stddev_pop(mean) / avg(mean), 8) as cv, arg_min(mode, mean) as lowest, arg_max(mode, mean) as highest from m group by 1")
def x_robustness(spark: SparkSession, folder: str) -> DataFrame:
    """Spread of the modes' means: greatest to least, coefficient of variation, and which they are."""
    m = days(spark, folder).groupBy("survey", "mode").agg((F.sum(F.col("w") * F.col("x")) / F.sum("w")).alias("mean"))
    return m.groupBy("survey").agg(F.round(safe_div(F.max("mean"), F.min("mean")), 8).alias("max_to_min"), F.round(safe_div(F.stddev_pop("mean"), F.avg("mean")), 8).alias("cv"), F.min_by("mode", "mean").alias("lowest"), F.max_by("mode", "mean").alias("highest"))


# --- household bootstrap


def draw_sql(name: str, households: str, offset: int = 0, extra: str = "") -> str:
    """`name`(hh, rep, mult): the draws of bootstrap.draws() for a query that gives (hh)."""
    r, k = f"(r + {offset})", bs.STRATUM
    return f"""{name}_hh as (select hh, idx, idx * ((n + {k - 1}) // {k}) // n as st from (select hh, row_number() over (order by md5(hh), hh) - 1 as idx, count(*) over () as n from ({households}))),
    {name}_st as (select st, min(idx) as lo, count(*) as m from {name}_hh group by 1),
    {name} as (select {extra} hh, r as rep, count(*) as mult from (select r, lo + (((((i * 48271 + {r} * 69621 + 11) % 2147483647) * ((i * 16807 + {r} * 40692 + 7) % 46337)) % 2147483647) % m) as idx
      from (select lo, m, unnest(range(lo, lo + m)) as i from {name}_st), range(0, {REPS}) b(r)) join {name}_hh using (idx) group by hh, r)"""


_BOTH = f"{DAYS}, da as (select * from days where survey = 'a'), db as (select * from days where survey = 'b'), {draw_sql('dra', 'select distinct hh from da')}, {draw_sql('drb', 'select distinct hh from db', 1000)}"
_OFFSETS = {"a": 0, "b": 1000}


def replicated(d: DataFrame, keys: list[str], sums: dict | None = None) -> DataFrame:
    """Replicates of days per survey and keys, each survey with its own draws."""
    sums = sums or {"sw": F.col("w"), "sx": F.col("w") * F.col("x")}
    return bs.replicates(d, ["survey", *keys], ["survey", "hh"], sums, bs.draws(d, "hh", REPS, "survey", _OFFSETS), REPS)


def _replicates(spark: SparkSession, folder: str, keys: list[str], sums: dict | None = None) -> tuple[DataFrame, DataFrame]:
    d = days(spark, folder)
    return d, replicated(d, keys, sums)


def _rep_sql(key: str) -> str:
    return f"""reps as (select survey, {key}, rep, sum(w * mult) as sw, sum(w * x * mult) as sx from da join dra using (hh) group by all
      union all select survey, {key}, rep, sum(w * mult), sum(w * x * mult) from db join drb using (hh) group by all)"""


@query(f"with {_BOTH} select 'a' as survey, hh, rep, mult::bigint as mult from dra union all select 'b', hh, rep, mult from drb")
def x_draws(spark: SparkSession, folder: str) -> DataFrame:
    """The draws themselves."""
    return bs.long_draws(bs.draws(days(spark, folder), "hh", REPS, "survey", _OFFSETS), REPS)


@query(f"with {_BOTH}, {_rep_sql('band')}, pt as (select survey, band, count(*) as n, sum(w * x) / sum(w) as mean from days group by all), ci as (select survey, band, quantile_cont(sx / nullif(sw, 0), 0.025) as low, quantile_cont(sx / nullif(sw, 0), 0.975) as high, count(sx / nullif(sw, 0)) as valid from reps group by all) select survey, band, n, valid, round(mean, 6) as mean, round(case when valid >= {0.95 * REPS} then low end, 6) as low, round(case when valid >= {0.95 * REPS} then high end, 6) as high from pt join ci using (survey, band)")
def x_bootstrap_means(spark: SparkSession, folder: str) -> DataFrame:
    """Means by age band with household-bootstrap intervals, gated by the number of valid replicates."""
    d, reps = _replicates(spark, folder, ["band"])
    point = d.groupBy("survey", "band").agg(F.count("*").alias("n"), (F.sum(F.col("w") * F.col("x")) / F.sum("w")).alias("mean"))
    ci = bs.interval(reps, ["survey", "band"], safe_div(F.col("sx"), F.col("sw")), 0.95, REPS)
    return point.join(ci, ["survey", "band"]).select("survey", "band", "n", "valid", F.round("mean", 6).alias("mean"), F.round("low", 6).alias("low"), F.round("high", 6).alias("high"))


_PAIRED = "paired as (select band, rep, max(sx / nullif(sw, 0)) filter (where survey = 'a') as a, max(sx / nullif(sw, 0)) filter (where survey = 'b') as b from reps group by all)"


@query(
    f"""with {_BOTH}, {_rep_sql("band")}, {_PAIRED}, pt as (select band, count(*) filter (where survey = 'a') as n_a, count(*) filter (where survey = 'b') as n_b, sum(w * x) filter (where survey = 'a') / sum(w) filter (where survey = 'a') as a, sum(w * x) filter (where survey = 'b') / sum(w) filter (where survey = 'b') as b from days group by 1),
    ci as (select band, quantile_cont(b / a, 0.05) as low, quantile_cont(b / a, 0.95) as high, quantile_cont(b - a, 0.025) as dlow, quantile_cont(b - a, 0.975) as dhigh from paired group by 1)
    select band, n_a, n_b, case when least(n_a, n_b) >= 50 then round(b / a, 8) end as ratio, case when least(n_a, n_b) >= 50 then round(low, 8) end as low, case when least(n_a, n_b) >= 50 then round(high, 8) end as high, case when least(n_a, n_b) >= 50 then round(dlow, 6) end as diff_low, case when least(n_a, n_b) >= 50 then round(dhigh, 6) end as diff_high,
    case when least(n_a, n_b) < 50 then null when low >= 1 / 1.1 and high <= 1.1 then 'equivalent' when low > 1 or high < 1 then 'different' else 'inconclusive' end as verdict from pt join ci using (band)"""
)
def x_ratio_and_difference(spark: SparkSession, folder: str) -> DataFrame:
    """b to a by age band, paired by replicate: 90 % interval of the ratio, 95 % of the difference, verdict, small cells blank."""
    d, reps = _replicates(spark, folder, ["band"])
    e = reps.withColumn("m", safe_div(F.col("sx"), F.col("sw")))
    pair = e.groupBy("band", "rep").agg(*(F.max(F.when(F.col("survey") == s, F.col("m"))).alias(s) for s in "ab"))
    ratio, diff = bs.interval(pair, ["band"], safe_div(F.col("b"), F.col("a")), 0.9, REPS, 0), bs.interval(pair, ["band"], F.col("b") - F.col("a"), 0.95, REPS, 0)
    mean = lambda s: safe_div(F.sum(F.when(F.col("survey") == s, F.col("w") * F.col("x"))), F.sum(F.when(F.col("survey") == s, F.col("w"))))
    n = lambda s: F.count(F.when(F.col("survey") == s, 1)).alias(f"n_{s}")
    p = d.groupBy("band").agg(n("a"), n("b"), mean("a").alias("a"), mean("b").alias("b"))
    rows = p.join(ratio.drop("valid"), "band").join(diff.select("band", F.col("low").alias("dl"), F.col("high").alias("dh")), "band")
    least = F.least("n_a", "n_b")
    show = lambda c, k: F.round(bs.suppressed(c, least), k)
    return rows.select("band", "n_a", "n_b", show(safe_div(F.col("b"), F.col("a")), 8).alias("ratio"), show(F.col("low"), 8).alias("low"), show(F.col("high"), 8).alias("high"), show(F.col("dl"), 6).alias("diff_low"), show(F.col("dh"), 6).alias("diff_high"), bs.suppressed(bs.verdict(F.col("low"), F.col("high"), 0.1), least).alias("verdict"))


@query(
    f"""with {_BOTH}, {_rep_sql("mode")}, whole as (select survey, rep, sum(sx) / sum(sw) as m from reps group by all), r as (select survey, mode, rep, (sx / nullif(sw, 0)) / m as q from reps join whole using (survey, rep)), n as (select survey, mode, count(*) as n from days group by all),
    ci as (select survey, mode, quantile_cont(q, 0.05) as low, quantile_cont(q, 0.95) as high from r group by all) select survey, mode, n, case when n >= 50 then round(low, 8) end as low, case when n >= 50 then round(high, 8) end as high,
    case when n < 50 then null when low >= 1 / 1.05 and high <= 1.05 then 'equivalent' when low > 1 or high < 1 then 'different' else 'inconclusive' end as at_5, case when n < 50 then null when low >= 1 / 1.1 and high <= 1.1 then 'equivalent' when low > 1 or high < 1 then 'different' else 'inconclusive' end as at_10 from ci join n using (survey, mode)"""
)
def x_equivalence(spark: SparkSession, folder: str) -> DataFrame:
    """Each mode against all days of its survey on the same draws, two margins."""
    d, reps = _replicates(spark, folder, ["mode"])
    whole = reps.groupBy("survey", "rep").agg((F.sum("sx") / F.sum("sw")).alias("m"))
    ci = bs.interval(reps.join(whole, ["survey", "rep"]), ["survey", "mode"], safe_div(safe_div(F.col("sx"), F.col("sw")), F.col("m")), 0.9, REPS, 0)
    rows = ci.join(d.groupBy("survey", "mode").agg(F.count("*").alias("n")), ["survey", "mode"])
    lo, hi, n = F.col("low"), F.col("high"), F.col("n")
    return rows.select("survey", "mode", "n", F.round(bs.suppressed(lo, n), 8).alias("low"), F.round(bs.suppressed(hi, n), 8).alias("high"), *(bs.suppressed(bs.verdict(lo, hi, m / 100), n).alias(f"at_{m}") for m in (5, 10)))


@query(f"with {DAYS}, ppl as (select survey, band, sum(pw) as persons from (select survey, band, hh, max(w) as pw from days group by all) group by all), t as (select survey, band, sum(w * x) filter (where typejour = 1) as num, sum(w) filter (where typejour = 3) as open_w from days group by all) select survey, band, round(num / nullif(persons * 7 - open_w, 0), 6) as minutes_per_person from ppl join t using (survey, band)")
def x_per_person(spark: SparkSession, folder: str) -> DataFrame:
    """Weighted minutes per person-day: open days leave the numerator and the denominator."""
    d = days(spark, folder)
    people = d.groupBy("survey", "band", "hh").agg(F.max("w").alias("pw")).groupBy("survey", "band").agg(F.sum("pw").alias("persons"))
    t = d.groupBy("survey", "band").agg(F.sum(F.when(F.col("typejour") == 1, F.col("w") * F.col("x"))).alias("num"), F.sum(F.when(F.col("typejour") == 3, F.col("w"))).alias("open_w"))
    return people.join(t, ["survey", "band"]).select("survey", "band", F.round(safe_div(F.col("num"), F.col("persons") * 7 - F.col("open_w")), 6).alias("minutes_per_person"))


@query(
    f"""with {_BOTH}, sw as (select survey, scope, rep, sum(case when scope = 'all' or typejour = 1 then w * mult end) as sw, sum(case when scope = 'all' or typejour = 1 then w * x * mult end) as sx from
      (select * from da join dra using (hh) union all select * from db join drb using (hh)), (select unnest(['all', 'weekday']) as scope) group by all), p as (select survey, rep, max(sx / nullif(sw, 0)) filter (where scope = 'all') as a, max(sx / nullif(sw, 0)) filter (where scope = 'weekday') as b from sw group by all)
    select survey, round(quantile_cont(b - a, 0.025), 6) as low, round(quantile_cont(b - a, 0.5), 6) as middle, round(quantile_cont(b - a, 0.975), 6) as high from p group by 1"""
)
def x_switch_effect(spark: SparkSession, folder: str) -> DataFrame:
    """Effect of switching from all days to weekdays, paired by replicate."""
    wk = F.col("typejour") == 1
    w, x = F.col("w"), F.col("x")
    _, reps = _replicates(spark, folder, [], {"sw": w, "sx": w * x, "kw": F.when(wk, w), "kx": F.when(wk, w * x)})
    effect = safe_div(F.col("kx"), F.col("kw")) - safe_div(F.col("sx"), F.col("sw"))
    return reps.withColumn("e", effect).groupBy("survey").agg(*(F.round(F.expr(f"percentile(e, {p})"), 6).alias(n) for p, n in ((0.025, "low"), (0.5, "middle"), (0.975, "high"))))


# --- decompositions

_AB = f"{DAYS}, s as (select survey, sum(w * x) / sum(w) as t, sum(w * n) / sum(w) as n, sum(w * e) filter (where isfinite(e)) / sum(w * n) filter (where isfinite(e)) as l, sum(w * e) filter (where isfinite(e)) / sum(w * x) filter (where isfinite(e)) as v from days group by 1), ab as (select max(t) filter (where survey = 'a') as ta, max(t) filter (where survey = 'b') as tb, max(n) filter (where survey = 'a') as na, max(n) filter (where survey = 'b') as nb, max(l) filter (where survey = 'a') as la, max(l) filter (where survey = 'b') as lb, max(v) filter (where survey = 'a') as va, max(v) filter (where survey = 'b') as vb from s)"


@query(f"with {_AB}, m as (select *, case when abs(ln(tb / ta)) < 1e-14 then ta else (tb - ta) / ln(tb / ta) end as lm from ab) select round(tb - ta, 6) as change, round(lm * ln(nb / na), 6) as trips, round(lm * ln(lb / la), 6) as length, round(-lm * ln(vb / va), 6) as speed, round(lm * (ln(tb / ta) - ln(nb / na) - ln(lb / la) + ln(vb / va)), 6) as selection from m")
def x_log_decomposition(spark: SparkSession, folder: str) -> DataFrame:
    """Change of daily minutes as trips, length and speed by log means; what is known of part of the days only is selection."""
    w, e = F.col("w"), F.when(finite(F.col("e")), F.col("w"))
    d = days(spark, folder).groupBy("survey").agg((F.sum(w * F.col("x")) / F.sum(w)).alias("t"), (F.sum(w * F.col("n")) / F.sum(w)).alias("n"), (F.sum(e * F.col("e")) / F.sum(e * F.col("n"))).alias("l"), (F.sum(e * F.col("e")) / F.sum(e * F.col("x"))).alias("v"))
    r = dc.side_by_side(d.withColumn("one", F.lit(1)), ["one"], "survey", "a", "b", ("t", "n", "l", "v"))
    c = lambda x: (F.col(f"{x}_a"), F.col(f"{x}_b"))
    ta, tb = c("t")
    terms = dc.log_terms(ta, tb, {"trips": (*c("n"), 1), "length": (*c("l"), 1), "speed": (*c("v"), -1)})
    selection = dc.log_mean(ta, tb) * F.ln(tb / ta) - terms["trips"] - terms["length"] - terms["speed"]
    return r.select(F.round(tb - ta, 6).alias("change"), *(F.round(t, 6).alias(k) for k, t in terms.items()), F.round(selection, 6).alias("selection"))


@query(
    f"""with {DAYS}, g as (select survey, mode as grp, sum(w * n) as weight, sum(w * x) as minutes from days group by all), dw as (select survey, sum(w) as day_weight from days group by 1),
    s as (select g.*, weight / sum(weight) over p as share, minutes / nullif(weight, 0) as m, sum(minutes) over p / sum(weight) over p as big_m, sum(weight) over p / day_weight as per_day from g join dw using (survey) window p as (partition by survey)),
    o as (select max(big_m) filter (where survey = 'a') as ba, max(big_m) filter (where survey = 'b') as bb, max(per_day) filter (where survey = 'a') as na, max(per_day) filter (where survey = 'b') as nb from s),
    r as (select grp, coalesce(max(share) filter (where survey = 'a'), 0) as sa, coalesce(max(share) filter (where survey = 'b'), 0) as sb, max(m) filter (where survey = 'a') as ma0, max(m) filter (where survey = 'b') as mb0 from s group by 1), f as (select *, coalesce(ma0, ba) as ma, coalesce(mb0, bb) as mb from r, o)
    select grp, round(sa, 8) as share_a, round(sb, 8) as share_b, round((sb - sa) * ma * nb, 6) as mix, round(sa * (mb - ma) * nb, 6) as within, round((sb - sa) * (mb - ma) * nb, 6) as interaction, round((nb - na) * ba, 6) as volume from f"""
)
def x_shift_share(spark: SparkSession, folder: str) -> DataFrame:
    """Change of minutes between the surveys by mode: volume, mix, within, interaction."""
    d = days(spark, folder)
    w = F.col("w")
    g = d.groupBy("survey", F.col("mode").alias("grp")).agg(F.sum(w * F.col("n")).alias("weight"), F.sum(w * F.col("x")).alias("minutes"))
    out = dc.shift_share(g.join(d.groupBy("survey").agg(F.sum("w").alias("day_weight")), "survey"))
    return out.select("grp", *(F.round(c, 8).alias(c) for c in ("share_a", "share_b")), *(F.round(c, 6).alias(c) for c in ("mix", "within", "interaction", "volume")))


def _cells(spark: SparkSession, folder: str, *cols: str) -> DataFrame:
    return days(spark, folder).groupBy("survey", F.concat_ws("|", *cols).alias("cell")).agg(F.sum("w").alias("weight"), F.sum(F.col("w") * F.col("x")).alias("total"))


_CELLS = lambda *c: f"{DAYS}, c as (select survey, concat_ws('|', {', '.join(c)}) as cell, sum(w) as weight, sum(w * x) as total from days group by all), ab as (select cell, max(weight) filter (where survey = 'a') as wa, max(weight) filter (where survey = 'b') as wb, max(total) filter (where survey = 'a') as ta, max(total) filter (where survey = 'b') as tb from c group by 1)"


@query(f"with {_CELLS('band', 'density')}, z as (select sum(ta) / sum(wa) as ma, sum(tb) / sum(wb) as mb, sum(wb * ta / wa) filter (where wa > 0 and wb is not null) / sum(wb) filter (where wa > 0) as cf, count(*) filter (where wa > 0 and wb is not null) as cells, 1 - sum(wb) filter (where wa > 0) / sum(wb) as lost from ab) select round(ma, 6) as mean_a, round(mb, 6) as mean_b, round(cf, 6) as counterfactual, cells, round(lost, 8) as lost_share, round(cf - ma, 6) as composition, round(mb - cf, 6) as behaviour from z")
def x_composition(spark: SparkSession, folder: str) -> DataFrame:
    """Survey a at b's mix of age and density."""
    r = dc.reweight(_cells(spark, folder, "band", "density"))
    return r.select(*(F.round(c, 6).alias(c) for c in ("mean_a", "mean_b", "counterfactual")), "cells", F.round("lost_share", 8).alias("lost_share"), *(F.round(c, 6).alias(c) for c in ("composition", "behaviour")))


@query(f"with {_CELLS('mode', 'income')}, k as (select *, (wa / sum(wa) over () + wb / sum(wb) over ()) / 2 as mix from ab where wa > 0 and wb > 0) select round(sum(mix * ta / wa), 6) as standard_a, round(sum(mix * tb / wb), 6) as standard_b, round(sum(mix * tb / wb) / sum(mix * ta / wa), 8) as ratio, count(*) as cells from k")
def x_standardise(spark: SparkSession, folder: str) -> DataFrame:
    """Both surveys at their mean mix over the cells they share."""
    r = dc.standardise(_cells(spark, folder, "mode", "income"))
    return r.select(F.round("standard_a", 6).alias("standard_a"), F.round("standard_b", 6).alias("standard_b"), F.round("ratio", 8).alias("ratio"), "cells")


@query(
    f"""with {DAYS}, fine as (select survey, mode, band, count(*) as n, sum(w) as w, sum(w * x) / sum(w) as m from days group by all), parent as (select survey, mode, sum(w * x) / sum(w) as pm from days group by all)
    select b.mode, round(sum(b.w * coalesce(case when a.n >= 20 then a.m end, p.pm)) / sum(b.w), 6) as counterfactual, count(*) filter (where a.n is null or a.n < 20) as from_parent from fine b left join fine a on a.survey = 'a' and a.mode = b.mode and a.band = b.band left join parent p on p.survey = 'a' and p.mode = b.mode where b.survey = 'b' group by 1"""
)
def x_counterfactual_parent(spark: SparkSession, folder: str) -> DataFrame:
    """b's cells at a's means, from the parent cell where a has too few rows."""
    d = days(spark, folder)
    mean = (F.sum(F.col("w") * F.col("x")) / F.sum("w")).alias("m")
    fine = d.groupBy("survey", "mode", "band").agg(F.count("*").alias("n"), F.sum("w").alias("w"), mean)
    a = fine.where("survey = 'a'").select("mode", "band", F.col("n").alias("na"), F.col("m").alias("ma"))
    parent = d.where("survey = 'a'").groupBy("mode").agg(mean).withColumnRenamed("m", "pm")
    rows = fine.where("survey = 'b'").join(a, ["mode", "band"], "left").join(parent, "mode", "left")
    m = F.coalesce(F.when(F.col("na") >= 20, F.col("ma")), F.col("pm"))
    return rows.groupBy("mode").agg(F.round(F.sum(F.col("w") * m) / F.sum("w"), 6).alias("counterfactual"), F.count(F.when(F.col("na").isNull() | (F.col("na") < 20), 1)).alias("from_parent"))


@query(
    f"""with {_RUN}, mid as (select survey, mode, v, w, (upto - w / 2) / total as r from run), src as (select mode, v, upto / total as hi, (upto - w) / total as lo from run where survey = 'a')
    select m.mode, m.v, round(m.r, 8) as mid_rank, s.v as mapped from mid m join src s on m.mode = s.mode and m.r > s.lo and m.r <= s.hi where m.survey = 'b'"""
)
def x_rank_map(spark: SparkSession, folder: str) -> DataFrame:
    """Each of b's values to a's value at the same mid-rank of its mode: a band join on cumulative shares."""
    from loomway.operators.relational import band_join

    run = wt.running(days(spark, folder), ["survey", "mode"], "x", "w")
    mid = run.where("survey = 'b'").select("mode", "v", ((F.col("upto") - F.col("w") / 2) / F.col("total")).alias("r"))
    src = run.where("survey = 'a'").select("mode", F.col("v").alias("mapped"), ((F.col("upto") - F.col("w")) / F.col("total")).alias("lo"), (F.col("upto") / F.col("total")).alias("hi"))
    out = band_join(mid, src, "r", "lo", "hi", 0.01, ["mode"]).where("r > lo")
    return out.select("mode", "v", F.round("r", 8).alias("mid_rank"), "mapped")


AGE_BANDS = ("6-14", "15-24", "25-34", "35-49", "50-64", "65-74", "75+")
_PLACE = "[" + ", ".join(f"'{b}'" for b in AGE_BANDS) + "]"


@query(
    f"""with recursive {DAYS}, c as (select category, list_position({_PLACE}, band) - 1 as i, count(*) filter (where survey = 'a') as a, count(*) filter (where survey = 'b') as b from days where list_contains({_PLACE}, band) group by all), g as (select category, i, coalesce(a, 0) as a, coalesce(b, 0) as b from (select distinct category from c) cross join (select unnest(range(0, {len(AGE_BANDS)}))::int as i) left join c using (category, i)),
    w as (select category, i, 0 as first, null::int as full_, a, b from g where i = 0 union all select g.category, g.i, case when least(w.a, w.b) >= 30 then g.i else w.first end, case when least(w.a, w.b) >= 30 then w.first else w.full_ end, case when least(w.a, w.b) >= 30 then 0 else w.a end + g.a, case when least(w.a, w.b) >= 30 then 0 else w.b end + g.b from w join g on g.category = w.category and g.i = w.i + 1),
    z as (select category, first as last_first, full_ as before, a + b > 0 and least(a, b) < 30 as short from w where i = {len(AGE_BANDS) - 1})
    select category, {_PLACE}[i + 1] as band, {_PLACE}[case when short and first = last_first then coalesce(before, 0) else first end + 1] as merged_from from w join z using (category)"""
)
def x_band_merge(spark: SparkSession, folder: str) -> DataFrame:
    """Age bands joined until both surveys have enough days in each stratum."""

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        stratum = pdf["category"].iloc[0]
        merged = dc.neighbour_merge({(stratum, AGE_BANDS.index(b)): (x, y) for b, x, y in zip(pdf["band"], pdf["a"], pdf["b"])}, len(AGE_BANDS))
        return pd.DataFrame([(s, AGE_BANDS[i], AGE_BANDS[j]) for (s, i), j in sorted(merged.items())], columns=["category", "band", "merged_from"])

    # Each stratum has a count for each of a few bands.
    c = days(spark, folder).where(F.col("band").isin(*AGE_BANDS)).groupBy("category", "band").agg(*(F.count(F.when(F.col("survey") == s, 1)).alias(s) for s in "ab"))
    return c.groupBy("category").applyInPandas(merge, "category string, band string, merged_from string")


def merge_sql(groups: str, level: str, size: str, source: str, least: int) -> str:
    """Recursive steps `m`(groups, firsts, sizes): the smallest cluster joins its smaller neighbour until all have `least`; the last step is the shortest."""
    i = "list_position(sizes, list_min(sizes))"
    lo = f"case when {i} = 1 then 1 when {i} = len(sizes) then len(sizes) - 1 when sizes[{i} - 1] <= sizes[{i} + 1] then {i} - 1 else {i} end"
    return f"""m as (select {groups} list({level} order by {level}) as firsts, list({size} order by {level}) as sizes from {source} {f"group by {groups.rstrip(', ')}" if groups else ""}
      union all select {groups} firsts[1:lo] || firsts[lo + 2:] as firsts, sizes[1:lo - 1] || [sizes[lo] + sizes[lo + 1]] || sizes[lo + 2:] as sizes from (select *, {lo} as lo from m where len(sizes) > 1 and list_min(sizes) < {least}))"""


@query(
    f"""with recursive {DAYS}, c as (select n, count(*)::bigint as days from days group by 1), {merge_sql("", "n", "days", "c", 100)}
    select n as level, list_max(list_filter(firsts, lambda f: f <= n)) as cluster from c, (select arg_min(firsts, len(firsts)) as firsts from m)"""
)
def x_level_merge(spark: SparkSession, folder: str) -> DataFrame:
    """Numbers of trips per day joined to clusters of at least 100 days, the smallest first."""

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame(sorted(dc.smallest_first_merge(dict(zip(pdf["n"].tolist(), pdf["days"].tolist())), 100).items()), columns=["level", "cluster"])

    # One row for each number of trips.
    return days(spark, folder).groupBy("n").agg(F.count("*").alias("days")).groupBy().applyInPandas(merge, "level long, cluster long")


@query(f"with {DAYS} select survey, round(regr_slope(x, n), 8) as slope_unweighted, count(*) as n from days group by 1")
def x_slope(spark: SparkSession, folder: str) -> DataFrame:
    """Unweighted slope of minutes on trips, from the sums of least squares."""
    out = wls(days(spark, folder), F.col("x"), F.lit(1.0), {"constant": F.lit(1.0), "n": F.col("n")}, ["survey"])
    return out.where("term = 'n'").select("survey", F.round("estimate", 8).alias("slope_unweighted"), "n")


_DUMMY_MODES, _DUMMY_BANDS = ("car_passenger", "urban_pt", "cycle", "multimodal", "walking_only"), ("6-14", "15-24", "50-64", "65-74", "75+")
#: The models, each with the terms of the one before: survey alone, with modes, with age bands and an interaction; `twice` depends on another column.
LADDER = {"m0": 2, "m1": 2 + len(_DUMMY_MODES), "m2": 4 + len(_DUMMY_MODES) + len(_DUMMY_BANDS)}
_TERMS = ["constant", "survey_b", *(f"mode_{m}" for m in _DUMMY_MODES), *(f"band_{b}" for b in _DUMMY_BANDS), "survey_b:cycle", "twice"]
_TERM_SQL = ["1", "(survey = 'b')::int", *(f"(mode = '{m}')::int" for m in _DUMMY_MODES), *(f"(band = '{b}')::int" for b in _DUMMY_BANDS), "(survey = 'b' and mode = 'cycle')::int", "2 * (survey = 'b')::int"]


def _model_sql(k: int) -> str:
    """Normal equations of the first k terms, eliminated column by column; a column that depends on earlier ones is passed over."""
    return f"""with recursive {DAYS}, r as (select w, [{", ".join(f"({t})::double" for t in _TERM_SQL[:k])}, ln(x)] as v from days where x > 0), c as (select i, j, sum(w * v[i] * v[j]) as a from r cross join (select unnest(range(1, {k + 1})) as i) cross join (select unnest(range(1, {k + 2})) as j) group by all),
      e as (select 1::bigint as p, list(a order by i) as m, []::boolean[] as ok, list_transform(list(a order by i), lambda x, i: x[i]) as first from (select i, list(a order by j) as a from c group by i)
      union all select p + 1, case when m[p][p] > 1e-9 * first[p] then list_transform(m, lambda x, i: case when i = p then list_transform(x, lambda y: y / m[p][p]) else list_transform(x, lambda y, j: y - x[p] * m[p][j] / m[p][p]) end) else m end, list_append(ok, m[p][p] > 1e-9 * first[p]), first from e where p <= {k})
      select t.term, round(case when ok[t.i] then m[t.i][{k + 1}] end, 6) as estimate, (select count(*) from r) as n from e, (select unnest([{", ".join(f"'{t}'" for t in _TERMS[:k])}]) as term, unnest(range(1, {k + 1})) as i) t where p = {k + 1}"""


@query(" union all ".join(f"select '{name}' as model, *, round(100 * (exp(estimate) - 1), 4) as effect_pct from ({_model_sql(k)})" for name, k in LADDER.items()))
def x_wls(spark: SparkSession, folder: str) -> DataFrame:
    """A ladder of weighted least squares of log minutes on dummies of survey, mode and age, with an interaction: estimates and effects in per cent."""
    d = days(spark, folder).where("x > 0")
    flag = lambda c: c.cast("double")
    cols = {"constant": F.lit(1.0), "survey_b": flag(F.col("survey") == "b"), **{f"mode_{m}": flag(F.col("mode") == m) for m in _DUMMY_MODES}, **{f"band_{b}": flag(F.col("band") == b) for b in _DUMMY_BANDS}}
    cols["survey_b:cycle"] = cols["survey_b"] * cols["mode_cycle"]
    cols["twice"] = cols["survey_b"] * 2  # depends on another column: no estimate
    models = [wls(d, F.ln("x"), F.col("w"), dict(list(cols.items())[:k])).withColumn("model", F.lit(name)) for name, k in LADDER.items()]
    out = reduce(DataFrame.unionByName, models).withColumn("estimate", F.round("estimate", 6))
    return out.select("model", "term", "estimate", "n", F.round(100 * (F.exp("estimate") - 1), 4).alias("effect_pct"))


# --- rounding, clocks, bands, matrices


@query(f"with {TRIPS}, r as (select case when duration_min % 30 = 0 then 30 when duration_min % 15 = 0 then 15 when duration_min % 5 = 0 then 5 else 1 end as level from trips where isfinite(duration_min) and duration_min > 0 and duration_min <= 1440) select level, count(*) as trips, round(count(*) / sum(count(*)) over (), 8) as share from r group by 1")
def x_rounding(spark: SparkSession, folder: str) -> DataFrame:
    """The largest of 5, 15 and 30 that divides a declared duration."""
    d = F.col("duration_min")
    level = F.when(d % 30 == 0, 30).when(d % 15 == 0, 15).when(d % 5 == 0, 5).otherwise(1)
    rows = trips(spark, folder).where(finite(d) & (d > 0) & (d <= 1440)).groupBy(level.alias("level")).agg(F.count("*").alias("trips"))
    return rows.withColumn("share", F.round(F.col("trips") / F.sum("trips").over(W.partitionBy()), 8))


#: Levels of rounding, and the upper ends of the classes of minutes that are coarsened apart.
ROUND_LEVELS, ROUND_CLASSES = (1, 5, 15, 30), (15, 30, 60)
_LEVEL = lambda d: "case " + " ".join(f"when {d} % {k} = 0 then {k}" for k in reversed(ROUND_LEVELS[1:])) + f" else {ROUND_LEVELS[0]} end"


def _round_step(i: int, k: int, variant: str) -> str:
    steps = f"ceil(after / {k})" if variant == "up" else f"floor(after / {k} + 0.5)"
    to = f"greatest({steps} * {k}, {rd.LEAST_MIN})" if variant == "nearest_min5" else f"{steps} * {k}"
    return f"""a{i} as (select *, now < {k} and {_LEVEL("goal")} >= {k} as can from (select *, {_LEVEL("after")} as now, ({to})::double as goal from r{i - 1})), s{i} as (select cell, sum(w) as s_all, coalesce(sum(w) filter (where now >= {k}), 0) as s_now, coalesce(sum(w) filter (where can), 0) as s_can from a{i} group by 1),
      r{i} as (select cell, key, w, d, case when coalesce(can and target_{k} - s_now / s_all > 0 and s_can > 0 and ('0x' || substr(md5(key || ':{k}'), 1, 8))::bigint / 4294967296.0::double < (target_{k} - s_now / s_all) / (s_can / s_all), false) then goal else after end as after, {", ".join(f"target_{x}" for x in ROUND_LEVELS[1:])} from a{i} join s{i} using (cell))"""


def _round_sql(variant: str) -> str:
    cls = "case " + " ".join(f"when d < {u} then {i}" for i, u in enumerate(ROUND_CLASSES)) + f" else {len(ROUND_CLASSES)} end"
    return f"""with {TRIPS}, t as (select survey, ident_dep as key, pond_jour as w, duration_min as d, floor(coalesce(mtp, -1))::bigint as m from trips where isfinite(duration_min) and duration_min >= 0 and duration_min <= 1440 and isfinite(pond_jour) and pond_jour > 0 and ident_dep is not null), c as (select survey, key, w, d, m * 10 + {cls} as cell from t),
      g as (select cell, {", ".join(f"coalesce(sum(w) filter (where {_LEVEL('d')} >= {k}), 0) / sum(w) as target_{k}" for k in ROUND_LEVELS[1:])} from c where survey = 'P' group by 1), r0 as (select c.cell, key, w, d, d as after, {", ".join(f"target_{k}" for k in ROUND_LEVELS[1:])} from c left join g using (cell) where survey = 'J'),
      {", ".join(_round_step(i, k, variant) for i, k in enumerate(ROUND_LEVELS[1:], 1))}
      select '{variant}' as variant, count(*) as trips, count(*) filter (where after <> d) as moved, round(sum(w * d) / sum(w), 6) as mean_before, round(sum(w * after) / sum(w), 6) as mean_after, {", ".join(f"round(coalesce(sum(w) filter (where {_LEVEL('after')} >= {k}), 0) / sum(w), 8) as share_{k}" for k in ROUND_LEVELS[1:])} from r{len(ROUND_LEVELS) - 1}"""


@query(" union all ".join(f"({_round_sql(v)})" for v in rd.VARIANTS))
def x_rounding_simulation(spark: SparkSession, folder: str) -> DataFrame:
    """The older survey's minutes coarsened to the newer one's shares of multiples of 5, 15 and 30, by mode and class of minutes, in three ways of rounding."""
    d, w = F.col("duration_min"), F.col("pond_jour")
    t = trips(spark, folder).where(finite(d) & d.between(0, 1440) & finite(w) & (w > 0) & F.col("ident_dep").isNotNull())
    cls = F.coalesce(*(F.when(d < u, i) for i, u in enumerate(ROUND_CLASSES)), F.lit(len(ROUND_CLASSES)))
    c = t.select("survey", F.col("ident_dep").alias("key"), w.alias("w"), d.alias("d"), (F.floor(F.coalesce("mtp", F.lit(-1.0))) * 10 + cls).alias("cell"))
    targets = rd.level_shares(c.where("survey = 'P'"), ROUND_LEVELS)
    mean = lambda x: F.round(F.sum(F.col("w") * F.col(x)) / F.sum("w"), 6)
    share = lambda k: F.round(F.coalesce(F.sum(F.when(rd.rounding_level(F.col("after"), ROUND_LEVELS) >= k, F.col("w"))), F.lit(0.0)) / F.sum("w"), 8).alias(f"share_{k}")
    out = []
    for v in rd.VARIANTS:
        r = rd.coarsened(c.where("survey = 'J'").drop("survey"), targets, ROUND_LEVELS, v)
        out.append(r.agg(F.lit(v).alias("variant"), F.count("*").alias("trips"), F.count_if(F.col("after") != F.col("d")).alias("moved"), mean("d").alias("mean_before"), mean("after").alias("mean_after"), *(share(k) for k in ROUND_LEVELS[1:])))
    return reduce(DataFrame.unionByName, out)


@query(f"with {TRIPS} select survey, m % 5 = 0 as on_five, case when m = 0 then 'hour' when m = 30 then 'half' when m % 15 = 0 then 'quarter' when m % 5 = 0 then 'five' else 'other' end as class, count(*) as trips, round(avg(((arrival_s - departure_s) % 86400 + 86400) % 86400 / 60.0 - duration_min) filter (where isfinite(duration_min)  and duration_min between 0 and 1440 and arrival_s is not null), 6) as mean_gap from (select *, (departure_s // 60) % 60 as m from trips where departure_s is not null) group by all")
def x_clock_minutes(spark: SparkSession, folder: str) -> DataFrame:
    """Classes of departure minutes, and the clock's duration less the declared one."""
    rows = trips(spark, folder).where("departure_s is not null").withColumn("m", F.floor(F.col("departure_s") / 60) % 60)
    m, d = F.col("m"), F.col("duration_min")
    cls = F.when(m == 0, "hour").when(m == 30, "half").when(m % 15 == 0, "quarter").when(m % 5 == 0, "five").otherwise("other")
    gap = F.pmod(F.col("arrival_s") - F.col("departure_s"), F.lit(86400)) / 60.0 - d
    return rows.groupBy("survey", (m % 5 == 0).alias("on_five"), cls.alias("class")).agg(F.count("*").alias("trips"), F.round(F.avg(F.when(finite(d) & d.between(0, 1440), gap)), 6).alias("mean_gap"))


@query(f"with {TRIPS} select survey, case when not isfinite(distance_km_declared) then -2 when distance_km_declared < 0 or distance_km_declared >= 80 then -1 when distance_km_declared < 2 then 0 when distance_km_declared < 5 then 1 when distance_km_declared < 10 then 2 when distance_km_declared < 20 then 3 else 4 end as band, count(*) as trips, least(max(floor(distance_km_declared / 0.5)) filter (where isfinite(distance_km_declared)), 160)::bigint as last_half_km from trips where distance_km_declared is not null group by all")
def x_distance_bands(spark: SparkSession, folder: str) -> DataFrame:
    """Half-open distance bands, outside and non-finite ones apart."""
    d = F.col("distance_km_declared")
    band = F.when(~finite(d), -2).when((d < 0) | (d >= 80), -1).when(d < 2, 0).when(d < 5, 1).when(d < 10, 2).when(d < 20, 3).otherwise(4)
    rows = trips(spark, folder).where(d.isNotNull())
    return rows.groupBy("survey", band.alias("band")).agg(F.count("*").alias("trips"), F.least(F.max(F.when(finite(d), F.floor(d / 0.5))), F.lit(160).cast("long")).alias("last_half_km"))


@query(f"with {TRIPS}, t as (select destination_motive as motive, survey, count(*) as trips, sum(duration_min) filter (where isfinite(duration_min)) as minutes, count(*) filter (where mobloc = 1) as local, case when count(duration_min) = count(*) then sum(duration_min) end as complete_minutes from trips where not coalesce(isinf(duration_min) or isnan(duration_min), false) group by all) select motive, survey, trips, local, round(minutes, 6) as minutes, round(complete_minutes, 6) as complete_minutes from t")
def x_purpose_table(spark: SparkSession, folder: str) -> DataFrame:
    """Filtered sums by purpose, with one that is null as soon as an input is missing."""
    d = F.col("duration_min")
    rows = trips(spark, folder).where(d.isNull() | finite(d))
    return rows.groupBy(F.col("destination_motive").alias("motive"), "survey").agg(F.count("*").alias("trips"), F.count(F.when(F.col("mobloc") == 1, 1)).alias("local"), F.round(F.sum(d), 6).alias("minutes"), F.round(sum_if_complete(d), 6).alias("complete_minutes"))


@query(f"with {TRIPS} select survey, isodow(loaded_at)::int as weekday, month(loaded_at)::int as month, count(distinct day_id) as days, round(count(distinct day_id) / sum(count(distinct day_id)) over (partition by survey), 8) as share from trips group by survey, isodow(loaded_at), month(loaded_at)")
def x_calendar_mix(spark: SparkSession, folder: str) -> DataFrame:
    """Mix of weekdays and months."""
    rows = trips(spark, folder).groupBy("survey", (F.weekday("loaded_at") + 1).cast("int").alias("weekday"), F.month("loaded_at").alias("month")).agg(F.count_distinct("day_id").alias("days"))
    return rows.withColumn("share", F.round(F.col("days") / F.sum("days").over(W.partitionBy("survey")), 8))


@query(f"with {DAYS}, u as (select survey, day_id, unnest(non_walk_modes) as used, w, x from days where non_walk_modes is not null) select survey, used, count(*) as days, count(distinct day_id) as distinct_days, round(sum(w * x) / sum(w), 6) as mean_min from u group by all")
def x_mode_days(spark: SparkSession, folder: str) -> DataFrame:
    """Days by each mode used on them."""
    u = days(spark, folder).select("survey", "day_id", F.explode("non_walk_modes").alias("used"), "w", "x")
    return u.groupBy("survey", "used").agg(F.count("*").alias("days"), F.count_distinct("day_id").alias("distinct_days"), F.round(F.sum(F.col("w") * F.col("x")) / F.sum("w"), 6).alias("mean_min"))


@query(f"with {DAYS} select density, income, count(*) as n, case when count(*) >= 50 then round(sum(w * x) / sum(w), 6) end as mean_min, count(*) between 50 and 99 as caution from days group by all")
def x_heatmap(spark: SparkSession, folder: str) -> DataFrame:
    """Density by income, blank under fifty days and marked under a hundred."""
    g = days(spark, folder).groupBy("density", "income").agg(F.count("*").alias("n"), (F.sum(F.col("w") * F.col("x")) / F.sum("w")).alias("m"))
    return g.select("density", "income", "n", F.round(bs.suppressed(F.col("m"), F.col("n")), 6).alias("mean_min"), F.col("n").between(50, 99).alias("caution"))


@query(f"with {DAYS}, k as (select survey, category, income, count(*) as n, count(distinct hh) as households from days group by all) select survey, category, max(n) filter (where income = '1') as n_low, max(n) filter (where income = '5') as n_high, sum(n)::bigint as n_all, sum(households)::bigint as households from k group by all")
def x_support(spark: SparkSession, folder: str) -> DataFrame:
    """Support counts of the lowest and highest income class per category."""
    k = days(spark, folder).groupBy("survey", "category", "income").agg(F.count("*").alias("n"), F.count_distinct("hh").alias("households"))
    pick = lambda v: F.max(F.when(F.col("income") == v, F.col("n")))
    return k.groupBy("survey", "category").agg(pick("1").alias("n_low"), pick("5").alias("n_high"), F.sum("n").alias("n_all"), F.sum("households").alias("households"))


@query(
    f"""with {_BOTH}, r as (select survey, rep, sum(w * x * mult) filter (where income = '5') / nullif(sum(w * mult) filter (where income = '5'), 0) - sum(w * x * mult) filter (where income = '1') / nullif(sum(w * mult) filter (where income = '1'), 0) as gap from (select * from da join dra using (hh) union all select * from db join drb using (hh)) group by all),
    p as (select rep, max(gap) filter (where survey = 'b') - max(gap) filter (where survey = 'a') as change from r group by 1) select round(quantile_cont(change, 0.025), 6) as low, round(quantile_cont(change, 0.5), 6) as middle, round(quantile_cont(change, 0.975), 6) as high, count(change) as valid from p"""
)
def x_income_gap_change(spark: SparkSession, folder: str) -> DataFrame:
    """Change of the gap between the highest and lowest income class, paired by replicate."""
    w, x = F.col("w"), F.col("x")
    pick = {f"{n}{v}": F.when(F.col("income") == v, c) for v in ("1", "5") for n, c in (("w", w), ("x", w * x))}
    _, reps = _replicates(spark, folder, [], pick)
    gap = safe_div(F.col("x5"), F.col("w5")) - safe_div(F.col("x1"), F.col("w1"))
    p = reps.withColumn("gap", gap).groupBy("rep").agg((F.max(F.when(F.col("survey") == "b", F.col("gap"))) - F.max(F.when(F.col("survey") == "a", F.col("gap")))).alias("change"))
    return p.agg(*(F.round(F.expr(f"percentile(change, {q})"), 6).alias(n) for q, n in ((0.025, "low"), (0.5, "middle"), (0.975, "high"))), F.count("change").alias("valid"))


@query(
    f"""with {_BOTH}, r as (select survey, rep, sum(w * x * mult) / sum(w * mult) as t, sum(w * n * mult) / sum(w * mult) as n, sum(w * x * mult) / sum(w * n * mult) as m from (select * from da join dra using (hh) union all select * from db join drb using (hh)) group by all),
    p as (select rep, max(t) filter (where survey = 'a') as ta, max(t) filter (where survey = 'b') as tb, max(n) filter (where survey = 'a') as na, max(n) filter (where survey = 'b') as nb, max(m) filter (where survey = 'a') as ma, max(m) filter (where survey = 'b') as mb from r group by 1), d as (select (tb - ta) / ln(tb / ta) * ln(nb / na) as trips, (tb - ta) / ln(tb / ta) * ln(mb / ma) as minutes from p)
    select round(quantile_cont(trips, 0.025), 6) as trips_low, round(quantile_cont(trips, 0.975), 6) as trips_high, round(quantile_cont(minutes, 0.025), 6) as minutes_low, round(quantile_cont(minutes, 0.975), 6) as minutes_high from d"""
)
def x_bootstrap_decomposition(spark: SparkSession, folder: str) -> DataFrame:
    """The two-factor decomposition in each replicate, with intervals."""
    w = F.col("w")
    _, reps = _replicates(spark, folder, [], {"sw": w, "sx": w * F.col("x"), "sn": w * F.col("n")})
    r = reps.select("survey", "rep", (F.col("sx") / F.col("sw")).alias("t"), (F.col("sn") / F.col("sw")).alias("n"), (F.col("sx") / F.col("sn")).alias("m"))
    p = dc.side_by_side(r, ["rep"], "survey", "a", "b", ("t", "n", "m"))
    c = lambda x: (F.col(f"{x}_a"), F.col(f"{x}_b"))
    d = p.select(*(v.alias(k) for k, v in dc.log_terms(*c("t"), {"trips": (*c("n"), 1), "minutes": (*c("m"), 1)}).items()))
    return d.agg(*(F.round(F.expr(f"percentile({k}, {q})"), 6).alias(f"{k}_{n}") for k in ("trips", "minutes") for q, n in ((0.025, "low"), (0.975, "high"))))
