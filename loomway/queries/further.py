"""Further survey, spatial and report queries."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomway.functions import grid as gr
from loomway.functions.exprs import finite, norm_key, safe_div
from loomway.operators import decompose as dc
from loomway.operators import legs
from loomway.operators.relational import first_per_key
from loomway.queries.base import DAYS, TRIPS, days, key_sql, registry, trips
from loomway.queries.feeds import _laea, _projected
from loomway.queries.stats import merge_sql
from loomway.queries.survey import _legs_sql
from loomway.tables import table

QUERIES, SQL, query = registry()


@query(f"with h as (select {key_sql('ident_men')} as k, try_cast(tu99 as int) as size, nbuc, rec_id, row_number() over (partition by {key_sql('ident_men')} order by rec_id) as rn from q_tcm_menage where {key_sql('ident_men')} is not null) select case when size is null then 'unreadable' when size = 0 then 'rural' when size <= 3 then 'small' when size <= 6 then 'medium' else 'large' end as class, count(*) as households, count(*) filter (where nbuc is null or nbuc <= 0 or not isfinite(nbuc)) as invalid, round(avg(nbuc) filter (where nbuc > 0 and isfinite(nbuc)), 6) as mean_units from h where rn = 1 group by 1")
def s_household_classes(spark: SparkSession, folder: str) -> DataFrame:
    """Classes from raw texts, with the number of rows that break a rule."""
    h = table(spark, folder, "q_tcm_menage").withColumn("k", norm_key(F.col("ident_men"))).where("k is not null")
    h = first_per_key(h, ["k"], ["rec_id"]).withColumn("size", F.col("tu99").try_cast("int"))
    size, ok = F.col("size"), finite(F.col("nbuc")) & (F.col("nbuc") > 0)
    cls = F.when(size.isNull(), "unreadable").when(size == 0, "rural").when(size <= 3, "small").when(size <= 6, "medium").otherwise("large")
    return h.groupBy(cls.alias("class")).agg(F.count("*").alias("households"), F.count(F.when(~ok, 1)).alias("invalid"), F.round(F.avg(F.when(ok, F.col("nbuc"))), 6).alias("mean_units"))


@query(f"with {TRIPS}, d as (select day_id, count(*) as n, count(distinct num_dep) as numbers, min(num_dep) as first, max(num_dep) as last, count(distinct pond_jour) as weights from trips group by 1) select case when n <> numbers then 'repeated' when first <> 1 then 'starts late' when last <> n then 'gap' else 'sound' end as state, count(*) as days, sum(n)::bigint as trips, count(*) filter (where weights > 1) as several_weights from d group by 1")
def s_sequence_integrity(spark: SparkSession, folder: str) -> DataFrame:
    """Days whose trip numbers repeat, start late or leave gaps."""
    d = trips(spark, folder).groupBy("day_id").agg(F.count("*").alias("n"), F.count_distinct("num_dep").alias("numbers"), F.min("num_dep").alias("first"), F.max("num_dep").alias("last"), F.count_distinct("pond_jour").alias("weights"))
    n = F.col("n")
    state = F.when(n != F.col("numbers"), "repeated").when(F.col("first") != 1, "starts late").when(F.col("last") != n, "gap").otherwise("sound")
    return d.groupBy(state.alias("state")).agg(F.count("*").alias("days"), F.sum("n").alias("trips"), F.count(F.when(F.col("weights") > 1, 1)).alias("several_weights"))


_OK = "isfinite(duration_min) and duration_min between 0 and 1440 and (distance_km_declared is null or isfinite(distance_km_declared)) and isfinite(pond_jour)"


@query(f"with {_legs_sql('declared')}, d as (select day_id, any_value(survey) as survey, max(pond_jour) as w, sum(coalesce(bike_ride_s, duration_min * 60)) as ride_s, sum(walk_min) as walk, sum(distance_km) as km, count(*) as n from legs where mode_group = 'cycle' and {_OK} group by 1) select survey, count(*) as days, round(sum(w * ride_s) / sum(w), 4) as ride_s, round(sum(w * walk) / sum(w), 6) as walk_min, round(sum(w * km) filter (where km is not null) / sum(w) filter (where km is not null), 6) as km, round(sum(w * n) / sum(w), 6) as trips from d group by 1")
def s_cycle_components(spark: SparkSession, folder: str) -> DataFrame:
    """Components of cycling summed per day before days are weighted."""
    d_, k = F.col("duration_min"), F.col("distance_km_declared")
    rows = legs.trip_legs(trips(spark, folder)).where((F.col("mode_group") == "cycle") & finite(d_) & d_.between(0, 1440) & (k.isNull() | finite(k)) & finite(F.col("pond_jour")))
    d = rows.groupBy("day_id").agg(F.min("survey").alias("survey"), F.max("pond_jour").alias("w"), F.sum(F.coalesce("bike_ride_s", d_ * 60)).alias("ride_s"), F.sum("walk_min").alias("walk"), F.sum("distance_km").alias("km"), F.count("*").alias("n"))
    w = F.col("w")
    mean = lambda c: safe_div(F.sum(w * F.col(c)), F.sum(w))
    return d.groupBy("survey").agg(F.count("*").alias("days"), F.round(mean("ride_s"), 4).alias("ride_s"), F.round(mean("walk"), 6).alias("walk_min"), F.round(safe_div(F.sum(w * F.col("km")), F.sum(F.when(F.col("km").isNotNull(), w))), 6).alias("km"), F.round(mean("n"), 6).alias("trips"))


_MODES = ("car_driver", "car_passenger", "urban_pt", "cycle", "walking_only", "multimodal")


@query(f"with {DAYS} select survey, category, " + ", ".join(f"round(coalesce(sum(w * x) filter (where mode = '{m}'), 0) / sum(w), 6) as {m}, count(*) filter (where mode = '{m}') as n_{m}" for m in _MODES) + " from days group by all")
def x_person_modes(spark: SparkSession, folder: str) -> DataFrame:
    """Minutes per day in each kind of day, one column each; days of other kinds count as zero."""
    w, x, m = F.col("w"), F.col("x"), F.col("mode")
    cols = [c for k in _MODES for c in (F.round(F.coalesce(F.sum(F.when(m == k, w * x)), F.lit(0.0)) / F.sum(w), 6).alias(k), F.count(F.when(m == k, 1)).alias(f"n_{k}"))]
    return days(spark, folder).groupBy("survey", "category").agg(*cols)


#: Share of a target mix that a sample may lack.
LOST_LIMIT = 0.1


@query(f"with {DAYS}, c as (select survey, density as cell, sum(w) as weight, sum(w * x) as total from days group by all), t as (select cell, sum(weight / sw) / 2 as share from c join (select survey, sum(weight) as sw from c group by 1) using (survey) group by 1) select survey, case when 1 - sum(share) <= {LOST_LIMIT} then round(sum(share * total / weight) / sum(share), 6) end as value, round(1 - sum(share) / 1.0, 8) as lost_share from c join t using (cell) where weight > 0 group by 1")
def x_pooled_mix(spark: SparkSession, folder: str) -> DataFrame:
    """Both surveys at their pooled mix of densities; blank where more than LOST_LIMIT of the mix is lost."""
    c = days(spark, folder).groupBy("survey", F.col("density").alias("cell")).agg(F.sum("w").alias("weight"), F.sum(F.col("w") * F.col("x")).alias("total"))
    s = W.partitionBy("survey")  # one row per density
    t = c.withColumn("s", F.col("weight") / F.sum("weight").over(s)).groupBy("cell").agg((F.sum("s") / 2).alias("share"))
    return dc.to_target_mix(c, t).select("survey", F.when(F.col("lost_share") <= LOST_LIMIT, F.round("value", 6)).alias("value"), F.round("lost_share", 8).alias("lost_share"))


@query(
    f"""with recursive {DAYS}, c as (select income::int as income, n::int as level, least(count(*) filter (where survey = 'a'), count(*) filter (where survey = 'b'))::bigint as size from days where income <> 'unknown' group by all), {merge_sql("income, ", "level", "size", "c", 20)}
    select income, level, list_max(list_filter(firsts, lambda f: f <= level)) as cell from c join (select income, arg_min(firsts, len(firsts)) as firsts from m group by 1) using (income)"""
)
def x_joint_cells(spark: SparkSession, folder: str) -> DataFrame:
    """Income by number of trips, joined along the trips until both surveys have twenty days in each cell."""

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        m = dc.collapse_cells({(r.income, r.level): (r.a, r.b) for r in pdf.itertuples()}, 20)
        return pd.DataFrame(sorted((i, lv, to) for (i, lv), to in m.items()), columns=["income", "level", "cell"])

    # A class has a count for each number of trips.
    c = days(spark, folder).where("income <> 'unknown'").groupBy(F.col("income").cast("int").alias("income"), F.col("n").cast("int").alias("level")).agg(*(F.count(F.when(F.col("survey") == s, 1)).alias(s) for s in "ab"))
    return c.groupBy("income").applyInPandas(merge, "income int, level int, cell int")


@query(f"with {TRIPS}, t as (select survey, pond_jour as w, duration_min as d, floor(duration_min / 15 + 0.5) * 15 as coarse, ((arrival_s - departure_s) % 86400 + 86400) % 86400 / 60.0 as clock from trips where isfinite(duration_min) and duration_min between 0 and 1440 and isfinite(pond_jour) and departure_s is not null and arrival_s is not null), m as (select survey, sum(w * d) / sum(w) as declared, sum(w * coarse) / sum(w) as coarse, sum(w * clock) / sum(w) as clock from t group by 1) select survey, effect, round(v, 6) as minutes from (select survey, 'declared' as effect, declared as v from m union all select survey, 'rounding', coarse - declared from m union all select survey, 'clock', clock - declared from m)")
def y_measurement_ledger(spark: SparkSession, folder: str) -> DataFrame:
    """What rounding to quarter hours and the clock instead of the declared duration change, side by side."""
    d, w = F.col("duration_min"), F.col("pond_jour")
    rows = trips(spark, folder).where(finite(d) & d.between(0, 1440) & finite(w) & F.col("departure_s").isNotNull() & F.col("arrival_s").isNotNull())
    clock = F.pmod(F.col("arrival_s") - F.col("departure_s"), F.lit(86400)) / 60.0
    m = rows.groupBy("survey").agg(safe_div(F.sum(w * d), F.sum(w)).alias("declared"), safe_div(F.sum(w * F.floor(d / 15 + 0.5) * 15), F.sum(w)).alias("coarse"), safe_div(F.sum(w * clock), F.sum(w)).alias("clock"))
    effects = {"declared": F.col("declared"), "rounding": F.col("coarse") - F.col("declared"), "clock": F.col("clock") - F.col("declared")}
    return m.select("survey", F.explode(F.array(*(F.struct(F.lit(k).alias("effect"), F.round(c, 6).alias("minutes")) for k, c in effects.items()))).alias("z")).select("survey", "z.*")


@query(f"with {_laea()}, c as (select (floor(y / 1000) * 100000 + floor(x / 1000))::bigint as cell, id, x, y, lag(x) over o as px, lag(y) over o as py from xy window o as (partition by (floor(y / 1000) * 100000 + floor(x / 1000)) order by id)) select cell, count(*) as points, case when cell is not null then round(coalesce(sum(sqrt((x - px) * (x - px) + (y - py) * (y - py))), 0), 2) end as length, round(min(x), 2) as xmin, round(max(x), 2) as xmax, round(min(y), 2) as ymin, round(max(y), 2) as ymax, round(avg(x), 2) as cx, round(avg(y), 2) as cy from c group by 1")
def g_assembled_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Lines from each cell's nodes in the order of their ids: points, length, envelope and middle; points outside the domain are counted in a null cell without a line."""
    every = _projected(spark, folder)
    p = every.where("x is not null").withColumn("cell", gr.cell_id(F.col("y"), F.col("x"), 1000))
    o = W.partitionBy("cell").orderBy("id")
    p = p.withColumns({"px": F.lag("x").over(o), "py": F.lag("y").over(o)})
    step = F.sqrt((F.col("x") - F.col("px")) * (F.col("x") - F.col("px")) + (F.col("y") - F.col("py")) * (F.col("y") - F.col("py")))
    r = lambda c, n: F.round(c, 2).alias(n)
    outside = every.where("x is null").agg(F.count("*").alias("points")).where("points > 0")
    lines = p.groupBy("cell").agg(F.count("*").alias("points"), r(F.coalesce(F.sum(step), F.lit(0.0)), "length"), r(F.min("x"), "xmin"), r(F.max("x"), "xmax"), r(F.min("y"), "ymin"), r(F.max("y"), "ymax"), r(F.avg("x"), "cx"), r(F.avg("y"), "cy"))
    return lines.unionByName(outside, allowMissingColumns=True)


@query(f"with {DAYS}, k as (select survey, mode, income, count(*) as n, sum(w) as w, sum(w * x) as t from days group by all), c as (select mode, income, max(t / w) filter (where survey = 'a') as a, max(t / w) filter (where survey = 'b') as b, sum(n)::bigint as n, max(w) filter (where survey = 'b') as wb from k group by all) select mode, count(*) as cells, count(*) filter (where b / a between 1 / 1.1 and 1.1) as equivalent, round(coalesce(sum(wb) filter (where b / a between 1 / 1.1 and 1.1), 0) / sum(wb), 8) as equivalent_share, round(max(abs(ln(b / a))), 8) as max_abs_log, round(sum(wb * abs(ln(b / a))) / sum(wb), 8) as mean_abs_log, arg_max(income, struct_pack(v := round(abs(ln(b / a)), 9), i := income)) as most_moved from c where a > 0 and b > 0 group by 1")
def x_grouping_statistics(spark: SparkSession, folder: str) -> DataFrame:
    """Cells of each mode by income: how many keep their level, and how far they move."""
    k = days(spark, folder).groupBy("survey", "mode", "income").agg(F.count("*").alias("n"), F.sum("w").alias("w"), (F.sum(F.col("w") * F.col("x")) / F.sum("w")).alias("m"))
    c = dc.side_by_side(k, ["mode", "income"], "survey", "a", "b", ("m", "w")).where("m_a > 0 and m_b > 0")
    q = F.col("m_b") / F.col("m_a")
    move = F.abs(F.ln(q))
    return c.groupBy("mode").agg(F.count("*").alias("cells"), F.count(F.when(q.between(1 / 1.1, 1.1), 1)).alias("equivalent"), F.round(safe_div(F.coalesce(F.sum(F.when(q.between(1 / 1.1, 1.1), F.col("w_b"))), F.lit(0.0)), F.sum("w_b")), 8).alias("equivalent_share"), F.round(F.max(move), 8).alias("max_abs_log"), F.round(safe_div(F.sum(F.col("w_b") * move), F.sum("w_b")), 8).alias("mean_abs_log"), F.max_by("income", F.struct(F.round(move, 9).alias("v"), F.col("income").alias("i"))).alias("most_moved"))


@query("with o as (select rec_id, unnest(regexp_extract_all(coalesce(notes, '') || ' ' || coalesce(mode, ''), '[a-z]+')) as word from pt_openings_mapping) select word, count(*) as uses, count(distinct rec_id) as openings from o group by 1")
def f_word_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Words taken out of texts by a pattern, one row each, and counted."""
    o = table(spark, folder, "pt_openings_mapping", "rec_id", "notes", "mode")
    text = F.concat(F.coalesce("notes", F.lit("")), F.lit(" "), F.coalesce("mode", F.lit("")))
    return o.select("rec_id", F.explode(F.regexp_extract_all(text, F.lit("([a-z]+)"), 1)).alias("word")).groupBy("word").agg(F.count("*").alias("uses"), F.count_distinct("rec_id").alias("openings"))
