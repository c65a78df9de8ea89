"""Relational operators: joins, aggregates, windows, sets, sorting and scalar functions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomway.functions.exprs import code_map, drawn_below, drawn_below_sql, norm_key, safe_div
from loomway.operators.relational import keep_best, repeated_keys
from loomway.queries.base import TRIPS, key_sql, registry, trips
from loomway.tables import table

QUERIES, SQL, query = registry()

# --- joins


@query("select n_name, r_name, count(*) as customers, round(sum(c_acctbal), 2) as balance from customer join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey group by all")
def j_star(spark: SparkSession, folder: str) -> DataFrame:
    """Inner star join; Catalyst broadcasts the small sides by their size."""
    c, n, r = (table(spark, folder, t) for t in ("customer", "nation", "region"))
    return c.join(n, c.c_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey).groupBy("n_name", "r_name").agg(F.count("*").alias("customers"), F.round(F.sum("c_acctbal"), 2).alias("balance"))


@query(f"with {TRIPS}, h as (select {key_sql('ident_men')} as hh, min(tu99) as tu99, max(nbuc) as nbuc from q_tcm_menage where deleted_at is null group by 1) select t.survey, h.tu99, count(*) as trips, count(h.nbuc) as with_income, count(distinct t.hh) as households from trips t left join h using (hh) group by all")
def j_left_enrich(spark: SparkSession, folder: str) -> DataFrame:
    """Left join that enriches trips with their household; a third of trips may share one key, which AQE splits."""
    h = table(spark, folder, "q_tcm_menage").where("deleted_at is null").groupBy(norm_key(F.col("ident_men")).alias("hh")).agg(F.min("tu99").alias("tu99"), F.max("nbuc").alias("nbuc"))
    t = trips(spark, folder).select("survey", "hh")
    return t.join(h, "hh", "left").groupBy("survey", "tu99").agg(F.count("*").alias("trips"), F.count("nbuc").alias("with_income"), F.count_distinct("hh").alias("households"))


@query("with m as (select o_custkey, sum(o_totalprice) as s from orders where o_orderstatus = 'P' group by 1) select c_custkey, round(coalesce(s, 0), 2) as partial_total from customer left join m on c_custkey = o_custkey")
def j_left_zero(spark: SparkSession, folder: str) -> DataFrame:
    """Every customer, those without matching orders with zero."""
    m = table(spark, folder, "orders").where("o_orderstatus = 'P'").groupBy("o_custkey").agg(F.sum("o_totalprice").alias("s"))
    c = table(spark, folder, "customer", "c_custkey")
    return c.join(m, c.c_custkey == m.o_custkey, "left").select("c_custkey", F.round(F.coalesce("s", F.lit(0.0)), 2).alias("partial_total"))


@query("select o_orderpriority, count(*) as orders from orders o where exists (select 1 from lineitem l where l.l_orderkey = o.o_orderkey and l.l_returnflag = 'R') and not exists (select 1 from lineitem l where l.l_orderkey = o.o_orderkey and l.l_quantity > 48) group by 1")
def j_semi_anti(spark: SparkSession, folder: str) -> DataFrame:
    """EXISTS and NOT EXISTS as semi and anti joins."""
    o = table(spark, folder, "orders", "o_orderkey", "o_orderpriority")
    line = table(spark, folder, "lineitem", F.col("l_orderkey").alias("o_orderkey"), "l_returnflag", "l_quantity")
    return o.join(line.where("l_returnflag = 'R'"), "o_orderkey", "left_semi").join(line.where("l_quantity > 48"), "o_orderkey", "left_anti").groupBy("o_orderpriority").agg(F.count("*").alias("orders"))


@query("select s_suppkey from supplier where s_nationkey not in (select c_nationkey from customer where c_acctbal > 9900) and s_suppkey in (select l_suppkey from lineitem where l_discount > 0.05)")
def j_in_not_in(spark: SparkSession, folder: str) -> DataFrame:
    """IN and null-aware NOT IN."""
    for t in ("supplier", "customer", "lineitem"):
        table(spark, folder, t).createOrReplaceTempView(f"_in_{t}")
    return spark.sql("select s_suppkey from _in_supplier where s_nationkey not in (select c_nationkey from _in_customer where c_acctbal > 9900) and s_suppkey in (select l_suppkey from _in_lineitem where l_discount > 0.05)")


@query("select p_partkey, exists (select 1 from lineitem l where l.l_partkey = p.p_partkey and l.l_quantity >= 50 and l.l_discount >= 0.09) as deep_discount from part p")
def j_exists_flag(spark: SparkSession, folder: str) -> DataFrame:
    """EXISTS as a projected flag: distinct keys, left join, not null."""
    keys = table(spark, folder, "lineitem").where("l_quantity >= 50 and l_discount >= 0.09").select(F.col("l_partkey").alias("p_partkey")).distinct().withColumn("hit", F.lit(True))
    return table(spark, folder, "part", "p_partkey").join(keys, "p_partkey", "left").select("p_partkey", F.coalesce("hit", F.lit(False)).alias("deep_discount"))


@query("select r, k, count(*) filter (where l_quantity <= r) as lines, round(sum(l_extendedprice) filter (where l_quantity <= r and l_discount * 100 >= k), 2) as amount from lineitem, (select unnest([10.0, 25.0, 40.0])::double as r), (select unnest([0, 5]) as k) group by r, k")
def j_parameter_grid(spark: SparkSession, folder: str) -> DataFrame:
    """A grid of parameters against all rows: rows are summed to cells of the parameters' columns before they meet the grid."""
    line = table(spark, folder, "lineitem").groupBy("l_quantity", "l_discount").agg(F.count("*").alias("n"), F.sum("l_extendedprice").alias("s"))
    g = spark.createDataFrame([(r, k) for r in (10.0, 25.0, 40.0) for k in (0, 5)], "r double, k int")
    low = F.col("l_quantity") <= F.col("r")
    return line.crossJoin(F.broadcast(g)).groupBy("r", "k").agg(F.sum(F.when(low, F.col("n")).otherwise(0)).alias("lines"), F.round(F.sum(F.when(low & (F.col("l_discount") * 100 >= F.col("k")), F.col("s"))), 2).alias("amount"))


@query("select d.day_id, u.i::int as place, u.m as mode from (select day_id, rec_id, non_walk_modes from day_summary) d, lateral (select unnest(non_walk_modes) as m, generate_subscripts(non_walk_modes, 1) as i) u")
def j_unnest_ordinality(spark: SparkSession, folder: str) -> DataFrame:
    """Array elements with their places from 1."""
    return table(spark, folder, "day_summary", "day_id", "non_walk_modes").select("day_id", F.posexplode("non_walk_modes").alias("place", "mode")).withColumn("place", F.col("place") + 1)


@query("with z as (select vec_id, label, unnest(list_zip(embedding, range(1, len(embedding) + 1))) as e from embeddings) select label, e[2]::int as dim, count(*) as n, round(avg(e[1]::double), 8) as mean from z group by label, e[2]")
def j_zip_unnest(spark: SparkSession, folder: str) -> DataFrame:
    """Index-aligned arrays taken apart together."""
    e = table(spark, folder, "embeddings")
    z = e.select("label", F.explode(F.arrays_zip(F.col("embedding").alias("v"), F.sequence(F.lit(1), F.size("embedding")).alias("dim"))).alias("z"))
    return z.groupBy("label", F.col("z.dim").alias("dim")).agg(F.count("*").alias("n"), F.round(F.avg(F.col("z.v").cast("double")), 8).alias("mean"))


@query("with a as (select p_partkey, p_brand, p_type from part where p_size > 45), b as (select p_brand, p_type from part where p_size < 3) select a.p_partkey, count(*) as partners from a join b on a.p_brand = b.p_brand or a.p_type = b.p_type group by 1")
def j_either_key(spark: SparkSession, folder: str) -> DataFrame:
    """Equal on one key or the other: a join for each, the second without what the first has; partners are counted per key before."""
    p = table(spark, folder, "part", "p_partkey", "p_brand", "p_type", "p_size")
    a, b = p.where("p_size > 45"), p.where("p_size < 3")
    by = lambda keys: b.groupBy(*keys).agg(F.count("*").alias("n"))
    brand, kind, both = (a.join(by(k), k).select("p_partkey", (F.col("n") * s).alias("n")) for k, s in ((["p_brand"], 1), (["p_type"], 1), (["p_brand", "p_type"], -1)))
    return brand.unionByName(kind).unionByName(both).groupBy("p_partkey").agg(F.sum("n").alias("partners"))


@query("select l_orderkey, l_linenumber, count(*) as rows from lineitem group by all having count(*) > 1")
def j_many_to_many_guard(spark: SparkSession, folder: str) -> DataFrame:
    """Keys that would multiply rows in a join."""
    return repeated_keys(table(spark, folder, "lineitem", "l_orderkey", "l_linenumber"), ["l_orderkey", "l_linenumber"])


@query(f"with {TRIPS}, seg as (select day_id, min(num_dep) filter (where mobloc = 1) as a, max(num_dep) filter (where mobloc = 1) as z from trips group by 1) select t.day_id, count(*) as inside, a::int as a, z::int as z from trips t join seg s on s.day_id = t.day_id and t.num_dep between a and z group by t.day_id, a, z")
def j_index_range(spark: SparkSession, folder: str) -> DataFrame:
    """Rows between two places of their own chain: an equi join with a residual."""
    t = trips(spark, folder).select("day_id", "num_dep", "mobloc")
    local = F.when(F.col("mobloc") == 1, F.col("num_dep"))
    seg = t.groupBy("day_id").agg(F.min(local).alias("a"), F.max(local).alias("z"))
    return t.join(seg, "day_id").where("num_dep between a and z").groupBy("day_id", "a", "z").agg(F.count("*").alias("inside"))


# --- aggregates


@query("select l_returnflag, l_linestatus, count(*) as n, sum(l_quantity) as qty, round(sum(l_extendedprice * (1 - l_discount)), 2) as revenue, round(avg(l_discount), 8) as discount, count(*) filter (where l_quantity > 25) as big, round(sum(l_extendedprice) filter (where l_tax > 0.04) / sum(l_extendedprice), 8) as taxed_share from lineitem where l_shipdate <= timestamp '2000-12-01' group by all")
def a_filtered(spark: SparkSession, folder: str) -> DataFrame:
    """Grouped and filtered aggregates over a pruned scan."""
    p, d = F.col("l_extendedprice"), F.col("l_discount")
    line = table(spark, folder, "lineitem").where(F.col("l_shipdate") <= F.lit("2000-12-01").cast("timestamp_ntz"))
    return line.groupBy("l_returnflag", "l_linestatus").agg(
        F.count("*").alias("n"), F.sum("l_quantity").alias("qty"), F.round(F.sum(p * (1 - d)), 2).alias("revenue"), F.round(F.avg(d), 8).alias("discount"),
        F.count(F.when(F.col("l_quantity") > 25, 1)).alias("big"), F.round(safe_div(F.sum(F.when(F.col("l_tax") > 0.04, p)), F.sum(p)), 8).alias("taxed_share"),
    )


@query("select user_id, arg_min(event_type, ts) as first_type, arg_max(event_type, ts) as last_type, bool_and(value >= 0) as all_positive, bool_or(event_type = 'purchase') as bought, count(distinct event_type) as types, array_to_string(list_sort(list(distinct event_type) filter (where event_type <> 'view')), ',') as kinds, array_to_string(list(event_type order by ts)[1:5], ',') as start from events group by 1")
def a_first_last_lists(spark: SparkSession, folder: str) -> DataFrame:
    """Ordered first and last, boolean aggregates, distinct counts, sets and ordered lists."""
    e = table(spark, folder, "events")
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("ts", "event_type"))), lambda s: s["event_type"])
    return e.groupBy("user_id").agg(
        F.min_by("event_type", "ts").alias("first_type"), F.max_by("event_type", "ts").alias("last_type"), F.bool_and(F.col("value") >= 0).alias("all_positive"), F.bool_or(F.col("event_type") == "purchase").alias("bought"),
        F.count_distinct("event_type").alias("types"), F.array_join(F.sort_array(F.collect_set(F.when(F.col("event_type") != "view", F.col("event_type")))), ",").alias("kinds"), F.array_join(F.slice(ordered, 1, 5), ",").alias("start"),
    )


@query("select o_orderstatus, o_orderpriority, grouping(o_orderstatus)::int as g1, grouping(o_orderpriority)::int as g2, count(*) as n, round(sum(o_totalprice), 2) as total from orders group by grouping sets ((o_orderstatus, o_orderpriority), (o_orderstatus), (o_orderpriority), ())")
def a_grouping_sets(spark: SparkSession, folder: str) -> DataFrame:
    g = table(spark, folder, "orders").groupingSets([["o_orderstatus", "o_orderpriority"], ["o_orderstatus"], ["o_orderpriority"], []], "o_orderstatus", "o_orderpriority")
    return g.agg(F.grouping("o_orderstatus").cast("int").alias("g1"), F.grouping("o_orderpriority").cast("int").alias("g2"), F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("select survey_field, round(filled, 8) as filled from (select 'distcor' as survey_field, count(try_cast(distcor as double)) / count(*) as filled from k_deploc union all select 'v2_mduree', count(try_cast(v2_mduree as double)) / count(*) from k_deploc union all select 'v2_vac_scol', count(try_cast(v2_vac_scol as double)) / count(*) from k_deploc)")
def a_fill_rate(spark: SparkSession, folder: str) -> DataFrame:
    """Share of rows whose text is a number, per column, in one scan."""
    cols = ("distcor", "v2_mduree", "v2_vac_scol")
    one = table(spark, folder, "k_deploc", *cols).agg(*(safe_div(F.count(F.col(c).try_cast("double")), F.count("*")).alias(c) for c in cols))
    return one.select(F.explode(F.array(*(F.struct(F.lit(c).alias("survey_field"), F.round(F.col(c), 8).alias("filled")) for c in cols))).alias("z")).select("z.*")


@query("with g as (select c_mktsegment, sum(c_acctbal) as s, count(*) as n from customer where c_acctbal > 0 group by 1) select c_mktsegment, round(s / sum(s) over (), 8) as share, round(n / sum(n) over (), 8) as count_share from g")
def a_share_of_total(spark: SparkSession, folder: str) -> DataFrame:
    g = table(spark, folder, "customer").where("c_acctbal > 0").groupBy("c_mktsegment").agg(F.sum("c_acctbal").alias("s"), F.count("*").alias("n"))
    all_ = W.partitionBy()  # one row per segment
    return g.select("c_mktsegment", F.round(F.col("s") / F.sum("s").over(all_), 8).alias("share"), F.round(F.col("n") / F.sum("n").over(all_), 8).alias("count_share"))


@query("select l_returnflag, count(*) filter (where l_discount > 0.05 and l_tax > 0.04) as tp, count(*) filter (where l_discount > 0.05 and l_tax <= 0.04) as fp, count(*) filter (where l_discount <= 0.05 and l_tax > 0.04) as fn, round(count(*) filter (where l_discount > 0.05 and l_tax > 0.04) / nullif(count(*) filter (where l_discount > 0.05), 0), 8) as precision, round(2 * count(*) filter (where l_discount > 0.05 and l_tax > 0.04) / nullif(count(*) filter (where l_discount > 0.05) + count(*) filter (where l_tax > 0.04), 0), 8) as f1 from lineitem group by 1")
def a_confusion(spark: SparkSession, folder: str) -> DataFrame:
    """Confusion counts, precision and F1 of one flag against another."""
    from loomway.operators.feeds import scores

    s = scores(F.col("l_discount") > 0.05, F.col("l_tax") > 0.04)
    return table(spark, folder, "lineitem").groupBy("l_returnflag").agg(*(s[k].alias(k) for k in ("tp", "fp", "fn")), *(F.round(s[k], 8).alias(k) for k in ("precision", "f1")))


@query("select o_custkey, count(*) as orders, any_value(o_orderpriority) is not null as has_priority, round(max(o_totalprice), 2) as most from orders group by all having count(*) >= 15")
def a_having(spark: SparkSession, folder: str) -> DataFrame:
    o = table(spark, folder, "orders").groupBy("o_custkey").agg(F.count("*").alias("orders"), F.any_value("o_orderpriority", True).isNotNull().alias("has_priority"), F.round(F.max("o_totalprice"), 2).alias("most"))
    return o.where("orders >= 15")


@query("with t as (select o_custkey, o_orderstatus, sum(o_totalprice) as s from orders group by all) select o_orderstatus, round(avg(s), 4) as mean_of_totals, round(max(s), 2) as most, count(*) as customers from t group by 1")
def a_two_level(spark: SparkSession, folder: str) -> DataFrame:
    """Totals per customer, then over customers."""
    t = table(spark, folder, "orders").groupBy("o_custkey", "o_orderstatus").agg(F.sum("o_totalprice").alias("s"))
    return t.groupBy("o_orderstatus").agg(F.round(F.avg("s"), 4).alias("mean_of_totals"), F.round(F.max("s"), 2).alias("most"), F.count("*").alias("customers"))


# --- windows and sorting


@query("with o as (select *, row_number() over (partition by o_custkey order by o_totalprice desc, o_orderkey) as rn, count(*) over (partition by o_custkey) as n, lag(o_totalprice) over (partition by o_custkey order by o_orderdate, o_orderkey) as prev, sum(o_totalprice) over (partition by o_custkey order by o_orderdate, o_orderkey rows between unbounded preceding and 1 preceding) as before from orders) select o_custkey, o_orderkey, n, round(prev, 2) as prev, round(before, 2) as before from o where rn <= 3")
def w_top_lag_running(spark: SparkSession, folder: str) -> DataFrame:
    """Top three per customer, with the previous order and the sum of all earlier ones."""
    top, time = W.partitionBy("o_custkey").orderBy(F.col("o_totalprice").desc(), "o_orderkey"), W.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    o = table(spark, folder, "orders").withColumns({"rn": F.row_number().over(top), "n": F.count("*").over(W.partitionBy("o_custkey")), "prev": F.lag("o_totalprice").over(time), "before": F.sum("o_totalprice").over(time.rowsBetween(W.unboundedPreceding, -1))})
    return o.where("rn <= 3").select("o_custkey", "o_orderkey", "n", F.round("prev", 2).alias("prev"), F.round("before", 2).alias("before"))


@query("select l_orderkey, l_partkey, l_quantity from (select *, max(l_quantity) over (partition by l_orderkey) as best from lineitem) where l_quantity = best")
def w_keep_ties(spark: SparkSession, folder: str) -> DataFrame:
    """All lines that tie for an order's largest quantity."""
    return keep_best(table(spark, folder, "lineitem"), ["l_orderkey"], F.col("l_quantity")).select("l_orderkey", "l_partkey", "l_quantity")


@query("with m as (select quantile_cont(l_extendedprice, 0.5) as med from lineitem where l_returnflag = 'A') select l_shipdate::date as day, count(*) filter (where l_extendedprice > med) as above, count(*) as n from lineitem, m group by 1")
def w_conditional_median(spark: SparkSession, folder: str) -> DataFrame:
    """Every row against one conditional median: an aggregate of one row, joined, not a window over everything."""
    line = table(spark, folder, "lineitem", "l_returnflag", "l_extendedprice", "l_shipdate")
    med = line.where("l_returnflag = 'A'").agg(F.expr("percentile(l_extendedprice, 0.5)").alias("med"))
    return line.crossJoin(F.broadcast(med)).groupBy(F.to_date("l_shipdate").alias("day")).agg(F.count(F.when(F.col("l_extendedprice") > F.col("med"), 1)).alias("above"), F.count("*").alias("n"))


@query("with g as (select user_id, ts, event_type, case when lag(ts) over (partition by user_id order by ts) is null or date_diff('second', lag(ts) over (partition by user_id order by ts), ts) > 21600 then 1 else 0 end as new from events), s as (select *, sum(new) over (partition by user_id order by ts rows unbounded preceding) as session from g) select user_id, session::bigint as session, count(*) as events, min(ts) as start_ts, max(ts) as end_ts from s group by all")
def w_sessions(spark: SparkSession, folder: str) -> DataFrame:
    """Sessions by gaps of six hours: a running count of starts."""
    w = W.partitionBy("user_id").orderBy("ts")
    gap = F.timestamp_diff("SECOND", F.lag("ts").over(w), F.col("ts"))
    s = table(spark, folder, "events").withColumn("new", F.when(gap.isNull() | (gap > 21600), 1).otherwise(0)).withColumn("session", F.sum("new").over(w.rowsBetween(W.unboundedPreceding, 0)))
    return s.groupBy("user_id", "session").agg(F.count("*").alias("events"), F.min("ts").alias("start_ts"), F.max("ts").alias("end_ts"))


@query("select o_orderkey, o_totalprice from orders order by o_totalprice desc, o_orderkey limit 25")
def o_top_k(spark: SparkSession, folder: str) -> DataFrame:
    """Top of the whole table, which is the feature: take-ordered, no full sort."""
    return table(spark, folder, "orders", "o_orderkey", "o_totalprice").orderBy(F.col("o_totalprice").desc(), "o_orderkey").limit(25)


@query("with g as (select p_brand, p_size, count(*) as n, round(avg(p_retailprice), 6) as m from part group by all) select p_brand, arg_max(p_size, struct_pack(a := n, b := m, c := -p_size)) as size, max(n) as n from g group by 1")
def o_lexicographic_argmax(spark: SparkSession, folder: str) -> DataFrame:
    """Best row of each group by a key of several columns."""
    g = table(spark, folder, "part").groupBy("p_brand", "p_size").agg(F.count("*").alias("n"), F.round(F.avg("p_retailprice"), 6).alias("m"))
    return g.groupBy("p_brand").agg(F.max_by("p_size", F.struct("n", "m", -F.col("p_size"))).alias("size"), F.max("n").alias("n"))


# --- sets, literals and optional columns


@query("select k, side, count(*) as n from (select c_nationkey as k, 'customer' as side from customer union all select s_nationkey, 'supplier' from supplier) group by all union all select k, 'both', 0 from (select c_nationkey as k from customer union select s_nationkey from supplier)")
def u_union(spark: SparkSession, folder: str) -> DataFrame:
    """Union of all and of distinct rows."""
    c, s = table(spark, folder, "customer", F.col("c_nationkey").alias("k")), table(spark, folder, "supplier", F.col("s_nationkey").alias("k"))
    each = c.withColumn("side", F.lit("customer")).unionByName(s.withColumn("side", F.lit("supplier"))).groupBy("k", "side").agg(F.count("*").alias("n"))
    return each.unionByName(c.union(s).distinct().select("k", F.lit("both").alias("side"), F.lit(0).cast("long").alias("n")))


@query("select l_partkey from (select distinct l_partkey from lineitem where l_returnflag = 'R') where l_partkey not in (select l_partkey from lineitem where l_quantity > 46)")
def u_difference(spark: SparkSession, folder: str) -> DataFrame:
    line = table(spark, folder, "lineitem", "l_partkey", "l_returnflag", "l_quantity")
    return line.where("l_returnflag = 'R'").select("l_partkey").distinct().join(line.where("l_quantity > 46"), "l_partkey", "left_anti")


@query("select date_key, count(*) as rows from (select '2008' as date_key, ident_dep from trips_norm where starts_with(day_id, 'J') union all select '2019', ident_dep from trips_norm where not starts_with(day_id, 'J')) group by 1")
def u_dated_union(spark: SparkSession, folder: str) -> DataFrame:
    """Several caches under their dates, and an empty one of the same type where a file is missing."""
    t = table(spark, folder, "trips_norm", "day_id", "ident_dep")
    j = F.startswith("day_id", F.lit("J"))
    parts = [t.where(j).select(F.lit("2008").alias("date_key"), "ident_dep"), t.where(~j).select(F.lit("2019").alias("date_key"), "ident_dep"), spark.createDataFrame([], "date_key string, ident_dep string")]
    return reduce(DataFrame.unionByName, parts).groupBy("date_key").agg(F.count("*").alias("rows"))


@query("select source, lang, count(*) as documents, count(*) filter (where text is null or trim(text) = '') as blank, round(avg(length(text)), 4) as mean_length, max(n_chars) as longest, count(*) filter (where contains(lower(text), 'tram')) as trams, count(*) filter (where regexp_matches(text, '[0-9]{4}-[0-9]{2}-[0-9]{2}')) as dated, count(distinct upper(network)) as networks, min(year(published_at))::int as first_year, max(date_diff('day', published_at::date, loaded_at::date))::int as longest_lag from documents group by all")
def f_text_and_dates(spark: SparkSession, folder: str) -> DataFrame:
    """Text, pattern and date functions."""
    t = F.col("text")
    n = lambda c: F.count(F.when(c, 1))
    return table(spark, folder, "documents").groupBy("source", "lang").agg(
        F.count("*").alias("documents"), n(t.isNull() | (F.trim(t) == "")).alias("blank"), F.round(F.avg(F.length(t)), 4).alias("mean_length"), F.max("n_chars").alias("longest"),
        n(F.contains(F.lower(t), F.lit("tram"))).alias("trams"), n(t.rlike("[0-9]{4}-[0-9]{2}-[0-9]{2}")).alias("dated"), F.count_distinct(F.upper("network")).alias("networks"),
        F.min(F.year("published_at")).alias("first_year"), F.max(F.datediff(F.to_date("loaded_at"), F.to_date("published_at"))).alias("longest_lag"),
    )


@query("select event_id, (props::json->>'k')::int as k, case event_type when 'view' then 1 when 'click' then 2 when 'purchase' then 9 else 0 end::int as code, round(pow(value, 0.5), 6) as root, floor(value)::bigint as whole, round(value / nullif(value - floor(value), 0), 4) as ratio, greatest(value, 10.0) as at_least, isodow(ts)::int as weekday, dayofweek(ts)::int as sunday_first, hour(ts)::int as hour from events")
def f_scalars(spark: SparkSession, folder: str) -> DataFrame:
    """JSON fields, code maps, powers, safe division and calendar parts."""
    v = F.col("value")
    return table(spark, folder, "events").select(
        "event_id", F.get_json_object("props", "$.k").try_cast("int").alias("k"), code_map(F.col("event_type"), {"view": 1, "click": 2, "purchase": 9}, 0).alias("code"), F.round(F.pow(v, F.lit(0.5)), 6).alias("root"), F.floor(v).alias("whole"),
        F.round(safe_div(v, v - F.floor(v)), 4).alias("ratio"), F.greatest(v, F.lit(10.0)).alias("at_least"), (F.weekday("ts") + 1).cast("int").alias("weekday"), (F.dayofweek("ts") - 1).alias("sunday_first"), F.hour("ts").alias("hour"),
    )


@query("select day_id, len(non_walk_modes)::int as n, non_walk_modes[1] as first_mode, list_contains(non_walk_modes, 'cycle') as cycles, array_to_string(list_filter(non_walk_modes, lambda x: starts_with(x, 'car')), '+') as cars, len(range(0, trips_per_day))::int as series, nullif(typejour, 2) is null as is_two, coalesce(age_band, '?') as band, pond_ind is distinct from pond_jour as differs from day_summary where non_walk_modes is not null")
def f_lists_and_nulls(spark: SparkSession, folder: str) -> DataFrame:
    """List functions, null handling and IS DISTINCT FROM."""
    m = F.col("non_walk_modes")
    return table(spark, folder, "day_summary").where(m.isNotNull()).select(
        "day_id", F.size(m).alias("n"), F.try_element_at(m, F.lit(1)).alias("first_mode"), F.array_contains(m, "cycle").alias("cycles"), F.array_join(F.filter(m, lambda x: F.startswith(x, F.lit("car"))), "+").alias("cars"),
        F.size(F.sequence(F.lit(1).cast("long"), F.col("trips_per_day"))).alias("series"), F.nullif("typejour", F.lit(2.0)).isNull().alias("is_two"), F.coalesce("age_band", F.lit("?")).alias("band"), (~F.col("pond_ind").eqNullSafe(F.col("pond_jour"))).alias("differs"),
    )


@query(f"with {TRIPS}, h as (select survey, hh, {drawn_below_sql('hh', 0.3)} as kept from trips where hh is not null) select survey, count(*) as trips, count(*) filter (where kept) as kept_trips, count(distinct hh) as households, count(distinct hh) filter (where kept) as kept_households from h group by 1")
def f_household_sample(spark: SparkSession, folder: str) -> DataFrame:
    """A stable sample of whole households by hash, which is the feature: kept trips and households per survey."""
    t = trips(spark, folder).where("hh is not null")
    kept = drawn_below("hh", 0.3)
    return t.groupBy("survey").agg(F.count("*").alias("trips"), F.count(F.when(kept, 1)).alias("kept_trips"), F.count_distinct("hh").alias("households"), F.count_distinct(F.when(kept, F.col("hh"))).alias("kept_households"))
