"""Weighted statistics per group: quantiles, moments, trimmed means, distributions and their distance."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomway.functions.exprs import finite, safe_div
from loomway.operators.prefix import prefix_sums


def support(df: DataFrame, groups: Sequence[str], value: str, weight: str) -> DataFrame:
    """(groups, v, w): summed weights of each finite value; weights must be finite and positive to count."""
    v, w = F.col(value).cast("double"), F.col(weight).cast("double")
    return df.where(finite(v) & finite(w) & (w > 0)).select(*groups, v.alias("v"), w.alias("w")).groupBy(*groups, "v").agg(F.sum("w").alias("w"))


def running(df: DataFrame, groups: Sequence[str], value: str, weight: str) -> DataFrame:
    """Support with below, upto and total weight of each value."""
    rows = prefix_sums(support(df, groups, value, weight), groups, ["v"], ["w"])
    return rows.select(*groups, "v", "w", F.col("below_w").alias("below"), (F.col("below_w") + F.col("w")).alias("upto"), F.col("total_w").alias("total"))


def _with(rows: DataFrame, probabilities: Sequence[float]) -> DataFrame:
    return rows.withColumn("p", F.explode(F.array(*(F.lit(float(p)) for p in probabilities))))


def quantiles_step(run: DataFrame, groups: Sequence[str], probabilities: Sequence[float]) -> DataFrame:
    """(groups, p, value): the first value whose cumulative weight reaches p of the total, the last one at most."""
    reach = F.min(F.when(F.col("upto") >= F.col("p") * F.col("total"), F.col("v")))
    return _with(run, probabilities).groupBy(*groups, "p").agg(F.coalesce(reach, F.max("v")).alias("value"))


def quantiles_interpolated(run: DataFrame, groups: Sequence[str], probabilities: Sequence[float]) -> DataFrame:
    """(groups, p, value): linear interpolation of values over their cumulative shares, flat beyond the ends."""
    c, v, p = F.col("upto") / F.col("total"), F.col("v"), F.col("p")
    rows = _with(run, probabilities).withColumn("c", c)
    agg = rows.groupBy(*groups, "p").agg(
        F.max(F.when(F.col("c") <= p, F.col("c"))).alias("c0"), F.max(F.when(F.col("c") <= p, v)).alias("v0"),
        F.min(F.when(F.col("c") >= p, F.col("c"))).alias("c1"), F.min(F.when(F.col("c") >= p, v)).alias("v1"),
    )
    between = F.col("v0") + (F.col("p") - F.col("c0")) / (F.col("c1") - F.col("c0")) * (F.col("v1") - F.col("v0"))
    value = F.when(F.col("v0").isNull(), F.col("v1")).when(F.col("v1").isNull() | (F.col("c0") == F.col("c1")), F.col("v0")).otherwise(between)
    return agg.select(*groups, "p", value.alias("value"))


def trimmed_mean(run: DataFrame, groups: Sequence[str], top_share: float) -> DataFrame:
    """(groups, trimmed): mean without the top share of weight; the value at the border counts in part."""
    keep = F.col("total") * (1 - top_share)
    kept = F.when(F.col("upto") <= keep, F.col("w")).otherwise(F.greatest(F.lit(0.0), keep - F.col("below")))
    return run.groupBy(*groups).agg(safe_div(F.sum(kept * F.col("v")), F.sum(kept)).alias("trimmed"))


def moments(sup: DataFrame, groups: Sequence[str]) -> DataFrame:
    """(groups, weight, effective_n of values, mean, variance): population variance in two passes."""
    means = sup.groupBy(*groups).agg(F.sum("w").alias("weight"), safe_div(F.sum(F.col("w") * F.col("v")), F.sum("w")).alias("mean"))
    s, m = sup.alias("s"), means.alias("m")
    on = [F.col(f"s.{g}").eqNullSafe(F.col(f"m.{g}")) for g in groups] or [F.lit(True)]
    d = F.col("s.v") - F.col("m.mean")
    return s.join(m, on).groupBy(*(F.col(f"m.{g}").alias(g) for g in groups)).agg(F.first("m.weight").alias("weight"), F.first("m.mean").alias("mean"), safe_div(F.sum(F.col("s.w") * d * d), F.first("m.weight")).alias("variance"))


def gamma_fit(mean: Column, variance: Column) -> tuple[Column, Column]:
    """(shape, scale) by moments; null where the variance is zero."""
    return safe_div(mean * mean, variance), F.when(variance > 0, safe_div(variance, mean))


def silverman(variance: Column, weight_sum: Column, weight_squares: Column) -> Column:
    """Rule-of-thumb bandwidth with the effective number of observations."""
    return 0.9 * F.sqrt(variance) * F.pow(weight_sum * weight_sum / weight_squares, F.lit(-0.2))


def kde(sup: DataFrame, groups: Sequence[str], bandwidth: Column, grid: Sequence[float]) -> DataFrame:
    """(groups, point, density): Gaussian kernel density on a grid, from one row per distinct value."""
    z = (F.col("point") - F.col("v")) / bandwidth
    kernel = F.exp(-0.5 * z * z) / math.sqrt(2 * math.pi)
    rows = sup.withColumn("point", F.explode(F.array(*(F.lit(float(x)) for x in grid))))
    return rows.groupBy(*groups, "point").agg((F.sum(kernel * F.col("w") / bandwidth) / F.sum("w")).alias("density"))


def ecdf(sup: DataFrame, groups: Sequence[str], step: float, last: float) -> DataFrame:
    """(groups, point, share): weight at or below each grid point from 0; values are put to their grid point before the shuffle."""
    n = int(last / step)
    i = F.greatest(F.lit(0), F.ceil(F.col("v") / step)).cast("int")
    cells = sup.withColumn("i", F.least(i, F.lit(n + 1))).groupBy(*groups, "i").agg(F.sum("w").alias("w"))
    per = cells.groupBy(*groups).agg(F.sum("w").alias("total"), F.array_sort(F.collect_list(F.struct("i", "w"))).alias("cells"))
    # A group has at most one cell for each grid point.
    rows = per.withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(n))))
    upto = F.aggregate(F.filter("cells", lambda x: x["i"] <= F.col("j")), F.lit(0.0), lambda a, x: a + x["w"])
    return rows.select(*groups, (F.col("j") * step).cast("double").alias("point"), (upto / F.col("total")).alias("share"))


def ks_distance(df: DataFrame, groups: Sequence[str], value: str, weight: str, first: Column) -> DataFrame:
    """(groups, ks): greatest gap of the weighted distributions of the rows where `first` holds and the others."""
    w = F.col(weight)
    both = df.where(finite(F.col(value)) & finite(w) & (w > 0)).groupBy(*groups, F.col(value).cast("double").alias("v")).agg(F.sum(F.when(first, w).otherwise(0.0)).alias("a"), F.sum(F.when(first, 0.0).otherwise(w)).alias("b"))
    run = prefix_sums(both, groups, ["v"], ["a", "b"])
    gap = F.abs(safe_div(F.col("below_a") + F.col("a"), F.col("total_a")) - safe_div(F.col("below_b") + F.col("b"), F.col("total_b")))
    return run.groupBy(*groups).agg(F.max(gap).alias("ks"))


def weighted_classes(df: DataFrame, id_col: str, value: str, weight: str, classes: int = 5, tie: Column | None = None) -> DataFrame:
    """(id, class): classes of equal weight, from 1; ties of the value are broken by `tie` (a seeded hash of the id), then the id.

    A row is in the class in which its cumulative weight ends. Rows without a
    value or a positive weight are in class 0.
    """
    ok = finite(F.col(value)) & finite(F.col(weight)) & (F.col(weight) > 0)
    order = tie if tie is not None else F.xxhash64(F.lit(42), F.col(id_col))
    rows = df.where(ok).select(F.col(id_col).alias("_id"), F.col(value).cast("double").alias("_v"), order.alias("_t"), F.col(weight).cast("double").alias("_w"))
    run = prefix_sums(rows, [], ["_v", "_t", "_id"], ["_w"])
    share = F.try_divide(F.col("below__w") + F.col("_w"), F.col("total__w"))
    known = run.select(F.col("_id").alias(id_col), F.greatest(F.lit(1), F.least(F.lit(classes), F.ceil(F.round(share * classes, 9)))).cast("int").alias("class"))
    return known.unionByName(df.where(~F.coalesce(ok, F.lit(False))).select(id_col, F.lit(0).alias("class")))
