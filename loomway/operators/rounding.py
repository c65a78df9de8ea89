"""Rounding of declared durations: its level, and a simulation that coarsens a sample to another one's shares."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomway.functions.exprs import safe_div

VARIANTS = ("nearest", "up", "nearest_min5")
LEAST_MIN = 5.0


def rounding_level(d: Column, levels: Sequence[int]) -> Column:
    """The largest of the levels that divides a duration, the first where none does; zero has the largest."""
    return F.coalesce(*(F.when(d % k == 0, F.lit(k)) for k in reversed(levels[1:])), F.lit(levels[0]))


def rounded(d: Column, level: int, variant: str) -> Column:
    """A duration as a multiple of the level: the nearest one, halves going up, the next one, or the nearest one of at least five minutes."""
    if variant not in VARIANTS:
        raise ValueError(f"unknown variant: {variant}")
    steps = F.ceil(d / level) if variant == "up" else F.floor(d / level + 0.5)
    out = (steps * level).cast("double")
    return F.greatest(out, F.lit(LEAST_MIN)) if variant == "nearest_min5" else out


def level_shares(rows: DataFrame, levels: Sequence[int]) -> DataFrame:
    """(cell, target_<level>...): weighted share of durations of each level or a coarser one, from (cell, d, w)."""
    lv = rounding_level(F.col("d"), levels)
    return rows.groupBy("cell").agg(*(safe_div(F.coalesce(F.sum(F.when(lv >= k, F.col("w"))), F.lit(0.0)), F.sum("w")).alias(f"target_{k}") for k in levels[1:]))


def coarsened(rows: DataFrame, targets: DataFrame, levels: Sequence[int], variant: str = "nearest") -> DataFrame:
    """(cell, key, w, d, after) of (cell, key, w, d): durations after one draw that brings each cell to its target shares.

    Level by level, finer durations are rounded with the probability that fills
    the gap to the target; coarser ones are never refined. Cells without a
    target stay. The draw comes from the MD5 of key and level, so it can be
    repeated anywhere. Cells are few: each level is one small aggregate, joined back.
    """
    rows = rows.join(F.broadcast(targets), "cell", "left").withColumn("after", F.col("d"))
    for k in levels[1:]:
        now, w, target = rounding_level(F.col("after"), levels), F.col("w"), F.col(f"target_{k}")
        to = rounded(F.col("after"), k, variant)
        can = (now < k) & (rounding_level(to, levels) >= k)
        sums = rows.groupBy("cell").agg(F.sum(w).alias("_all"), F.coalesce(F.sum(F.when(now >= k, w)), F.lit(0.0)).alias("_now"), F.coalesce(F.sum(F.when(can, w)), F.lit(0.0)).alias("_can"))
        gap = target - safe_div(F.col("_now"), F.col("_all"))
        p = F.when((gap > 0) & (F.col("_can") > 0), gap / safe_div(F.col("_can"), F.col("_all")))
        u = F.conv(F.substring(F.md5(F.concat(F.col("key"), F.lit(f":{k}"))), 1, 8), 16, 10).cast("double") / 2**32
        drawn = F.coalesce(can & (u < p), F.lit(False))
        rows = rows.join(F.broadcast(sums), "cell").withColumn("after", F.when(drawn, to).otherwise(F.col("after"))).drop("_all", "_now", "_can")
    return rows.select("cell", "key", "w", "d", "after")
