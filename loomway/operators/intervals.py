"""Overlapping and gapped intervals: continuous periods and the gaps between them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomway.functions.exprs import clock_minutes

DAY_START_MIN = 4 * 60


def survey_minutes(departure: Column, arrival: Column) -> tuple[Column, Column]:
    """Start and end in minutes from 04:00; an arrival that counts less than its departure is a day later."""
    s = F.pmod(clock_minutes(departure) - DAY_START_MIN, F.lit(1440))
    e = F.pmod(clock_minutes(arrival) - DAY_START_MIN, F.lit(1440))
    return s, F.when(e < s, e + 1440).otherwise(e)


def _islands(df: DataFrame, keys: list[str]) -> DataFrame:
    """Closed intervals (s, e) of each key, merged where they overlap or share an end point."""
    w = W.partitionBy(*keys).orderBy("s", "e")
    reach = F.max("e").over(w.rowsBetween(W.unboundedPreceding, -1))
    return (
        df.withColumn("_new", F.when(reach >= F.col("s"), 0).otherwise(1))
        .withColumn("_island", F.sum("_new").over(w.rowsBetween(W.unboundedPreceding, 0)))
        .groupBy(*keys, "_island")
        .agg(F.min("s").alias("s"), F.max("e").alias("e"))
        .drop("_island")
    )


def periods_and_gaps(df: DataFrame, entity: str, start: str, end: str, shard_width: int) -> DataFrame:
    """Merged periods of each entity and the gaps between them: (entity, kind, start, end).

    Two levels: intervals are clipped to shards of the axis and merged within
    (entity, shard); then only pieces that touch a shard's border are stitched,
    and only each shard's first and last piece are compared for the gaps between
    shards: at most four for each shard of an entity. No task holds all
    intervals of an entity. Equal starts are pre-aggregated, so repeated rows
    change nothing.

    Rows with a null entity, start or end, or with end before start, are left
    out. Intervals are closed: sharing an end point is one period, and one of
    zero length is a period too. Extra columns are ignored.
    """
    width = F.lit(shard_width)
    lo, hi = F.floor(F.col("s") / width), F.floor(F.col("e") / width)
    pieces = (
        df.select(F.col(entity).alias("k"), F.col(start).cast("long").alias("s"), F.col(end).cast("long").alias("e"))
        .where("k is not null and s <= e")
        .groupBy("k", "s")
        .agg(F.max("e").alias("e"))
        .withColumn("shard", F.explode(F.sequence(lo, hi)))
        .select("k", "shard", F.greatest("s", F.col("shard") * width).alias("s"), F.least("e", (F.col("shard") + 1) * width).alias("e"))
    )
    order = W.partitionBy("k", "shard").orderBy("s")
    local = _islands(pieces, ["k", "shard"]).withColumns({"prev": F.lag("e").over(order), "next": F.lead("s").over(order)})
    left, right = F.col("shard") * width, (F.col("shard") + 1) * width
    inner = (F.col("s") > left) & (F.col("e") < right)
    row = lambda kind, s, e: F.struct(F.lit(kind).alias("kind"), s.alias("s"), e.alias("e"))
    some = lambda *rows: F.explode(F.filter(F.array(*rows), lambda r: r.isNotNull())).alias("r")
    s, e, prev = F.col("s"), F.col("e"), F.col("prev")
    within = local.select("k", some(F.when(inner, row("period", s, e)), F.when(prev < s, row("gap", prev, s))))
    # Pieces that touch a border, and each shard's first and last: in their order a piece follows the last one of an earlier shard.
    across = W.partitionBy("k").orderBy("s", "shard", "e")
    edge = local.where(~inner | prev.isNull() | F.col("next").isNull()).select("k", "shard", "s", "e", (~inner).alias("touches"), F.lag("e").over(across).alias("prev"), F.lag("shard").over(across).alias("before"))
    edge = edge.withColumn("new", F.when(prev == s, 0).otherwise(1)).withColumn("island", F.sum("new").over(across.rowsBetween(W.unboundedPreceding, 0)))
    until = F.max("e").over(W.partitionBy("k", "island"))
    stitched = edge.withColumn("until", until).select("k", some(F.when(F.col("touches") & (F.col("new") == 1), row("period", s, F.col("until"))), F.when((F.col("before") != F.col("shard")) & (prev < s), row("gap", prev, s))))
    return within.unionByName(stitched).select(F.col("k").alias(entity), F.col("r.kind").alias("kind"), F.col("r.s").alias(start), F.col("r.e").alias(end))
