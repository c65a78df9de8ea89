"""Exact percentiles per group by a distributed sort with counts per partition."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomway.functions.exprs import finite
from loomway.session import cut


def value_counts(df: DataFrame, groups: Sequence[str], value: str, piece: str | None = None) -> DataFrame:
    """The piece that can be combined: how often each finite value occurs, per group (and per `piece`).

    Null, NaN and infinite values are left out; a null group is a group.
    """
    v = F.col(value).cast("double")
    keys = [*([piece] if piece else []), *groups]
    return df.where(finite(v)).select(*keys, v.alias("v")).groupBy(*keys, "v").agg(F.count("*").alias("c"))


def merge_counts(pieces: DataFrame, groups: Sequence[str]) -> DataFrame:
    """Pieces of any partitions or days combined into one."""
    return pieces.groupBy(*groups, "v").agg(F.sum("c").alias("c"))


def percentiles_from_counts(counts: DataFrame, groups: Sequence[str], probabilities: Sequence[float], partitions: int | None = None) -> DataFrame:
    """(groups, p, value, n): each percentile interpolated between its neighbouring order statistics, without error.

    The counts are range-partitioned and sorted by (group, value); rows per
    partition and group give each partition's offset; a target position then
    lies in one partition only, where a running count finds it. A group larger
    than a partition spreads over several. Groups with no finite value give no
    row; one value gives that value for every p.
    """
    g = list(groups)
    spark = counts.sparkSession
    parts = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = counts.select(*g, "v", "c").repartitionByRange(parts, *g, "v").withColumn("part", F.spark_partition_id())
    # The bounds of a range partitioning are sampled anew with each run: keep the rows of one run.
    ordered = cut(ordered)
    same = lambda a, b: [F.col(f"{a}.{x}").eqNullSafe(F.col(f"{b}.{x}")) for x in g]
    per = ordered.groupBy(*g, "part").agg(F.sum("c").alias("rows"))
    before = F.sum("rows").over(W.partitionBy(*g).orderBy("part").rowsBetween(W.unboundedPreceding, 0)) - F.col("rows")
    offsets = per.withColumn("offset", before).withColumn("n", F.sum("rows").over(W.partitionBy(*g)))
    targets = (
        offsets.withColumn("p", F.explode(F.array(*(F.lit(float(p)) for p in probabilities))))
        .withColumn("at", F.col("p") * (F.col("n") - 1))
        .withColumn("k", F.explode(F.array_distinct(F.array(F.floor("at"), F.ceil("at")))))
        .where((F.col("k") >= F.col("offset")) & (F.col("k") < F.col("offset") + F.col("rows")))
        .select(*g, "part", "p", "n", "at", "k", (F.col("k") - F.col("offset")).alias("local"))
    )
    upto = F.sum("c").over(W.partitionBy(*g, "part").orderBy("v").rowsBetween(W.unboundedPreceding, 0))
    running = ordered.withColumn("upto", upto).withColumn("above", F.col("upto") - F.col("c"))
    t, r = targets.alias("t"), running.alias("r")
    cond = [F.col("t.part") == F.col("r.part"), *same("t", "r"), F.col("t.local") >= F.col("r.above"), F.col("t.local") < F.col("r.upto")]
    hits = t.join(r, on=cond).select(*(F.col(f"t.{x}").alias(x) for x in g), "t.p", "t.n", "t.at", "t.k", "r.v")
    low, high = F.min_by("v", "k"), F.max_by("v", "k")
    frac = F.first("at") - F.floor(F.first("at"))
    return hits.groupBy(*g, "p").agg((low + (high - low) * frac).alias("value"), F.first("n").alias("n"))


def percentiles(df: DataFrame, groups: Sequence[str], value: str, probabilities: Sequence[float]) -> DataFrame:
    """Exact percentiles of `value` per group, straight from rows."""
    return percentiles_from_counts(value_counts(df, groups, value), groups, probabilities)
