"""Small relational helpers that SQL lacks or that need care at scale."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """The first row of each key: `order` must be total within a key."""
    w = W.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def keep_best(df: DataFrame, keys: Sequence[str], score: Column) -> DataFrame:
    """All rows that tie at their key's best score; rows without a score go."""
    scored = df.withColumn("_score", score)
    return scored.withColumn("_best", F.max("_score").over(W.partitionBy(*keys))).where("_score = _best").drop("_score", "_best")


def band_join(left: DataFrame, right: DataFrame, left_x: str, lo: str, hi: str, width: float, on: Sequence[str] = ()) -> DataFrame:
    """Rows with lo <= x <= hi (and equal `on` keys), by buckets of x instead of a nested loop.

    The right side is copied to each bucket its interval covers, so `width`
    should be near the usual interval length. Rows with a null bound or value
    match nothing.
    """
    bucket = lambda c: F.floor(F.col(c) / F.lit(width)).cast("long")
    a = left.withColumn("_b", bucket(left_x))
    b = right.where(F.col(lo) <= F.col(hi)).withColumn("_b", F.explode(F.sequence(bucket(lo), bucket(hi))))
    return a.join(b, ["_b", *on]).where((F.col(left_x) >= F.col(lo)) & (F.col(left_x) <= F.col(hi))).drop("_b")


def repeated_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that occur more than once or hold a null, with their number of rows: empty where a key is one."""
    nulls = F.lit(False)
    for k in keys:
        nulls = nulls | F.col(k).isNull()
    return df.groupBy(*keys).agg(F.count("*").alias("rows")).where((F.col("rows") > 1) | nulls)


def require_empty(df: DataFrame, message: str) -> None:
    """Raises if there is any row."""
    if df.limit(1).count():
        raise ValueError(message)


def sum_if_complete(c: Column) -> Column:
    """Sum that is null when any input is null."""
    return F.when(F.count(c) == F.count("*"), F.sum(c))


def share_of_total(c: Column) -> Column:
    """A group's part of the grand total, to be used in an aggregate's output."""
    return F.try_divide(c, F.sum(c).over(W.partitionBy()))
