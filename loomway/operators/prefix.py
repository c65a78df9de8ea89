"""Running sums over a total order, without a task that holds a whole group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomway.session import cut


def prefix_sums(df: DataFrame, groups: Sequence[str], order: Sequence[str], amounts: Sequence[str], partitions: int | None = None) -> DataFrame:
    """Adds, for each amount, `below_<a>` and `total_<a>`: the group's sum before the row, and its whole sum.

    Rows are range-partitioned by (groups, order); sums per partition give each
    partition's offset within a group, and running sums inside partitions the
    rest. `order` must be total within a group. Null groups are groups; a null
    amount counts as 0.
    """
    g = list(groups)
    parts = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    zero = {a: F.coalesce(F.col(a), F.lit(0)) for a in amounts}
    rows = cut(df.repartitionByRange(parts, *g, *order).withColumn("_part", F.spark_partition_id()))
    per = rows.groupBy(*g, "_part").agg(*(F.sum(zero[a]).alias(f"_s_{a}") for a in amounts))
    upto = W.partitionBy(*g).orderBy("_part").rowsBetween(W.unboundedPreceding, 0)
    per = per.select(*g, "_part", *(x for a in amounts for x in ((F.sum(f"_s_{a}").over(upto) - F.col(f"_s_{a}")).alias(f"_o_{a}"), F.sum(f"_s_{a}").over(W.partitionBy(*g)).alias(f"total_{a}"))))
    inside = W.partitionBy(*g, "_part").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    rows = rows.withColumns({f"_r_{a}": F.sum(zero[a]).over(inside) - zero[a] for a in amounts})
    r, p = rows.alias("r"), per.alias("p")
    on = [F.col("r._part") == F.col("p._part"), *(F.col(f"r.{c}").eqNullSafe(F.col(f"p.{c}")) for c in g)]
    keep = [F.col(f"r.{c}") for c in df.columns]
    return r.join(p, on).select(*keep, *(x for a in amounts for x in ((F.col(f"p._o_{a}") + F.col(f"r._r_{a}")).alias(f"below_{a}"), F.col(f"p.total_{a}"))))


def dense_index(df: DataFrame, order: Sequence[str], name: str) -> DataFrame:
    """Adds a number from 0 in the given total order."""
    return prefix_sums(df.withColumn("_one", F.lit(1)), [], order, ["_one"]).withColumnRenamed("below__one", name).drop("_one", "total__one")
