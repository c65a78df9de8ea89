"""References to records that do not exist."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomway.functions.exprs import MAX_LONG, MIN_LONG, micros, norm_key
from loomway.operators.prefix import prefix_sums
from loomway.operators.rangeprobe import stream_probe

#: Ranges of keys at least, however few the parents are.
MIN_RANGES = 8
#: Versions of a key are cut into time ranges where there are more of them than a range should hold.
_LOW, _WIDTH = -(2.0**63), 2.0**64


def _hashes(key):
    return F.xxhash64(key).alias("h"), F.xxhash64(F.lit(7), key).alias("h2")


def range_of(h: Column, ranges: int) -> Column:
    """The range of a key's hash: `ranges` equal parts of the 64-bit line, in which hashes lie evenly."""
    return F.least(F.floor((h.cast("double") - F.lit(_LOW)) * F.lit(ranges / _WIDTH)), F.lit(ranges - 1)).cast("int")


def _last_at_or_below(starts: Column, t: Column, steps: int) -> Column:
    """Place, from 0, of the last element of the sorted array that is at or below t; 0 also where none is."""
    halve = lambda z, _: F.when(z["lo"] >= z["hi"], z).otherwise(F.when(F.element_at(starts, (F.floor((z["lo"] + z["hi"] + 1) / 2) + 1).cast("int")) <= t, F.struct(F.floor((z["lo"] + z["hi"] + 1) / 2).cast("int").alias("lo"), z["hi"].alias("hi"))).otherwise(F.struct(z["lo"].alias("lo"), (F.floor((z["lo"] + z["hi"] + 1) / 2) - 1).cast("int").alias("hi"))))
    start = F.struct(F.lit(0).alias("lo"), (F.size(starts) - 1).alias("hi"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, halve, lambda z: z["lo"])


class SortedParents:
    """Parents of one range in sorted arrays, with the running maximum of their ends within a key."""

    def __init__(self, h: np.ndarray, h2: np.ndarray, s: np.ndarray, e: np.ndarray):
        order = np.lexsort((s, h2, h))
        h, h2, s, e = h[order], h2[order], s[order], e[order]
        n = len(h)
        new = np.ones(n, bool)
        new[1:] = (h[1:] != h[:-1]) | (h2[1:] != h2[:-1])
        group = np.cumsum(new) - 1
        self.h, self.h2 = h[new], h2[new]
        self.times = np.unique(s)
        self.step = len(self.times) + 1
        self.code = group * self.step + np.searchsorted(self.times, s, "left") + 1
        rank = np.unique(e, return_inverse=True)
        #: Within a key the rank of the end never falls: offsets by key make one running maximum do for all.
        self.end = rank[0][np.maximum.accumulate(rank[1] + group * (len(rank[0]) + 1)) - group * (len(rank[0]) + 1)] if n else e
        self.group = group
        same = np.diff(np.flatnonzero(np.r_[True, self.h[1:] != self.h[:-1], True])) if len(self.h) else np.array([1])
        self.most = int(same.max(initial=1))

    def reasons(self, h: np.ndarray, h2: np.ndarray, t: np.ndarray) -> np.ndarray:
        """0 found, 1 missing, 2 deleted, 3 late."""
        key = np.full(len(h), -1, np.int64)
        first = np.searchsorted(self.h, h, "left")
        for j in range(self.most):
            at = np.minimum(first + j, max(0, len(self.h) - 1))
            if len(self.h):
                hit = (first + j < len(self.h)) & (self.h[at] == h) & (self.h2[at] == h2)
                key[hit] = at[hit]
        out = np.ones(len(h), np.int8)
        known = key >= 0
        if known.any():
            k, tk = key[known], t[known]
            pos = np.searchsorted(self.code, k * self.step + np.searchsorted(self.times, tk, "right"), "right") - 1
            loaded = (pos >= 0) & (self.group[np.maximum(pos, 0)] == k) & (tk != MIN_LONG)
            alive = loaded & (self.end[np.maximum(pos, 0)] > tk)
            out[known] = np.where(alive, 0, np.where(loaded, 2, 3))
        return out


def orphans(
    children: DataFrame,
    parents: DataFrame,
    child_key: str,
    parent_key: str,
    child_table: str,
    rec_id: str = "rec_id",
    child_time: str = "loaded_at",
    parent_time: str = "loaded_at",
    parent_end: str = "deleted_at",
    rows_per_range: int = 100_000,
    rows_per_split: int = 200_000,
) -> DataFrame:
    """Child rows whose key no parent row has at the child's time: (child_table, period, rec_id, reason).

    Parents are range-partitioned by the hash of their key, at any size, and
    kept as sorted arrays per range, built once where the range's child rows are
    probed in batches by binary search. A parent key with more than
    `rows_per_range` versions spreads over ranges of time (what earlier and
    later ranges hold of it is carried along), a range with many child rows over
    several splits. Keys are compared as two 64-bit hashes of the normalised text.

    Two aggregates run when the plan is made: the parents and the versions of
    the commonest key (one row), and the number of child rows (footers only).

    Null and blank keys are no case. A child without a time comes before every
    parent (reason missing or late, period null). A parent without a time counts
    as known but never loaded; one without an end was never withdrawn. With no
    parents at all every keyed child is missing. Repeated rows each count.
    """
    k = norm_key(F.col(parent_key))
    stored = (
        parents.select(k.alias("k"), F.coalesce(micros(F.col(parent_time)), F.lit(MAX_LONG)).alias("s"), F.coalesce(micros(F.col(parent_end)), F.lit(MAX_LONG)).alias("e"))
        .where("k is not null")
        .select(*_hashes(F.col("k")), "s", "e")
    )
    par = stored.groupBy("h", "h2", "s").agg(F.max("e").alias("e"))
    c = norm_key(F.col(child_key))
    kids = (
        children.select(c.alias("k"), F.coalesce(micros(F.col(child_time)), F.lit(MIN_LONG)).alias("t"), F.coalesce(F.col(rec_id).cast("long"), F.lit(MIN_LONG)).alias("rec_id"))
        .where("k is not null")
        .select(*_hashes(F.col("k")), "t", "rec_id")
    )
    size = stored.groupBy("h", "h2").agg(F.count("*").alias("c")).agg(F.sum("c").alias("n"), F.max("c").alias("most")).first()
    ranges = max(MIN_RANGES, math.ceil((size["n"] or 0) / rows_per_range))
    tasks = ranges + math.ceil(children.count() / rows_per_split)
    par, kids = (x.withColumn("r", range_of(F.col("h"), ranges)) for x in (par, kids))
    key = ["r"]
    if (size["most"] or 0) > rows_per_range:
        key = ["r", "sub"]
        par, kids = _by_time(par, kids, rows_per_range, size["most"])

    def prepare(b: pd.DataFrame) -> SortedParents:
        return SortedParents(*(b[x].to_numpy(np.int64) for x in ("h", "h2", "t", "e")))

    def probe(p: SortedParents, rows: pd.DataFrame) -> pd.DataFrame:
        h, h2, t = (rows[x].to_numpy(np.int64) for x in ("h", "h2", "t"))
        code = p.reasons(h, h2, t)
        m = code > 0
        return pd.DataFrame({"t": t[m], "rec_id": rows["rec_id"][m], "code": code[m].astype(np.int32)})

    # Without a single parent there are no build rows, and every probe row meets an empty frame.
    found = stream_probe(par.select(*key, "h", "h2", F.col("s").alias("t"), "e"), kids, key, F.xxhash64("rec_id", "t"), probe, "t long, rec_id long, code int", rows_per_split, prepare, tasks)
    return found.select(
        F.lit(child_table).alias("child_table"),
        F.when(F.col("t") != MIN_LONG, F.date_format(F.timestamp_micros("t"), "yyyy-MM")).alias("period"),
        F.nullif(F.col("rec_id"), F.lit(MIN_LONG)).alias("rec_id"),
        F.element_at(F.array(F.lit("missing"), F.lit("deleted"), F.lit("late")), F.col("code")).alias("reason"),
    )


def _by_time(par: DataFrame, kids: DataFrame, rows_per_range: int, most: int) -> tuple[DataFrame, DataFrame]:
    """Both sides with `sub`, the time range within a key of very many versions; 0 for all other keys.

    Such keys are at most parents / rows_per_range, and each has an array of the
    first times of its ranges. Versions are numbered by prefix_sums(), so no
    task holds a whole key.
    """
    k = ["h", "h2"]
    hot = par.groupBy(*k).agg(F.count("*").alias("c")).where(F.col("c") > rows_per_range).select(*k)
    numbered = prefix_sums(par.join(hot, k, "left_semi").withColumn("one", F.lit(1)), ["r", *k], ["s"], ["one"])
    numbered = numbered.withColumn("sub", F.floor(F.col("below_one") / rows_per_range).cast("int")).select("r", *k, "s", "e", "sub")
    known = F.col("s") != MAX_LONG
    spans = numbered.groupBy("r", *k, "sub").agg(F.min("s").alias("start"), F.max(F.when(known, F.col("e"))).alias("until"))
    # One row for each range of a hot key.
    earlier, later = W.partitionBy("r", *k).orderBy("sub").rowsBetween(W.unboundedPreceding, -1), W.partitionBy("r", *k)
    spans = spans.withColumn("before", F.max("until").over(earlier)).withColumn("subs", F.count("*").over(later))
    loaded = spans.where("before is not null").select("r", *k, F.lit(MIN_LONG + 1).alias("s"), F.col("before").alias("e"), "sub")
    # A range without an earlier one must know that the key exists at all.
    exists = spans.where("before is null and subs > 1").select("r", *k, F.lit(MAX_LONG).alias("s"), F.lit(MIN_LONG).alias("e"), "sub")
    others = par.join(hot, k, "left_anti").select("r", *k, "s", "e", F.lit(0).alias("sub"))
    starts = spans.groupBy(*k).agg(F.array_sort(F.collect_list("start")).alias("starts"))
    at = _last_at_or_below(F.col("starts"), F.col("t"), most.bit_length() + 1)
    kids = kids.join(starts, k, "left").withColumn("sub", F.when(F.col("starts").isNull(), 0).otherwise(at)).drop("starts")
    return others.unionByName(numbered).unionByName(loaded).unionByName(exists), kids


def orphan_report(found: DataFrame) -> DataFrame:
    """Orphans per table, period and reason: (child_table, period, reason, orphans)."""
    return found.groupBy("child_table", "period", "reason").agg(F.count("*").alias("orphans"))
