"""Household bootstrap as relations: draws, replicates, intervals, verdicts."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomway.operators.prefix import prefix_sums

#: Households of a stratum at most.
STRATUM = 1_000
# The draw of slot i in replicate r: two linear congruences multiplied, so that equal slots of different replicates differ (fixed values).
_M, _K = 2_147_483_647, 46_337


def drawn_index(i, r, n):
    """Which of n households slot i of replicate r draws: the same arithmetic for columns, arrays and SQL."""
    return ((((i * 48_271 + r * 69_621 + 11) % _M) * ((i * 16_807 + r * 40_692 + 7) % _K)) % _M) % n


@lru_cache(maxsize=64)
def stratum_draws(low: int, n: int, reps: int, offset: int) -> np.ndarray:
    """How often each of a stratum's n households (rows) is drawn in each replicate (columns); its first slot is `low`."""
    i, r = np.arange(low, low + n)[:, None], np.arange(reps)[None, :]
    cell = drawn_index(i, r + offset, n) * reps + r
    return np.bincount(cell.ravel(), minlength=n * reps).reshape(n, reps).astype("<u2")


def draws(roster: DataFrame, household: str, reps: int, by: str | None = None, offsets: dict[str, int] | None = None) -> DataFrame:
    """([by,] household, mult): how often each household is drawn, one 16-bit number a replicate in one binary value.

    The roster's households, in the order of their key's MD5, are cut into
    strata of at most STRATUM households, equal to one. Each stratum draws as
    many with replacement as it has, so a roster up to STRATUM is resampled as a
    whole and a larger one in random strata, whose intervals are the same but
    for a thousandth of the variance. A household's numbers need its own stratum
    only: there is no row for each household and replicate.

    Deterministic arithmetic instead of a random generator, so that a replicate
    can be computed again anywhere. `by` keeps several samples apart, each with
    its own draws by its place in `offsets`.
    """
    keys = [by] if by else []
    hh = roster.select(*keys, household).where(F.col(household).isNotNull()).distinct().withColumns({"_md5": F.md5(F.col(household).cast("string")), "_one": F.lit(1)})
    index = prefix_sums(hh, keys, ["_md5", household], ["_one"])
    offset = F.coalesce(*(F.when(F.col(by) == k, F.lit(v)) for k, v in offsets.items()), F.lit(0)) if by and offsets else F.lit(0)
    n, at = F.col("total__one"), F.col("below__one")
    strata = F.ceil(n / STRATUM)
    index = index.withColumns({"_n": n, "_k": strata, "_st": F.floor(at * strata / n), "_at": at, "_offset": offset})
    rows = index.select(*keys, household, "_n", "_k", "_st", "_at", "_offset").sortWithinPartitions(*keys, "_at")
    names = [*keys, household]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            mult = np.empty(len(pdf), object)
            cols = [pdf[c].to_numpy(np.int64) for c in ("_n", "_k", "_st", "_at", "_offset")]
            for j, (n, k, st, at, o) in enumerate(zip(*(c.tolist() for c in cols))):
                low, high = -(-st * n // k), -(-(st + 1) * n // k)
                mult[j] = stratum_draws(low, high - low, reps, o)[at - low].tobytes()
            yield pdf[names].assign(mult=mult)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*names).schema)
    return rows.mapInPandas(run, f"{schema}, mult binary")


def long_draws(drawn: DataFrame, reps: int) -> DataFrame:
    """One row for each household and replicate in which it is drawn: (..., rep, mult)."""
    names = [c for c in drawn.columns if c != "mult"]
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in drawn.drop("mult").schema)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            m = np.frombuffer(b"".join(pdf["mult"]), "<u2").reshape(len(pdf), reps)
            i, r = np.nonzero(m)
            yield pdf[names].iloc[i].assign(rep=r.astype(np.int64), mult=m[i, r].astype(np.int64))

    return drawn.mapInPandas(run, f"{fields}, rep long, mult long")


def replicates(rows: DataFrame, keys: Sequence[str], household: str | Sequence[str], sums: dict[str, Column], drawn: DataFrame, reps: int) -> DataFrame:
    """(keys, rep, each sum): weighted by the draws; rows are summed to households before they meet the replicates.

    Households outside the roster are an error; those of the roster without rows
    count as nothing, and so does a null sum. Each batch of households is
    multiplied with its draws as matrices, and Spark adds the batches' sums.
    """
    on = [household] if isinstance(household, str) else list(household)
    keys, names = list(keys), list(sums)
    per = rows.groupBy(*dict.fromkeys([*keys, *on])).agg(*(F.coalesce(F.sum(c).cast("double"), F.lit(0.0)).alias(a) for a, c in sums.items()))
    met = per.join(drawn, on, "left").withColumn("mult", F.when(F.col("mult").isNull(), F.raise_error(F.lit("rows of households outside the roster"))).otherwise(F.col("mult")))
    schema = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in per.select(*keys).schema) + "rep long, " + ", ".join(f"`{a}` double" for a in names)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if not len(pdf):
                continue
            m = np.frombuffer(b"".join(pdf["mult"]), "<u2").reshape(len(pdf), reps).astype(np.float64)
            a = pdf[names].to_numpy(np.float64)
            code = pdf.groupby(keys, dropna=False, sort=False).ngroup().to_numpy() if keys else np.zeros(len(pdf), np.int64)
            order = np.argsort(code, kind="stable")
            first = np.flatnonzero(np.diff(code[order], prepend=-1))
            out = np.concatenate([m[o].T @ a[o] for o in np.split(order, first[1:])])
            one = pdf[keys].iloc[np.repeat(order[first], reps)].reset_index(drop=True)
            yield pd.concat([one.assign(rep=np.tile(np.arange(reps), len(first))), pd.DataFrame(out, columns=names)], axis=1)

    parts = met.select(*keys, *names, "mult").mapInPandas(run, schema)
    return parts.groupBy(*keys, "rep").agg(*(F.sum(a).alias(a) for a in names))


def interval(reps: DataFrame, keys: Sequence[str], estimate: Column, level: float, total_reps: int, min_valid: float = 0.95) -> DataFrame:
    """(keys, low, high, valid): percentile interval, null where too few replicates give an estimate."""
    a = (1 - level) / 2
    e = reps.withColumn("_e", estimate)
    q = e.groupBy(*keys).agg(F.expr(f"percentile(_e, array({a}, {1 - a}))").alias("q"), F.count("_e").alias("valid"))
    ok = F.col("valid") >= min_valid * total_reps
    return q.select(*keys, F.when(ok, F.col("q")[0]).alias("low"), F.when(ok, F.col("q")[1]).alias("high"), "valid")


def verdict(low: Column, high: Column, margin: float, neutral: float = 1.0) -> Column:
    """equivalent, different or inconclusive, from an interval against a margin around the neutral value."""
    lo, hi = neutral / (1 + margin), neutral * (1 + margin)
    return F.when(low.isNull() | high.isNull(), F.lit(None).cast("string")).when((low >= lo) & (high <= hi), "equivalent").when((low > neutral) | (high < neutral), "different").otherwise("inconclusive")


def suppressed(value: Column, n: Column, least: int = 50) -> Column:
    """The value where the cell has enough rows; the count itself stays."""
    return F.when(n >= least, value)
