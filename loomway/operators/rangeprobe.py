"""Probe of large row streams against arrays that are built once per range.

Every range has build rows (sorted arrays) and probe rows. A range with many
probe rows is split, and its build rows go to each split, so that no task
holds more than one range's arrays and streams its probe rows in batches.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def split_counts(probe: DataFrame, key: list[str], rows_per_split: int) -> DataFrame:
    """Per range, the number of splits that keeps each at about `rows_per_split` probe rows."""
    return probe.groupBy(*key).agg(F.ceil(F.count("*") / F.lit(rows_per_split)).cast("int").alias("_splits"))


def _filled(df: DataFrame, other: DataFrame) -> DataFrame:
    lacking = [f for f in other.schema if f.name not in df.columns]
    return df.withColumns({f.name: (F.lit(0) if isinstance(f.dataType, T.NumericType) else F.lit(None)).cast(f.dataType) for f in lacking})


def stream_probe(
    build: DataFrame,
    probe: DataFrame,
    key: list[str],
    salt: Column,
    fn: Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame],
    schema: str,
    rows_per_split: int = 250_000,
    prepare: Callable[[pd.DataFrame], object] | None = None,
    tasks: int | None = None,
) -> DataFrame:
    """Rows of `fn(prepared build rows of a range, a batch of its probe rows)`.

    `salt` spreads the probe rows of one range over its splits. Ranges without
    probe rows cost nothing; probe rows of ranges without build rows get an
    empty build frame. `tasks` is the number of partitions, the session's where
    it isn't given; there should be about as many as ranges and splits.
    """
    counts = split_counts(probe, key, rows_per_split)
    b = build.join(counts, key).withColumn("_split", F.explode(F.sequence(F.lit(0), F.col("_splits") - 1))).drop("_splits")
    p = probe.join(counts, key).withColumn("_split", F.pmod(salt, F.col("_splits")).cast("int")).drop("_splits")
    # Scalars a side lacks are 0, not null: pandas would turn 64-bit integers with nulls into floats.
    b, p = _filled(b, p), _filled(p, b)
    rows = b.withColumn("_kind", F.lit(0)).unionByName(p.withColumn("_kind", F.lit(1)))
    group = [*key, "_split"]
    build_cols = [c for c in build.columns if c not in key]
    probe_cols = [c for c in probe.columns if c not in key]
    names = [f.strip().split()[0] for f in schema.split(",") if f.strip()]
    prep = prepare or (lambda x: x)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, parts, ready = None, [], None
        for pdf in batches:
            if not len(pdf):
                continue
            ids = pdf[group].to_numpy()
            edges = [0, *(np.flatnonzero((ids[1:] != ids[:-1]).any(axis=1)) + 1), len(pdf)]
            for a, z in zip(edges, edges[1:]):
                piece = pdf.iloc[a:z]
                this = tuple(piece[group].iloc[0])
                if this != current:
                    current, parts, ready = this, [], None
                kind = piece["_kind"].to_numpy()
                if (kind == 0).any():
                    parts.append(piece.loc[kind == 0, build_cols])
                    ready = None
                if (kind == 1).any():
                    if ready is None:
                        ready = (prep(pd.concat(parts) if parts else piece.loc[kind == 0, build_cols]),)
                    out = fn(ready[0], piece.loc[kind == 1, probe_cols])
                    if len(out):
                        yield out[names]

    spread = rows.repartition(tasks, *group) if tasks else rows.repartition(*group)
    return spread.sortWithinPartitions(*group, "_kind").mapInPandas(run, schema)
