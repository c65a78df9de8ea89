"""Weighted least squares with dummies from sums over the rows."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def solve(a: np.ndarray, b: np.ndarray) -> list[float | None]:
    """Coefficients of the normal equations; None for columns that depend on earlier ones (to a relative 1e-9)."""
    free: list[int] = []
    for i in range(len(b)):
        rest = a[i, i] - (a[i, free] @ np.linalg.solve(a[np.ix_(free, free)], a[free, i]) if free else 0.0)
        if a[i, i] > 0 and rest > 1e-9 * a[i, i]:
            free.append(i)
    got = dict(zip(free, map(float, np.linalg.solve(a[np.ix_(free, free)], b[free])))) if free else {}
    return [got.get(i) for i in range(len(b))]


def wls(df: DataFrame, y: Column, weight: Column, columns: dict[str, Column], groups: Sequence[str] = ()) -> DataFrame:
    """(groups, term, estimate, n): one aggregate gives X'WX and X'Wy of each group, and each is solved where it lies.

    Dependent columns get null, as do all where a group has no weight. Rows
    with a null are left out; a group with no other rows gives no row.
    """
    names, k = list(columns), len(columns)
    rows = df.select(*groups, y.cast("double").alias("_y"), weight.cast("double").alias("_w"), *(c.cast("double").alias(f"_x{i}") for i, c in enumerate(columns.values()))).na.drop(subset=["_y", "_w", *(f"_x{i}" for i in range(k))])
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    w, x = F.col("_w"), [F.col(f"_x{i}") for i in range(k)]
    sums = rows.groupBy(*groups).agg(F.count("*").alias("_n"), F.array(*(F.sum(w * x[i] * x[j]) for i, j in pairs)).alias("_a"), F.array(*(F.sum(w * x[i] * F.col("_y")) for i in range(k))).alias("_b"))
    kinds = {f.name: f.dataType.simpleString() for f in df.schema}
    schema = ", ".join([*(f"`{g}` {kinds[g]}" for g in groups), "term string, estimate double, n long"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for r in pdf.itertuples(index=False):
                row = dict(zip(pdf.columns, r))
                if not row["_n"]:
                    continue
                a = np.zeros((k, k))
                for (i, j), v in zip(pairs, row["_a"]):
                    a[i, j] = a[j, i] = v
                out += [(*(row[g] for g in groups), t, e, row["_n"]) for t, e in zip(names, solve(a, np.array(row["_b"], float)))]
            frame = pd.DataFrame(out, columns=[*groups, "term", "estimate", "n"])
            yield frame.assign(estimate=frame["estimate"].astype("Float64"))

    return sums.mapInPandas(run, schema)
