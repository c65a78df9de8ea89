"""Decompositions, standardisation and re-weighting between two samples."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomway.functions.exprs import safe_div


def log_mean(a: Column, b: Column) -> Column:
    """(b - a) / ln(b / a), a where the two are equal; null unless both are positive."""
    ln = F.ln(F.when((a > 0) & (b > 0), b / a))
    return F.when(F.abs(ln) < 1e-14, a).otherwise((b - a) / ln)


def log_terms(total_a: Column, total_b: Column, factors: dict[str, tuple[Column, Column, int]]) -> dict[str, Column]:
    """Additive terms of a product's change: each factor's log change times the log mean of the totals; sign -1 for divisors."""
    m = log_mean(total_a, total_b)
    return {name: m * sign * F.ln(F.when((a > 0) & (b > 0), b / a)) for name, (a, b, sign) in factors.items()}


def side_by_side(stats: DataFrame, keys: Sequence[str], side: str, a, b, columns: Sequence[str]) -> DataFrame:
    """One row per key with each column's value on both sides (`_a`, `_b`), null where a side lacks the key."""
    return stats.groupBy(*keys).agg(*(F.max(F.when(F.col(side) == v, F.col(c))).alias(f"{c}_{n}") for c in columns for v, n in ((a, "a"), (b, "b"))))


def shift_share(groups: DataFrame, minutes: str = "minutes", weight: str = "weight", a: str = "a", b: str = "b") -> DataFrame:
    """Change of minutes per day by group: mix, within and interaction, with the volume term on each row.

    `groups` has one row per (survey, grp): weight (weighted trips), minutes
    (weighted minutes) and day_weight (weight of all days of the survey). A
    group absent from one side takes that side's overall minutes per trip.
    """
    tot = W.partitionBy("survey")
    s = groups.withColumns({"share": F.col(weight) / F.sum(weight).over(tot), "m": safe_div(F.col(minutes), F.col(weight)), "big_m": F.sum(minutes).over(tot) / F.sum(weight).over(tot), "per_day": F.sum(weight).over(tot) / F.col("day_weight")})
    rows = side_by_side(s, ["grp"], "survey", a, b, ("share", "m"))
    overall = side_by_side(s.select("survey", "big_m", "per_day").distinct().withColumn("one", F.lit(1)), ["one"], "survey", a, b, ("big_m", "per_day")).drop("one")
    x = rows.crossJoin(F.broadcast(overall))  # one row
    sa, sb = (F.coalesce(F.col(f"share_{k}"), F.lit(0.0)) for k in "ab")
    ma, mb = (F.coalesce(F.col(f"m_{k}"), F.col(f"big_m_{k}")) for k in "ab")
    n = F.col("per_day_b")
    return x.select("grp", sa.alias("share_a"), sb.alias("share_b"), ((sb - sa) * ma * n).alias("mix"), (sa * (mb - ma) * n).alias("within"), ((sb - sa) * (mb - ma) * n).alias("interaction"), ((n - F.col("per_day_a")) * F.col("big_m_a")).alias("volume"))


def reweight(cells: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Sample a at b's mix of cells: one row with both means, the counterfactual, the two effects and the lost share.

    `cells` has one row per (survey, cell) with weight and total (weighted sum
    of the value). Cells without weight in a are left out and b's shares renormalised.
    """
    x = side_by_side(cells, ["cell"], "survey", a, b, ("weight", "total"))
    matched = (F.col("weight_a") > 0) & F.col("weight_b").isNotNull()
    wb = F.when(matched, F.col("weight_b"))
    cf = safe_div(F.sum(wb * F.col("total_a") / F.col("weight_a")), F.sum(wb))
    mean_a, mean_b = safe_div(F.sum("total_a"), F.sum("weight_a")), safe_div(F.sum("total_b"), F.sum("weight_b"))
    out = x.agg(mean_a.alias("mean_a"), mean_b.alias("mean_b"), cf.alias("counterfactual"), F.count(wb).alias("cells"), (1 - safe_div(F.sum(wb), F.sum("weight_b"))).alias("lost_share"))
    return out.withColumns({"composition": F.col("counterfactual") - F.col("mean_a"), "behaviour": F.col("mean_b") - F.col("counterfactual")})


def standardise(cells: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Both samples at their mean mix over the cells both have: (standard_a, standard_b, ratio, cells)."""
    x = side_by_side(cells, ["cell"], "survey", a, b, ("weight", "total")).where("weight_a > 0 and weight_b > 0")
    tot = W.partitionBy()  # one row per cell
    mix = (F.col("weight_a") / F.sum("weight_a").over(tot) + F.col("weight_b") / F.sum("weight_b").over(tot)) / 2
    y = x.withColumn("mix", mix)
    sa, sb = F.sum(F.col("mix") * F.col("total_a") / F.col("weight_a")), F.sum(F.col("mix") * F.col("total_b") / F.col("weight_b"))
    return y.agg(sa.alias("standard_a"), sb.alias("standard_b"), safe_div(sb, sa).alias("ratio"), F.count("*").alias("cells"))


def _by_role(cells: DataFrame, keys: Sequence[str]) -> DataFrame:
    at = lambda role, c: F.sum(F.when(F.col("role") == role, F.col(c)))
    return cells.groupBy(*keys, "cell").agg(*(at(r, c).alias(f"{c}_{r}") for r in "ab" for c in ("w", "k", "h")), at("mix", "w").alias("w_mix"))


def common_cells(cells: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, cell) that both sides and the mix have."""
    return _by_role(cells, keys).where("w_a > 0 and w_b > 0 and w_mix > 0").select(*keys, "cell")


def standard_speeds(cells: DataFrame, common: DataFrame, keys: Sequence[str], more: Sequence[str] = ()) -> DataFrame:
    """(keys, more, cells, speed_a, speed_b): both sides' kilometres over hours per trip, at the mix of trips of a third sample.

    `cells` has (keys, more, role, cell, w, k, h): trips, kilometres and hours,
    all weighted, of role a, b or mix. The cells are those of `common`, found
    once; a side that lacks one of them, as in a replicate, has no speed.
    """
    x = _by_role(cells, [*keys, *more]).join(common, [*keys, "cell"])

    def speed(s: str) -> Column:
        w, mix = F.col(f"w_{s}"), F.coalesce("w_mix", F.lit(0.0))
        per = lambda c: F.sum(F.when(w > 0, mix * F.col(f"{c}_{s}") / w))
        return F.when(F.bool_and(F.coalesce(w > 0, F.lit(False))), safe_div(per("k"), per("h"))).alias(f"speed_{s}")

    return x.groupBy(*keys, *more).agg(F.count("*").alias("cells"), speed("a"), speed("b"))


def between_share(cells: DataFrame) -> DataFrame:
    """Share of the variance that lies between cells, from rows (cell, weight, total, squares)."""
    w, t = F.sum("weight"), F.sum("total")
    grand = t / w
    between = F.sum(F.col("total") * F.col("total") / F.col("weight")) / w - grand * grand
    return cells.agg(safe_div(between, F.sum("squares") / w - grand * grand).alias("eta2"))


def neighbour_merge(counts: dict[tuple[str, int], tuple[int, int]], bands: int, least: int = 30) -> dict[tuple[str, int], int]:
    """Bands joined left to right within each stratum until both samples have `least` rows; a short rest joins the last run.

    Takes one count pair per (stratum, band), a few dozen numbers.
    """
    out: dict[tuple[str, int], int] = {}
    for stratum in sorted({s for s, _ in counts}):
        first, full, a, b = 0, None, 0, 0
        for i in range(bands):
            x, y = counts.get((stratum, i), (0, 0))
            a, b = a + x, b + y
            out[stratum, i] = first
            if min(a, b) >= least:
                full, first, a, b = first, i + 1, 0, 0
        if first < bands and a + b > 0:
            out |= {(stratum, i): full or 0 for i in range(first, bands)}
    return out


def smallest_first_merge(counts: dict[int, int], least: int) -> dict[int, int]:
    """Ordered levels joined until each cluster has `least` rows: the smallest one joins its smaller neighbour."""
    clusters = [[k] for k in sorted(counts)]
    size = lambda c: sum(counts[k] for k in c)
    while len(clusters) > 1 and min(map(size, clusters)) < least:
        i = min(range(len(clusters)), key=lambda j: (size(clusters[j]), j))
        near = [j for j in (i - 1, i + 1) if 0 <= j < len(clusters)]
        j = min(near, key=lambda k: (size(clusters[k]), k))
        lo, hi = sorted((i, j))
        clusters[lo : hi + 1] = [clusters[lo] + clusters[hi]]
    return {k: c[0] for c in clusters for k in c}


def to_target_mix(cells: DataFrame, target: DataFrame) -> DataFrame:
    """(survey, value, lost_share): each sample's mean at a given mix of cells.

    `cells` has (survey, cell, weight, total), `target` (cell, share). Shares
    of cells that a sample lacks are lost and the others scaled up.
    """
    x = target.crossJoin(F.broadcast(cells.select("survey").distinct())).join(cells, ["survey", "cell"], "left")
    have = F.col("weight") > 0
    s = F.when(have, F.col("share"))
    return x.groupBy("survey").agg(safe_div(F.sum(s * F.col("total") / F.col("weight")), F.sum(s)).alias("value"), (1 - safe_div(F.sum(s), F.sum("share"))).alias("lost_share"))


def to_joint_mix(cells: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(value): sample a's mean at b's joint mix of cells. A cell of b that a lacks is an error."""
    x = side_by_side(cells, ["cell"], "survey", a, b, ("weight", "total")).where("weight_b > 0")
    mean = F.when(F.coalesce(F.col("weight_a") > 0, F.lit(False)), F.col("total_a") / F.col("weight_a")).otherwise(F.raise_error(F.concat(F.lit("no support in cell "), F.coalesce(F.col("cell").cast("string"), F.lit("null")))))
    return x.agg(safe_div(F.sum(F.col("weight_b") * mean), F.sum("weight_b")).alias("value"))


def collapse_cells(counts: dict[tuple[int, int], tuple[int, int]], least: int) -> dict[tuple[int, int], int]:
    """Two-way cells (row, level) joined along their row's levels until each has `least` rows in both samples.

    A row whose whole is too small becomes one cell. Takes a few dozen counts.
    """
    out: dict[tuple[int, int], int] = {}
    for row in sorted({r for r, _ in counts}):
        levels = {lv: min(c) for (r, lv), c in counts.items() if r == row}
        merged = smallest_first_merge(levels, least)
        out |= {(row, lv): m for lv, m in merged.items()}
    return out
