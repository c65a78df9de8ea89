"""Ordered chains: scope flags of survey days, tours, runs and cuts."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomway.functions.modes import HOLIDAY, LEISURE_ANY, LEISURE_SHORT, PROFESSIONAL_ROUND, RESIDENCE

DAY_S = 86_400

#: The eight scopes: kind of day, purposes, distance.
SCOPES = tuple("-".join(x) for x in product(("round", "alldays"), ("dest", "allpurp"), ("local", "daytable")))


def scope_filter(scope: str) -> Column:
    """Predicate over scope_trips() of one of SCOPES."""
    if scope not in SCOPES:
        raise ValueError(f"unknown scope: {scope}")
    days, purposes, distance = scope.split("-")
    out = F.lit(True)
    if days == "round":
        out = out & F.col("is_round")
    if purposes == "dest":
        out = out & F.col("is_destination")
    if distance == "local":
        out = out & (F.col("mobloc") == 1)
    return F.coalesce(out, F.lit(False))


def scope_days(trips: DataFrame, order: Sequence[str]) -> DataFrame:
    """(day_id, first_origin, last_destination, starts_at_residence, ends_at_residence, is_round).

    A first origin that is missing or 9999 is judged by the home flag `moridom`
    of the same trip. Blank purposes are missing. Unknown ends are not at home.
    """
    key = F.struct(*order)
    ends = trips.groupBy("day_id").agg(
        F.min_by(F.nullif("origin_purpose", F.lit("")), key).alias("first_origin"),
        F.min_by("moridom", key).alias("first_moridom"),
        F.max_by(F.nullif("destination_purpose", F.lit("")), key).alias("last_destination"),
    )
    return ends.withColumns(_at_home()).withColumn("is_round", F.col("starts_at_residence") & F.col("ends_at_residence"))


def _at_home() -> dict[str, Column]:
    """Whether a day starts and ends at a residence, from first_origin, first_moridom and last_destination."""
    starts = F.when(F.col("first_origin").isNull() | (F.col("first_origin") == "9999"), F.col("first_moridom") == 1).otherwise(F.col("first_origin").isin(*RESIDENCE))
    return {"starts_at_residence": F.coalesce(starts, F.lit(False)), "ends_at_residence": F.coalesce(F.col("last_destination").isin(*RESIDENCE), F.lit(False))}


def scope_trips(trips: DataFrame, order: Sequence[str], activity_stay_min: float = 15.0) -> DataFrame:
    """Trips with the stay to the next departure, activity flags, is_destination and their day's flags.

    `departure_s` and `arrival_s` are seconds of the day; a stay goes over
    midnight by one day. A trip is no destination if its motive is a holiday's,
    it is a professional round, a walk or ride for its own sake, or the way home from one.
    """
    w = W.partitionBy("day_id").orderBy(*order)
    stay = F.pmod(F.lead("departure_s").over(w) - F.col("arrival_s") + DAY_S, F.lit(DAY_S)) / 60.0
    out = trips.withColumn("stay_min", stay)
    own_sake = F.col("mode_group").isin("walk", "cycle") & (F.col("destination_motive").isin(*LEISURE_ANY) | ((F.col("destination_motive") == LEISURE_SHORT) & (F.col("stay_min") < activity_stay_min)))
    out = out.withColumn("outward_activity", F.coalesce(own_sake, F.lit(False)))
    out = out.withColumn("prior_activity", F.lag("outward_activity", 1, False).over(w))
    falsy = lambda c: F.coalesce(c, F.lit(False))
    rules = falsy(F.col("motive").isin(*HOLIDAY)) | falsy(F.col("destination_purpose").isin(*PROFESSIONAL_ROUND)) | F.col("outward_activity") | (falsy(F.col("destination_purpose").isin(*RESIDENCE)) & F.col("prior_activity"))
    # The day's ends are windows of the same partitioning and order: no second pass over the trips.
    day = w.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    ends = {"first_origin": F.first(F.nullif("origin_purpose", F.lit(""))).over(day), "first_moridom": F.first("moridom").over(day), "last_destination": F.last(F.nullif("destination_purpose", F.lit(""))).over(day)}
    out = out.withColumn("is_destination", ~rules).where("day_id is not null").withColumns(ends).withColumns(_at_home()).drop(*ends)
    return out.withColumn("is_round", F.col("starts_at_residence") & F.col("ends_at_residence"))


def tours(scoped: DataFrame, order: Sequence[str], selected: Column) -> DataFrame:
    """Trips with tour_id (homecomings so far), tour_size and whether the tour is complete and wholly selected."""
    w = W.partitionBy("day_id").orderBy(*order)
    home = F.coalesce(F.col("destination_purpose").isin(*RESIDENCE), F.lit(False))
    numbered = scoped.withColumn("tour_id", F.coalesce(F.sum(home.cast("int")).over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).withColumn("_selected", F.coalesce(selected, F.lit(False)))
    # A tour's trips lie in one day, so its flags are windows of the same partitioning.
    t = W.partitionBy("day_id", "tour_id")
    last_home = F.max_by(home, F.struct(*order)).over(t)
    complete = F.bool_and("_selected").over(t) & ((F.col("tour_id") > 0) | F.bool_and("starts_at_residence").over(t)) & last_home
    return numbered.withColumns({"tour_size": F.count("*").over(t), "is_complete": F.coalesce(complete, F.lit(False))}).drop("_selected")


def runs(df: DataFrame, keys: Sequence[str], position: str, flag: str) -> DataFrame:
    """Gaps and islands: maximal runs of equal `flag` along `position`: (keys, flag, first, last, length)."""
    w = W.partitionBy(*keys).orderBy(position)
    wf = W.partitionBy(*keys, flag).orderBy(position)
    return (
        df.withColumn("_g", F.row_number().over(w) - F.row_number().over(wf))
        .groupBy(*keys, flag, "_g")
        .agg(F.min(position).alias("first"), F.max(position).alias("last"), F.count("*").alias("length"))
        .drop("_g")
    )


def cut_ends(df: DataFrame, keys: Sequence[str], position: str, covered: str, theta: float, k: int) -> DataFrame:
    """Per chain: n, matched, share, outcome (dropped, cut or kept), start, end and whether an inner gap reaches k.

    Below `theta` the chain is dropped. An end is cut where at least `k`
    elements before the first or after the last covered one are uncovered;
    `position` counts from 0 without holes.
    """
    c = F.coalesce(F.col(covered), F.lit(False))
    flagged = df.withColumn("_c", c)
    sums = flagged.groupBy(*keys).agg(F.count("*").alias("n"), F.count(F.when(F.col("_c"), 1)).alias("matched"), F.min(F.when(F.col("_c"), F.col(position))).alias("_first"), F.max(F.when(F.col("_c"), F.col(position))).alias("_last"))
    share = F.col("matched") / F.col("n")
    dropped = (share < theta) | F.col("_first").isNull()
    start = F.when(F.col("_first") >= k, F.col("_first")).otherwise(0)
    end = F.when(F.col("n") - 1 - F.col("_last") >= k, F.col("_last")).otherwise(F.col("n") - 1)
    out = sums.withColumns({"share": share, "start": F.when(dropped, F.lit(0)).otherwise(start).cast("long"), "end": F.when(dropped, F.col("n") - 1).otherwise(end).cast("long"), "_dropped": dropped})
    longest = runs(flagged, keys, position, "_c").where(~F.col("_c"))
    inner = longest.join(out.select(*keys, "start", "end"), list(keys)).select(*keys, (F.least("last", "end") - F.greatest("first", "start") + 1).alias("_gap")).groupBy(*keys).agg(F.max("_gap").alias("_gap"))
    outcome = F.when(F.col("_dropped"), "dropped").when((F.col("start") == 0) & (F.col("end") == F.col("n") - 1), "kept").otherwise("cut")
    return out.join(inner, list(keys), "left").select(*keys, "n", "matched", "share", outcome.alias("outcome"), "start", "end", (~F.col("_dropped") & F.coalesce(F.col("_gap") >= k, F.lit(False))).alias("flagged"))
