"""The scope cube: indicators for all scopes, surveys and categories with bootstrap intervals, in one plan."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomway.functions.exprs import safe_div
from loomway.operators import bootstrap as bs
from loomway.operators import chains

#: Sums per household: person-weekdays, weighted described weekdays (left out by the day switch, kept, kept with trips), and weighted trips of kept days, each sum beside the weight of the trips it is known of.
COMPONENTS = ("universe", "dropped", "kept", "travel", "trips", "minutes", "minute_trips", "producer_km", "producer_trips", "crow_km", "crow_trips")
#: The eight indicators; person_days are the universe without dropped days.
INDICATORS = {
    "person_days_kept_share": ("person_days", "universe"), "trips_per_day": ("trips", "travel"), "minutes_per_trip": ("minutes", "minute_trips"),
    "km_per_trip_producer": ("producer_km", "producer_trips"), "km_per_trip_crow_fly": ("crow_km", "crow_trips"),
    "minutes_per_day_day": ("minutes", "kept"), "minutes_per_day_travel_day": ("minutes", "travel"), "minutes_per_day_person": ("minutes", "person_days"),
}
WEEKDAYS = 5


#: Rows under which a cell is blank, and under which it is to be read with caution.
LEAST, CAUTION = 50, 100
REFERENCE = "round-dest-local"
#: What each of the three switches makes of the reference scope.
SWITCHES = {"days": "alldays-dest-local", "purpose": "round-allpurp-local", "distance": "round-dest-daytable"}


def components(scoped: DataFrame, roster: DataFrame, scopes: Sequence[str] = chains.SCOPES) -> DataFrame:
    """(scope, survey, hh, category, COMPONENTS, rows) of weekdays; rows counts the kept days with trips.

    scoped: scope_trips() with survey, hh, category, w, minutes, producer_km and
    crow_km, null where unknown; roster: (survey, hh, category, w) of all persons.
    Every described day is there for all scopes, whether a trip of it is selected or not.
    """
    known = ("minutes", "minute_trips"), ("producer_km", "producer_trips"), ("crow_km", "crow_trips")
    src = {"minutes": "minutes", "producer_km": "producer_km", "crow_km": "crow_km"}
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    per = lambda f: [F.count(F.when(f, 1)).cast("double").alias("trips"), *(x for v, n in known for x in (zero(F.sum(F.when(f, F.col(src[v])))).alias(v), F.count(F.when(f, F.col(src[v]))).cast("double").alias(n)))]
    # Whether a day is round is the same for all of its trips, so scopes that differ in that alone share their sums.
    trips_of = {s: "alldays-" + s.split("-", 1)[1] for s in scopes}
    shared = sorted(set(trips_of.values()))
    flagged = scoped.where("typejour = 1 and w > 0").select("survey", "day_id", "hh", "category", "w", "is_round", *src.values(), *(chains.scope_filter(s).alias(f"_f{i}") for i, s in enumerate(shared)))
    days = flagged.groupBy("survey", "day_id").agg(F.min("hh").alias("hh"), F.min("category").alias("category"), F.max("w").alias("w"), F.bool_or("is_round").alias("is_round"), *(F.struct(*per(F.col(f"_f{i}"))).alias(f"_{i}") for i in range(len(shared))))
    kept = lambda s: F.col("is_round") if s.startswith("round") else F.lit(True)
    each = F.explode(F.array(*(F.struct(F.lit(s).alias("scope"), kept(s).alias("is_kept"), F.col(f"_{shared.index(trips_of[s])}").alias("t")) for s in scopes)))
    day = days.select("survey", "hh", "category", "w", each.alias("z")).select("survey", "hh", "category", "w", "z.scope", "z.is_kept", "z.t.*")
    w, k = F.col("w"), F.col("is_kept")
    travel = k & (F.col("trips") > 0)
    of = {"universe": F.lit(0.0), "dropped": F.when(~k, w), "kept": F.when(k, w), "travel": F.when(travel, w), **{c: F.when(k, w * F.col(c)) for c in COMPONENTS[4:]}}
    keys = ["scope", "survey", "hh", "category"]
    lived = day.groupBy(*keys).agg(*(zero(F.sum(c)).alias(n) for n, c in of.items()), F.count(F.when(travel, 1)).alias("rows"))
    people = roster.groupBy("survey", "hh", "category").agg(F.sum(WEEKDAYS * w).alias("universe")).withColumn("scope", F.explode(F.array(*(F.lit(s) for s in scopes))))
    people = people.select(*keys, "universe", *(F.lit(0.0).alias(c) for c in COMPONENTS[1:]), F.lit(0).cast("long").alias("rows"))
    return lived.unionByName(people).groupBy(*keys).agg(*(F.sum(c).alias(c) for c in (*COMPONENTS, "rows")))


def _indicators(sums: DataFrame, keys: Sequence[str], *more: str) -> DataFrame:
    """One row for each indicator of the component sums."""
    sums = sums.withColumn("person_days", F.col("universe") - F.col("dropped"))
    each = F.array(*(F.struct(F.lit(i).alias("indicator"), safe_div(F.col(a), F.col(b)).alias("value")) for i, (a, b) in INDICATORS.items()))
    return sums.select(*keys, *more, F.explode(each).alias("z")).select(*keys, *more, "z.*")


def cube(parts: DataFrame, draws: DataFrame | None = None, reps: int = 0, level: float = 0.95) -> DataFrame:
    """(scope, survey, category, indicator, n, reading, value, low, high): point estimates, and intervals where there are draws.

    Draws are those of bootstrap.draws() by survey, shared by all scopes, so
    that scopes can be compared replicate by replicate. Cells of less than LEAST
    days are blank; reading says which, and which have less than CAUTION.
    """
    keys = ["scope", "survey", "category"]
    point = _indicators(parts.groupBy(*keys).agg(F.sum("rows").alias("n"), *(F.sum(c).alias(c) for c in COMPONENTS)), keys, "n")
    n = F.col("n")
    point = point.withColumn("reading", F.when(n < LEAST, "blank").when(n < CAUTION, "caution").otherwise("ok"))
    if draws is None:
        return point
    sums = bs.replicates(parts, keys, ["survey", "hh"], {c: F.col(c) for c in COMPONENTS}, draws, reps)
    ci = bs.interval(_indicators(sums, keys, "rep"), [*keys, "indicator"], F.col("value"), level, reps)
    out = point.join(ci.drop("valid"), [*keys, "indicator"], "left")
    return out.select(*keys, "indicator", "n", "reading", *(bs.suppressed(F.col(c), n, LEAST).alias(c) for c in ("value", "low", "high")))


def switch_effects(parts: DataFrame, draws: DataFrame, reps: int, level: float = 0.95) -> DataFrame:
    """(survey, indicator, switch, reference, effect, low, high): what a switch adds to the reference scope.

    Effects are taken within each replicate, all scopes having the same draws.
    """
    keys = ["survey", "indicator"]
    scope_of = F.coalesce(*(F.when(F.col("scope") == s, F.lit(n)) for n, s in SWITCHES.items()))

    def effects(values: DataFrame, at: list[str]) -> DataFrame:
        ref = values.where(F.col("scope") == REFERENCE).select(*at, F.col("value").alias("reference"))
        to = values.withColumn("switch", scope_of).where("switch is not null").select(*at, "switch", "value")
        return to.join(ref, at).withColumn("effect", F.col("value") - F.col("reference"))

    mine = parts.where(F.col("scope").isin(REFERENCE, *SWITCHES.values()))
    point = effects(_indicators(mine.groupBy("scope", "survey").agg(*(F.sum(c).alias(c) for c in COMPONENTS)), ["scope", "survey"]), keys)
    sums = bs.replicates(mine, ["scope", "survey"], ["survey", "hh"], {c: F.col(c) for c in COMPONENTS}, draws, reps)
    each = effects(_indicators(sums, ["scope", "survey"], "rep"), [*keys, "rep"])
    ci = bs.interval(each, [*keys, "switch"], F.col("effect"), level, reps)
    return point.join(ci.drop("valid"), [*keys, "switch"], "left").select(*keys, "switch", "reference", "effect", "low", "high")


def survey_ratios(parts: DataFrame, draws: DataFrame, reps: int, a: str, b: str, level: float = 0.9) -> DataFrame:
    """(scope, indicator, a, b, ratio, low, high): b against a, two independent samples paired by replicate."""
    keys = ["scope", "indicator"]
    at = lambda s, c="value": F.max(F.when(F.col("survey") == s, F.col(c)))
    sums = [F.sum(c).alias(c) for c in COMPONENTS]
    point = _indicators(parts.groupBy("scope", "survey").agg(*sums), ["scope", "survey"]).groupBy(*keys).agg(at(a).alias("a"), at(b).alias("b"))
    reps_ = _indicators(bs.replicates(parts, ["scope", "survey"], ["survey", "hh"], {c: F.col(c) for c in COMPONENTS}, draws, reps), ["scope", "survey"], "rep")
    q = reps_.groupBy(*keys, "rep").agg(safe_div(at(b), at(a)).alias("q"))
    ci = bs.interval(q, keys, F.col("q"), level, reps)
    return point.join(ci.drop("valid"), keys, "left").withColumn("ratio", safe_div(F.col("b"), F.col("a"))).select(*keys, "a", "b", "ratio", "low", "high")
