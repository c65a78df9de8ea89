"""Timetable feeds and route matching: calendars, patterns, coverage, cuts, grids of parameters, scoring."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomway.functions.exprs import code_map, iso_weekday, safe_div
from loomway.operators.relational import keep_best
from loomway.session import cut

WEEKDAYS = ("monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday")
GUIDED = ("tram", "metro", "rail")
HOMONYM_SHARE, FERRY_RADIUS_M, LOOSE_SHARE = 0.3, 200.0, 0.5


def day8(c: Column) -> Column:
    """Date of a yyyymmdd text, null where it is none."""
    return F.to_date(F.try_to_timestamp(c, F.lit("yyyyMMdd")))


def active_services(calendar: DataFrame, exceptions: DataFrame, day: date) -> DataFrame:
    """(service_id) running on a day: the weekday's flag within the dates, without removals, with additions.

    `exceptions` has service_id, day (date) and exception_type. Services come
    once; a null service never runs.
    """
    d = F.lit(day)
    regular = calendar.where((F.col(WEEKDAYS[day.weekday()]) == "1") & (day8(F.col("start_date")) <= d) & (day8(F.col("end_date")) >= d)).select("service_id")
    that = exceptions.where(F.col("day") == d)
    kept = regular.join(that.where("exception_type = '2'").select("service_id"), "service_id", "left_anti")
    return kept.union(that.where("exception_type = '1'").select("service_id")).where("service_id is not null").distinct()


def service_days(calendar: DataFrame, exceptions: DataFrame) -> DataFrame:
    """(service_id, day): every day a service runs. Days with a removal are out, added ones in, and each comes once."""
    flags = F.array(*(F.col(w) for w in WEEKDAYS))
    start, end = day8(F.col("start_date")), day8(F.col("end_date"))
    regular = calendar.where((start <= end) & F.col("service_id").isNotNull()).withColumn("day", F.explode(F.sequence(start, end))).where(F.element_at(flags, iso_weekday(F.col("day"))) == "1").select("service_id", "day")
    removed = exceptions.where("exception_type = '2'").select("service_id", "day")
    added = exceptions.where("exception_type = '1' and service_id is not null and day is not null").select("service_id", "day")
    return regular.join(removed, ["service_id", "day"], "left_anti").unionByName(added).distinct()


def patterns(stops: DataFrame, chain: Sequence[str], position: Sequence[str], item: str) -> DataFrame:
    """(item, sequence array, chains): the distinct ordered sequences of stops, with how many chains run them.

    Sequences are grouped by the array itself, not by a hash of it.
    """
    per = stops.groupBy(*chain).agg(F.transform(F.array_sort(F.collect_list(F.struct(*position, F.col(item).alias("_item")))), lambda s: s["_item"]).alias("sequence"))
    return per.groupBy("sequence").agg(F.count("*").alias("chains"))


def expand_pattern(pats: DataFrame, *keys: str) -> DataFrame:
    """One row per stop of a pattern, places from 1."""
    return pats.select(*keys, F.posexplode("sequence").alias("stop_sequence", "stop")).withColumn("stop_sequence", F.col("stop_sequence") + 1)


def lifecycle_excluded(tags: Column, prefixes: Sequence[str] = ("disused:", "abandoned:", "construction:", "proposed:")) -> Column:
    """Whether a key of the tags says that the object is not in use."""
    return F.exists(F.map_keys(tags), lambda k: reduce(lambda a, b: a | b, (F.startswith(k, F.lit(p)) for p in prefixes)))


def opens_after(value: Column, snapshot: Column) -> Column:
    """Whether a date text, a full one or one that begins with a year, lies after the snapshot."""
    year = F.nullif(F.regexp_extract(value, "^([0-9]{4})", 1), F.lit("")).try_cast("int")
    return F.coalesce(value.try_cast("date") > snapshot, F.lit(False)) | F.coalesce(year > F.year(snapshot), F.lit(False))


def evaluate_grid(stops: DataFrame, distances: DataFrame, names: DataFrame, radii: Sequence[float], shares: Sequence[float], ks: Sequence[int], thetas: Sequence[float], dates: Sequence[date] | None = None) -> DataFrame:
    """Outcome of every pattern at every point of a parameter grid, as one plan.

    stops: (network, pattern_id, mode, express, ordinal); distances: (network,
    pattern_id, ordinal, relation_id, in_service, distance_m), one row per stop
    and relation, and perhaps is_fallback for tracks that no relation names;
    names: (network, pattern_id, relation_id, affiliation). With `dates` the grid
    has that dimension too: distances and names then carry the `date` they hold
    on, and the outcomes their own.

    A pattern takes the relations of its name with the best affiliation; for
    buses and ferries only where they cover HOMONYM_SHARE of its stops. Without
    one it takes the relations of the best covered share from `share` on. A
    stop of a guided mode is covered by any relation in service within the
    radius, and by a fallback track where the pattern has no relation at all;
    another one by the pattern's own. Networks with less than half their patterns
    matched are not testable. On guided and express lines an end with at least k
    uncovered stops is cut, and what is left under theta is dropped; other lines
    are kept from LOOSE_SHARE of covered stops on. A line that is kept whole, but
    by its shape and not by its name, is renamed.

    A stop meets the radii once: whether it is within each of them are columns
    of its row, so no join or aggregate before the last step has a row for each
    grid point. A pattern's stops are counted by partial aggregates; only its
    counts are multiplied by the grid.
    """
    spark = stops.sparkSession
    pk, on = ["network", "pattern_id"], ["date"] if dates else []
    dpk = [*on, *pk]
    meta = stops.groupBy(*pk).agg(F.any_value("mode", True).alias("mode"), F.bool_or("express").alias("express"), F.count("*").alias("n"))
    each = range(len(radii))
    reach = [F.when(F.col("mode") == "ferry", F.lit(FERRY_RADIUS_M)).otherwise(F.lit(float(r))) for r in radii]
    back = F.coalesce(F.col("is_fallback"), F.lit(False)) if "is_fallback" in distances.columns else F.lit(False)
    near = distances.where(~back & F.col("in_service") & (F.col("distance_m") <= max(*radii, FERRY_RADIUS_M)))
    spare = distances.where(back & (F.col("distance_m") <= max(radii)))
    void = lambda kind, name: F.lit(None).cast(kind).alias(name)
    kinds = dict(distances.dtypes)
    row = lambda df, d, f, a: df.select(*dpk, "ordinal", "relation_id", d, f, a)
    rows = row(near, "distance_m", void("double", "spare_m"), void("long", "affiliation")).unionByName(row(spare, void("double", "distance_m"), F.col("distance_m").alias("spare_m"), void("long", "affiliation")))
    rows = rows.unionByName(names.select(*dpk, void(kinds["ordinal"], "ordinal"), "relation_id", void("double", "distance_m"), void("double", "spare_m"), F.col("affiliation").cast("long").alias("affiliation")))
    # All that follows is partitioned by pattern: windows instead of joins, so that nothing moves again.
    rows = rows.repartition(*pk).join(meta.select(*pk, "mode"), pk)
    rows = rows.groupBy(*dpk, "mode", "ordinal", "relation_id").agg(F.min("distance_m").alias("distance_m"), F.min("spare_m").alias("spare_m"), F.max("affiliation").alias("affiliation"))
    guided_line, within = F.col("mode").isin(*GUIDED), lambda i: F.coalesce(F.col("distance_m") <= reach[i], F.lit(False))
    rows = rows.select(*dpk, "ordinal", "relation_id", "affiliation", *(within(i).alias(f"track_{i}") for i in each), *((within(i) | F.coalesce(guided_line & (F.col("spare_m") <= float(r)), F.lit(False))).alias(f"wide_{i}") for i, r in enumerate(radii)))
    of_relation, of_pattern = W.partitionBy(*dpk, "relation_id"), W.partitionBy(*dpk)
    rows = rows.withColumns({"aff": F.max("affiliation").over(of_relation), **{f"c_{i}": F.count_if(f"track_{i}").over(of_relation) for i in each}})
    rows = rows.withColumns({"best_aff": F.max("aff").over(of_pattern), **{f"b_{i}": F.max(f"c_{i}").over(of_pattern) for i in each}})
    named = F.coalesce(F.col("aff") == F.col("best_aff"), F.lit(False))
    flags = {**{f"name_{i}": named & F.col(f"track_{i}") for i in each}, **{f"shape_{i}": (F.col(f"c_{i}") == F.col(f"b_{i}")) & F.col(f"track_{i}") for i in each}}
    ways = ("name", "shape", "track", "wide")
    # A stop counts once however many relations are near it.
    per_stop = rows.withColumns(flags).withColumn("has_name", named).groupBy(*dpk, "ordinal").agg(*(F.bool_or(f"{w}_{i}").alias(f"{w}_{i}") for w in ways for i in each), *(F.max(f"b_{i}").alias(f"b_{i}") for i in each), F.bool_or("has_name").alias("has_name"))
    found = lambda c: F.struct(F.count_if(c).alias("n"), F.min(F.when(F.col(c), F.col("ordinal"))).alias("first"), F.max(F.when(F.col(c), F.col("ordinal"))).alias("last"))
    per_pattern = per_stop.groupBy(*dpk).agg(*(found(f"{w}_{i}").alias(f"{w}_{i}") for w in ways for i in each), *(F.max(f"b_{i}").alias(f"b_{i}") for i in each), F.bool_or("has_name").alias("has_name"))
    # The dates are parameters, a few values.
    at = meta.crossJoin(F.broadcast(spark.createDataFrame([(d,) for d in dates], "date date"))) if dates else meta
    at = at.join(per_pattern, dpk, "left")
    loose, guided, n = F.col("mode").isin("bus", "ferry"), F.col("mode").isin(*GUIDED), F.col("n")
    share_of = lambda c: F.coalesce(c / n, F.lit(0.0))

    at = at.select(*dpk, "mode", "express", "n", "has_name", F.explode(F.array(*(F.struct(F.lit(float(radii[i])).alias("r"), F.col(f"b_{i}").alias("best"), *(F.col(f"{w}_{i}").alias(w) for w in ways)) for i in each))).alias("z")).select(*dpk, "mode", "express", "n", "has_name", "z.*")
    at = at.withColumn("share", F.explode(F.array(*(F.lit(float(s)) for s in shares))))
    at = at.withColumn("by_name", F.coalesce("has_name", F.lit(False)) & (~loose | (share_of(F.col("name.n")) >= HOMONYM_SHARE)))
    at = at.withColumn("renamed", ~F.col("by_name") & F.coalesce(F.col("best") > 0, F.lit(False)) & (share_of(F.col("best")) >= F.col("share")))
    at = at.withColumn("matched", F.col("by_name") | F.col("renamed"))
    at = at.withColumn("of", F.when(guided & F.col("matched"), F.col("track")).when(guided, F.col("wide")).when(F.col("by_name"), F.col("name")).when(F.col("renamed"), F.col("shape")))
    points = cut(at.select(*dpk, "mode", "express", "n", "r", "share", "matched", "renamed", F.coalesce("of.n", F.lit(0).cast("long")).alias("covered"), "of.first", "of.last"))
    # Networks are few: a window over each would put one in a task, an aggregate and a join don't.
    status = points.groupBy(*on, "network", "r", "share").agg((F.count_if("matched") * 2 >= F.count("*")).alias("testable"))
    cuts = guided | ((F.col("mode") == "bus") & F.coalesce(F.col("express"), F.lit(False)))
    start = lambda k: F.when(cuts & (F.coalesce(F.col("first") - 1, n) >= k), F.coalesce("first", n + 1)).otherwise(1)
    end = lambda k: F.when(cuts & (F.coalesce(n - F.col("last"), n) >= k), F.coalesce(F.col("last"), F.lit(0))).otherwise(n)
    rows = points.join(status, [*on, "network", "r", "share"])
    rows = rows.select(*rows.columns, F.explode(F.array(*(F.struct(F.lit(int(k)).alias("k"), start(k).cast("long").alias("start_idx"), end(k).cast("long").alias("end_idx")) for k in ks))).alias("z")).select(*rows.columns, "z.*")
    left = F.greatest(F.lit(0), F.col("end_idx") - F.col("start_idx") + 1)
    # All covered stops lie between the first and the last, so cutting loses none.
    remaining = F.coalesce(safe_div(F.col("covered"), left), F.lit(0.0))
    rows = rows.withColumns({"_left": left, "_remaining": remaining}).withColumn("theta", F.explode(F.array(*(F.lit(float(t)) for t in thetas))))
    whole = F.when(F.col("renamed"), "kept-renamed").otherwise("kept")
    loosely = F.when(F.col("_remaining") >= LOOSE_SHARE, whole).otherwise("dropped")
    strictly = F.when((F.col("_left") < 2) | (F.col("_remaining") < F.col("theta")), "dropped").when(F.col("_left") < n, "cut").otherwise(whole)
    outcome = F.when(~F.col("testable"), "not-testable").when(~cuts, loosely).otherwise(strictly)
    return rows.select(*dpk, "mode", "r", "share", "k", "theta", "n", "covered", "start_idx", "end_idx", outcome.alias("outcome"))


def scores(predicted: Column, actual: Column) -> dict[str, Column]:
    """Confusion counts as aggregates, and precision, recall, F1 and accuracy of them."""
    n = lambda c: F.count(F.when(c, 1))
    tp, fp, fn, tn = n(predicted & actual), n(predicted & ~actual), n(~predicted & actual), n(~predicted & ~actual)
    return {"tp": tp, "fp": fp, "fn": fn, "tn": tn, "precision": safe_div(tp, tp + fp), "recall": safe_div(tp, tp + fn), "f1": safe_div(2 * tp, 2 * tp + fp + fn), "accuracy": safe_div(tp + tn, tp + fp + fn + tn)}


def presence(*sources: Column, default: str = "keep") -> Column:
    """The first source that says anything, in the order of precedence."""
    return F.coalesce(*sources, F.lit(default))


def narrow(edits: DataFrame, keys: Sequence[str], start: str, end: str) -> DataFrame:
    """Several edits of one chain to one index range, the narrowest."""
    return edits.groupBy(*keys).agg(F.max(start).alias(start), F.min(end).alias(end))


def unique_match(candidates: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows whose key has exactly one candidate."""
    return candidates.withColumn("_n", F.count("*").over(W.partitionBy(*keys))).where("_n = 1").drop("_n")


def match_openings(lines: DataFrame, candidates: DataFrame, refs: DataFrame) -> DataFrame:
    """(rec_id, network, key, candidate, pos, how): one row for every line, how being exact, stop-confirmed, ambiguous or none.

    lines: (rec_id, opening, network, key, families, hints); candidates: one row
    per opening (opening, network, families, names, candidate); refs: (network,
    key, opening, pos), an opening's references once each.

    A line takes the one opening of its network that has its key; of several,
    the one where any hint lies in a stop's name. Without it, it takes the one
    opening of its network and mode family whose names have every hint, which
    has no place. An opening's own names are no evidence for it.
    """
    other = F.col("l.opening") != F.col("c.opening")
    found = lambda h: F.exists("names", lambda n: F.contains(n, h))
    c = candidates.alias("c")
    pick = F.struct("candidate", "pos")
    named = lines.alias("l").join(refs.withColumnRenamed("opening", "of").alias("r"), ["network", "key"]).join(c, F.col("of") == F.col("c.opening"))
    by_stop = other & F.exists("hints", found)
    per = named.groupBy("rec_id").agg(F.count("*").alias("n"), F.min(pick).alias("one"), F.count(F.when(by_stop, 1)).alias("n_stop"), F.min(F.when(by_stop, pick)).alias("stop"))
    by_name = lines.join(per, "rec_id", "left").withColumns({"n": F.coalesce("n", F.lit(0)), "n_stop": F.coalesce("n_stop", F.lit(0))})
    open_ = by_name.where("n != 1 and n_stop != 1 and size(hints) > 0").select("rec_id", "opening", "network", "families", "hints")
    every = open_.alias("l").join(c, (F.col("l.network") == F.col("c.network")) & other & F.arrays_overlap("l.families", "c.families")).where(F.forall("hints", found))
    last = every.groupBy("rec_id").agg(F.count("*").alias("n_all"), F.min("candidate").alias("all"))
    one, stop, last_one = F.col("n") == 1, F.col("n_stop") == 1, F.coalesce(F.col("n_all") == 1, F.lit(False))
    take = lambda f, tail: F.when(one, F.col(f"one.{f}")).when(stop, F.col(f"stop.{f}")).when(last_one, tail)
    how = F.when(one, "exact").when(stop | last_one, "stop-confirmed").when(F.col("n") > 1, "ambiguous").otherwise("none")
    return by_name.join(last, "rec_id", "left").select("rec_id", "network", "key", take("candidate", F.col("all")).alias("candidate"), take("pos", F.lit(None)).alias("pos"), how.alias("how"))


def review_lists(lines: DataFrame, share: str, gate: float) -> DataFrame:
    """Adds `list`: automatic from the gate's share of covered stops on, else review; an unknown share is reviewed."""
    return lines.withColumn("list", F.when(F.col(share) >= gate, "automatic").otherwise("review"))


def severity(reason: Column, worst_first: Sequence[str]) -> Column:
    """Place of a reason in the order of severity; others come last."""
    return F.coalesce(*(F.when(reason == r, F.lit(i)) for i, r in enumerate(worst_first)), F.lit(len(worst_first)))


# What a change that a state takes back makes of a line.
INSTRUCTIONS = {"new_line": "drop", "reopening": "drop", "extension": "cut", "new_station": "new_station"}


def edit_instruction(state: Column, change: Column) -> Column:
    """drop, cut or new_station where the state is `remove` and the change is known; else null."""
    return F.when(state == "remove", code_map(change, INSTRUCTIONS))


def area_coverage(authorities: DataFrame, sources: DataFrame, source: str, alone: int = 1) -> DataFrame:
    """(authority, coverage, feeds) of every authority, from the feeds' JSON lists of areas.

    dedicated where a feed of at most `alone` areas names the authority, else
    indirect where any does, else uncovered. Lists that are no JSON name none.
    """
    areas = sources.select(source, F.array_distinct(F.from_json("areas", "array<string>")).alias("_areas"))
    named = areas.select(source, F.size("_areas").alias("_n"), F.explode("_areas").alias("authority"))
    per = named.groupBy("authority").agg(F.min("_n").alias("_least"), F.count_distinct(source).alias("feeds"))
    coverage = F.when(F.col("_least") <= alone, "dedicated").when(F.col("_least").isNotNull(), "indirect").otherwise("uncovered")
    return authorities.join(per, "authority", "left").select("authority", coverage.alias("coverage"), F.coalesce("feeds", F.lit(0).cast("long")).alias("feeds"))


def name_matches(lines: DataFrame, relations: DataFrame) -> DataFrame:
    """(line, affiliation, relations, first): relations that have a line's key, those of its own network where there are any, else all.

    lines: (line, key, network); relations: (relation, key, network). An empty
    or null key matches nothing. Counts per key and network meet, never pairs,
    so a key that most relations share is one row.
    """
    have = relations.where("key != ''").groupBy("key", "network").agg(F.count_distinct("relation").alias("n"), F.min("relation").alias("first"))
    own = have.select("key", "network", F.col("n").alias("own_n"), F.col("first").alias("own_first"))
    every = relations.where("key != ''").groupBy("key").agg(F.count_distinct("relation").alias("all_n"), F.min("relation").alias("all_first"))
    x = lines.join(own, ["key", "network"], "left").join(every, "key", "left")
    mine = F.col("own_n").isNotNull()
    return x.select("line", F.when(mine, 1).when(F.col("all_n").isNotNull(), 0).alias("affiliation"), F.coalesce("own_n", "all_n", F.lit(0).cast("long")).alias("relations"), F.coalesce("own_first", "all_first").alias("first"))


def upsert(old: DataFrame, new: DataFrame, key: str, columns: Sequence[str], keep_if_same: str, kept: Sequence[str]) -> DataFrame:
    """Records refreshed by id; `kept` columns stay where `keep_if_same` did not change, and are null where it did."""
    o, n = old.alias("o"), new.alias("n")
    same = F.col(f"o.{keep_if_same}").eqNullSafe(F.col(f"n.{keep_if_same}")) | F.col(f"n.{key}").isNull()
    return o.join(n, F.col(f"o.{key}") == F.col(f"n.{key}"), "full_outer").select(
        F.coalesce(f"o.{key}", f"n.{key}").alias(key),
        *(F.when(F.col(f"n.{key}").isNotNull(), F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")).alias(c) for c in columns),
        *(F.when(same, F.col(f"o.{c}")).alias(c) for c in kept),
    )
