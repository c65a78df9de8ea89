"""Survey days: classification, legs and energy, scopes, tours, day summaries, audits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomway.functions import energy as en
from loomway.functions import modes as md
from loomway.functions.exprs import finite, iso_weekday, norm_key, safe_div
from loomway.operators import chains, legs
from loomway.operators.relational import first_per_key
from loomway.queries.base import DAYS, TRIP_ORDER, TRIPS, days, key_sql, registry, trips
from loomway.tables import table

QUERIES, SQL, query = registry()

# --- SQL pieces


def _in(values) -> str:
    return "(" + ", ".join(f"'{v}'" if isinstance(v, str) else str(v) for v in values) + ")"


def _case(col: str, mapping: dict) -> str:
    lit = lambda v: f"'{v}'" if isinstance(v, str) else f"{v!r}::double"
    key = lambda k: f"'{k}'" if isinstance(k, str) else f"{k}"
    return f"case {col} " + " ".join(f"when {key(k)} then {lit(v)}" for k, v in mapping.items()) + " end"


def _density(end: str) -> str:
    s, t = f"uu_status_{end}", "tuu_res"
    return f"case when {s} = 'R' then 'very_sparse' when {s} = 'I' then 'sparse' when {s} in ('C', 'B') and {t} in {_in(md.SMALL)} then 'sparse' when {s} = 'C' and {t} in {_in(md.LARGE)} then 'dense' else 'intermediate' end"


_MODE = """case when mtp is null or mtp = 9999 then 'other' when floor(mtp) = 1 then 'walk' when mtp in (2.1::double, 2.2::double) then 'cycle' when mtp in (3.1::double, 3.3::double) then 'car_driver'
    when mtp = 3.2::double and coalesce(maccomphm, 0) > 0 and coalesce(maccompm, 0) = 0 then 'car_passenger_carpool' when mtp = 3.2::double then 'car_passenger_household'
    when mtp in (5.1::double, 5.2::double, 5.3::double, 5.4::double, 5.5::double, 5.6::double, 5.7::double) then 'urban_pt' when mtp in (5.8::double, 5.9::double) or floor(mtp) = 6 then 'train' else 'other' end"""
_VEHICLE = "case " + " ".join(f"when mtp = {k}::double then '{v}'" for k, v in md.VEHICLES.items()) + " end"
_CLASSIFIED = f"{TRIPS}, classified as (select *, {_MODE} as mode_group, {_VEHICLE} as vehicle, {_density('ori')} as density_ori, {_density('des')} as density_des, {_density('res')} as residence_density from trips)"


@query(f"with {_CLASSIFIED} select mode_group, vehicle, density_ori, count(*) as trips, count(distinct day_id) as days from classified group by all")
def s_mode_density(spark: SparkSession, folder: str) -> DataFrame:
    """Trips by mode class, vehicle and density of origin."""
    rows = legs.classify(trips(spark, folder))
    return rows.groupBy("mode_group", "vehicle", "density_ori").agg(F.count("*").alias("trips"), F.count_distinct("day_id").alias("days"))


@query(f"with {_CLASSIFIED} select coalesce(density_ori_grid, 'intermediate') as density_grid, density_ori as density_proxy, count(*) as trips from classified group by all")
def s_density_sources(spark: SparkSession, folder: str) -> DataFrame:
    """Density of origins by grid against the proxy."""
    t = trips(spark, folder)
    grid = legs.classify(t, "grid").select("ident_dep", F.col("density_ori").alias("density_grid"))
    proxy = legs.classify(t).select("ident_dep", F.col("density_ori").alias("density_proxy"))
    return grid.join(proxy, "ident_dep").groupBy("density_grid", "density_proxy").agg(F.count("*").alias("trips"))


# --- legs

_SPEEDS = f"""{_CLASSIFIED}, speeds as (select *, case when mode_group in {_in(md.CAR_MODES)} then 'car' when mode_group in ('walk', 'cycle') then mode_group end as speed_class,
    case when duration_min > 0 then distance_km_declared / (duration_min / 60) end as speed_kmh from classified),
    flags as (select *, coalesce(speed_kmh > case speed_class when 'walk' then 7.0 when 'cycle' then 35.0 when 'car' then 130.0 end, false) as flagged from speeds),
    medians as (select speed_class, quantile_cont(speed_kmh, 0.5) as median_kmh from flags where not flagged and speed_class is not null and speed_kmh is not null group by 1),
    corrected as (select f.*, m.median_kmh, case when flagged then duration_min / 60 * m.median_kmh else distance_km_declared end as distance_km from flags f left join medians m using (speed_class))"""


@query(f"with {_SPEEDS} select mode_group, count(*) as trips, count(*) filter (where flagged) as flagged, round(max(median_kmh), 6) as median_kmh, round(max(distance_km) filter (where flagged), 6) as longest_corrected_km from corrected group by 1")
def s_speed_correction(spark: SparkSession, folder: str) -> DataFrame:
    """Trips too fast for their mode and the distances they get instead."""
    rows = legs.corrected_distances(legs.classify(trips(spark, folder)))
    flagged = F.col("flagged")
    return rows.groupBy("mode_group").agg(F.count("*").alias("trips"), F.count(F.when(flagged, 1)).alias("flagged"), F.round(F.max("median_kmh"), 6).alias("median_kmh"), F.round(F.max(F.when(flagged, F.col("distance_km"))), 6).alias("longest_corrected_km"))


def _terminal(variant: str) -> str:
    access = lambda c: _case(c, {k: m / (en.WALK_SPEED_KMH / 3.6) / 60 for k, m in en.ACCESS_WALK_M.items()})
    away = _case("density_des", en.WALK_FROM_CAR_MIN)
    default = f"case when mode_group in ('car_driver', 'car_passenger_household') then {_case('density_ori', en.WALK_TO_CAR_MIN)} + {away} when mode_group = 'car_passenger_carpool' then {en.CARPOOL_WALK_MIN} + {away} when mode_group in ('urban_pt', 'train') then {access('density_ori')} + {access('density_des')} when mode_group = 'cycle' then 2.0::double end"
    wait = _case("vehicle", en.vehicle_tables("kh").wait_min)
    walk_used, wait_used = (default, wait) if variant == "defaults" else (f"coalesce(declared_walk_min, {default})", f"coalesce(declared_wait_min, {wait})")
    if variant == "declared_plus1":
        walk_used += f" + case when mode_group in {_in(legs.PLUS_ONE)} then 1.0 else 0.0 end"
    return f"terminal as (select *, {walk_used} as walk_min, {wait_used} as wait_min, {_case('density_des', en.PARKING_MIN)} as parking_min from corrected)"


def _energy_sql(rates: str, scale: float = 1.0, power: float | None = None) -> str:
    t = en.vehicle_tables(rates)
    wr = f"{en.MASS_KG * en.WALK_COST[rates] * (en.WALK_SPEED_KMH * 1000 / 60) / 1000!r}::double"
    st, si, dr = (f"{en.rate(x, rates)!r}::double" for x in ("standing", "sitting", "driving"))
    b = en.BIKE
    p0 = power or b["p0_w"]
    stop = 0.5 * (en.MASS_KG + b["mass"]) * legs.flat_bike_speed(power) ** 2 / b["efficiency"] / 1000
    ride_s = "coalesce(bike_ride_s, duration_min * 60)"
    k = f"{scale!r}::double"
    walk, wait, park, pool = f"({k} * walk_min)", f"({k} * wait_min)", f"({k} * parking_min)", f"({k} * 3.0)"
    car = lambda r: f"{wr} * {walk} + {r} * {park} + {r} * greatest(duration_min - {walk} - {park}, 0)"
    stairs_min = _case("vehicle", t.stairs_min)
    # DuckDB's greatest skips nulls as Spark's does.
    return f"""case when mode_group = 'walk' then {en.MASS_KG * en.WALK_COST[rates]!r}::double * distance_km
      when mode_group = 'cycle' then {p0 / b["efficiency"]!r}::double * {ride_s} / 1000 + {en.MET_MINUTE_KJ_PER_KG * en.MASS_KG!r}::double * {ride_s} / 60 + {st} * {walk} + distance_km * {stop * scale!r}::double
      when mode_group = 'car_driver' then {car(dr)} when mode_group = 'car_passenger_household' then {car(si)}
      when mode_group = 'car_passenger_carpool' then {wr} * {walk} + {st} * {pool} + {si} * {park} + {si} * greatest(duration_min - {walk} - {pool} - {park}, 0)
      when mode_group in ('urban_pt', 'train') then {wr} * {walk} + {st} * {wait} + {k} * {_case("vehicle", t.stairs_kj)} + {_case("vehicle", t.ride_kj_per_min)} * greatest(duration_min - {walk} - {wait} - {k} * {stairs_min}, 0) end"""


_LOST = "(walk_min * 60 + distance_km * ((distance_km * 1000 / nullif(duration_min * 60, 0)) * 3.0 + 8.75))"


def _legs_sql(variant: str, scale: float = 1.0, power: float | None = None) -> str:
    lost = f"{scale!r}::double * {_LOST}"
    v = "(distance_km * 1000 / bike_ride_s)"
    implied = f"{v} * ({en.MASS_KG * en.GRAVITY * en.BIKE['crr']!r}::double + {0.5 * en.BIKE['air'] * en.BIKE['cda']!r}::double * {v} * {v}) / {en.BIKE['drivetrain']!r}::double"
    return f"""{_SPEEDS}, {_terminal(variant)}, rides as (select *, case when mode_group = 'cycle' and duration_min > 0 and duration_min * 60 - {lost} >= greatest(60.0, 0.5 * duration_min * 60)
      and distance_km * 3600 / nullif(duration_min * 60 - {lost}, 0) <= 45 then duration_min * 60 - {lost} end as bike_ride_s from terminal),
      legs as (select *, {implied} as implied_power_w, {_energy_sql("kh", scale, power)} as energy_kh_kj, {_energy_sql("cp", scale, power)} as energy_cp_kj from rides)"""


_FINITE_TRIP = "isfinite(duration_min) and duration_min between 0 and 1440 and (distance_km_declared is null or isfinite(distance_km_declared))"


def _leg_stats(spark: SparkSession, folder: str, variant: str) -> DataFrame:
    ok = finite(F.col("duration_min")) & F.col("duration_min").between(0, 1440)
    rows = legs.trip_legs(trips(spark, folder), variant).where(ok & (F.col("distance_km_declared").isNull() | finite(F.col("distance_km_declared"))))
    return rows.groupBy("mode_group").agg(
        F.count("*").alias("trips"), F.count("bike_ride_s").alias("with_ride_time"), F.round(F.avg("walk_min"), 5).alias("walk_min"), F.round(F.avg("wait_min"), 5).alias("wait_min"),
        F.round(F.avg("energy_kh_kj"), 4).alias("energy_kh_kj"), F.round(F.avg("energy_cp_kj"), 4).alias("energy_cp_kj"), F.round(F.max("energy_kh_kj"), 4).alias("most_kh_kj"),
    )


def _leg_stats_sql(variant: str) -> str:
    return f"""with {_legs_sql(variant)} select mode_group, count(*) as trips, count(bike_ride_s) as with_ride_time, round(avg(walk_min), 5) as walk_min, round(avg(wait_min), 5) as wait_min,
      round(avg(energy_kh_kj), 4) as energy_kh_kj, round(avg(energy_cp_kj), 4) as energy_cp_kj, round(max(energy_kh_kj), 4) as most_kh_kj from legs where {_FINITE_TRIP} group by 1"""


@query(_leg_stats_sql("declared"))
def s_legs_declared(spark: SparkSession, folder: str) -> DataFrame:
    """Leg pipeline with declared terminal minutes: means per mode."""
    return _leg_stats(spark, folder, "declared")


@query(_leg_stats_sql("declared_plus1"))
def s_legs_declared_plus1(spark: SparkSession, folder: str) -> DataFrame:
    return _leg_stats(spark, folder, "declared_plus1")


@query(_leg_stats_sql("defaults"))
def s_legs_defaults(spark: SparkSession, folder: str) -> DataFrame:
    return _leg_stats(spark, folder, "defaults")


@query(
    f"""with {_legs_sql("declared")}, per as (select day_id, min(age_band) as age_band, count(*) as trips_per_day, sum(duration_min) as t, sum(energy_kh_kj) as e, list_sort(list_distinct(list(mode_group) filter (where mode_group <> 'walk'))) as modes from legs where {_FINITE_TRIP} group by day_id)
    select day_id, age_band, trips_per_day, round(t, 6) as total_time_min, round(e, 4) as total_energy_kh_kj, coalesce(array_to_string(modes, ','), '') as non_walk_modes,
    case when coalesce(len(modes), 0) = 0 then 'walking_only' when len(modes) = 1 then modes[1] else 'multimodal' end as day_mode_group from per"""
)
def s_day_summary(spark: SparkSession, folder: str) -> DataFrame:
    """One row per described day, from the legs."""
    ok = finite(F.col("duration_min")) & F.col("duration_min").between(0, 1440) & (F.col("distance_km_declared").isNull() | finite(F.col("distance_km_declared")))
    d = legs.day_summary(legs.trip_legs(trips(spark, folder)).where(ok))
    return d.select("day_id", "age_band", "trips_per_day", F.round("total_time_min", 6).alias("total_time_min"), F.round("total_energy_kh_kj", 4).alias("total_energy_kh_kj"), F.array_join("non_walk_modes", ",").alias("non_walk_modes"), "day_mode_group")


# --- scopes and tours

_SCOPED = f"""{_CLASSIFIED}, ends as (select day_id, arg_min(struct_pack(v := nullif(origin_purpose, '')), struct_pack(a := num_dep, b := ident_dep)).v as first_origin, arg_min(struct_pack(v := moridom), struct_pack(a := num_dep, b := ident_dep)).v as first_moridom,
    arg_max(struct_pack(v := nullif(destination_purpose, '')), struct_pack(a := num_dep, b := ident_dep)).v as last_destination from classified group by day_id),
    day_flags as (select *, coalesce(case when first_origin is null or first_origin = '9999' then first_moridom = 1 else first_origin in ('1.1', '1.2', '1.3') end, false) as starts_at_residence,
      coalesce(last_destination in ('1.1', '1.2', '1.3'), false) as ends_at_residence from ends),
    stays as (select *, case when lead(departure_s) over o is not null and arrival_s is not null then ((lead(departure_s) over o - arrival_s + 86400) % 86400 + 86400) % 86400 / 60.0::double end as stay_min from classified window o as (partition by day_id order by num_dep, ident_dep)),
    acts as (select *, coalesce(mode_group in ('walk', 'cycle') and (destination_motive in (7.7::double, 7.8::double) or (destination_motive = 7.6::double and stay_min < 15)), false) as outward_activity from stays),
    props as (select *, lag(outward_activity, 1, false) over (partition by day_id order by num_dep, ident_dep) as prior_activity from acts),
    scoped as (select p.*, starts_at_residence, ends_at_residence, starts_at_residence and ends_at_residence as is_round,
      not (coalesce(motive in (8.1::double, 8.2::double, 8.3::double, 8.4::double), false) or coalesce(destination_purpose in ('9.4', '9.95'), false) or outward_activity or (coalesce(destination_purpose in ('1.1', '1.2', '1.3'), false) and prior_activity)) as is_destination
      from props p join day_flags d using (day_id))"""


def _scope_sql(scope: str) -> str:
    d, p, x = scope.split("-")
    return " and ".join(["true", *["is_round"] * (d == "round"), *["is_destination"] * (p == "dest"), *["coalesce(mobloc = 1, false)"] * (x == "local")])


def _scoped(spark: SparkSession, folder: str) -> DataFrame:
    return chains.scope_trips(legs.classify(trips(spark, folder)), TRIP_ORDER)


@query(f"with {_SCOPED} select day_id, first_origin, last_destination, starts_at_residence, ends_at_residence, starts_at_residence and ends_at_residence as is_round from day_flags")
def s_scope_days(spark: SparkSession, folder: str) -> DataFrame:
    """Round-trip flags of each day."""
    d = chains.scope_days(trips(spark, folder), TRIP_ORDER)
    return d.select("day_id", "first_origin", "last_destination", "starts_at_residence", "ends_at_residence", "is_round")


@query(f"with {_SCOPED} select ident_dep, round(stay_min, 6) as stay_min, outward_activity, prior_activity, is_destination, is_round from scoped")
def s_scope_trips(spark: SparkSession, folder: str) -> DataFrame:
    """Stays, activity and destination flags of each trip."""
    return _scoped(spark, folder).select("ident_dep", F.round("stay_min", 6).alias("stay_min"), "outward_activity", "prior_activity", "is_destination", "is_round")


@query(f"with {_SCOPED} " + " union all ".join(f"select '{s}' as scope, count(*) as trips, count(distinct day_id) as days from scoped where {_scope_sql(s)}" for s in chains.SCOPES))
def s_eight_scopes(spark: SparkSession, folder: str) -> DataFrame:
    """Trips and days of the eight scopes, in one pass."""
    rows = _scoped(spark, folder)
    hit = F.array(*(F.when(chains.scope_filter(s), F.lit(s)) for s in chains.SCOPES))
    return rows.withColumn("scope", F.explode(F.filter(hit, lambda x: x.isNotNull()))).groupBy("scope").agg(F.count("*").alias("trips"), F.count_distinct("day_id").alias("days"))


@query(f"with {_SCOPED} select mode_group, count(*) as trips from classified t where exists (select 1 from scoped s where s.ident_dep = t.ident_dep and {_scope_sql('round-dest-local')}) group by 1")
def s_scope_semi_join(spark: SparkSession, folder: str) -> DataFrame:
    """Trips of one scope, selected by a semi join on the scope's own trips."""
    t = legs.classify(trips(spark, folder))
    keep = _scoped(spark, folder).where(chains.scope_filter("round-dest-local")).select("ident_dep")
    return t.join(keep, "ident_dep", "left_semi").groupBy("mode_group").agg(F.count("*").alias("trips"))


_TOURS = f"""{_SCOPED}, numbered as (select *, coalesce(sum(case when destination_purpose in ('1.1', '1.2', '1.3') then 1 else 0 end) over (partition by day_id order by num_dep, ident_dep rows between unbounded preceding and 1 preceding), 0)::bigint as tour_id, {_scope_sql("round-dest-local")} as selected from scoped),
    sizes as (select day_id, tour_id, count(*) as tour_size, bool_and(selected) and (tour_id > 0 or bool_and(starts_at_residence)) and arg_max(struct_pack(v := coalesce(destination_purpose in ('1.1', '1.2', '1.3'), false)), struct_pack(a := num_dep, b := ident_dep)).v as is_complete from numbered group by day_id, tour_id)"""


@query(f"with {_TOURS} select ident_dep, tour_id, tour_size, is_complete from numbered join sizes using (day_id, tour_id)")
def s_tours(spark: SparkSession, folder: str) -> DataFrame:
    """Tour of each trip."""
    t = chains.tours(_scoped(spark, folder), TRIP_ORDER, chains.scope_filter("round-dest-local"))
    return t.select("ident_dep", F.col("tour_id").cast("long").alias("tour_id"), "tour_size", "is_complete")


RULE_SQL = """case when coalesce(motive in (8.1::double, 8.2::double, 8.3::double, 8.4::double), false) then 'holiday' when coalesce(destination_purpose in ('9.4', '9.95'), false) then 'round' when outward_activity then 'activity'
    when coalesce(destination_purpose in ('1.1', '1.2', '1.3'), false) and prior_activity then 'return' else 'none' end"""


def rule():
    """Which rule, the first that applies, takes a trip of scope_trips() out."""
    falsy = lambda c: F.coalesce(c, F.lit(False))
    return F.when(falsy(F.col("motive").isin(*md.HOLIDAY)), "holiday").when(falsy(F.col("destination_purpose").isin(*md.PROFESSIONAL_ROUND)), "round").when(F.col("outward_activity"), "activity").when(falsy(F.col("destination_purpose").isin(*md.RESIDENCE)) & F.col("prior_activity"), "return").otherwise("none")


@query(
    f"""with {_SCOPED}, ruled as (select *, {RULE_SQL} as rule from scoped)
    select survey, mode_group, rule, grouping(survey)::int as all_surveys, grouping(mode_group)::int as all_modes, count(*) as trips, round(sum(pond_jour) filter (where isfinite(pond_jour)), 1) as weight from ruled group by grouping sets ((survey, mode_group, rule), (survey, rule), (mode_group, rule), (rule))"""
)
def s_rule_attribution(spark: SparkSession, folder: str) -> DataFrame:
    """Which rule, the first that applies, takes a trip out; by survey and mode with grouping sets."""
    rows = _scoped(spark, folder).withColumn("rule", rule())
    g = rows.groupingSets([["survey", "mode_group", "rule"], ["survey", "rule"], ["mode_group", "rule"], ["rule"]], "survey", "mode_group", "rule")
    return g.agg(F.grouping("survey").cast("int").alias("all_surveys"), F.grouping("mode_group").cast("int").alias("all_modes"), F.count("*").alias("trips"), F.round(F.sum(F.when(finite(F.col("pond_jour")), F.col("pond_jour"))), 1).alias("weight"))


# --- universes and audits


@query(f"with {TRIPS} select survey, count(distinct ident_ind) as respondents, count(distinct ident_ind) filter (where age >= 15) as eligible, count(distinct ident_ind) filter (where age < 15) as under, count(distinct ident_ind) filter (where age is null) as no_age from trips group by 1")
def s_age_universe(spark: SparkSession, folder: str) -> DataFrame:
    """Audit of an age limit."""
    n = lambda c, a: F.count_distinct(F.when(c, F.col("ident_ind"))).alias(a)
    return trips(spark, folder).groupBy("survey").agg(F.count_distinct("ident_ind").alias("respondents"), n(F.col("age") >= 15, "eligible"), n(F.col("age") < 15, "under"), n(F.col("age").isNull(), "no_age"))


_PERSONS = f"persons as (select k, rg, pondki, mdatenq2v, v2_datesemref, v2_mobilref from (select *, {key_sql('ident_ind')} as k, row_number() over (partition by {key_sql('ident_ind')} order by rec_id) as rn from k_individu) where k is not null and rn = 1)"


def _persons(spark: SparkSession, folder: str) -> DataFrame:
    df = table(spark, folder, "k_individu").withColumn("k", norm_key(F.col("ident_ind"))).where("k is not null")
    return first_per_key(df, ["k"], ["rec_id"]).select("k", "rg", "pondki", "mdatenq2v", "v2_datesemref", "v2_mobilref")


@query(f"with {_PERSONS} select v2_mobilref, count(*) as persons, round(sum(pondki) filter (where isfinite(pondki)), 1) as weight from persons p where not exists (select 1 from k_deploc d where {key_sql('d.ident_ind')} = p.k and d.v2_dvo_loc > 5) group by 1")
def s_non_travellers(spark: SparkSession, folder: str) -> DataFrame:
    """Persons without a trip of more than five kilometres: an anti join."""
    far = table(spark, folder, "k_deploc", "ident_ind", "v2_dvo_loc").where("v2_dvo_loc > 5").select(norm_key(F.col("ident_ind")).alias("k"))
    return _persons(spark, folder).join(far, "k", "left_anti").groupBy("v2_mobilref").agg(F.count("*").alias("persons"), F.round(F.sum(F.when(finite(F.col("pondki")), F.col("pondki"))), 1).alias("weight"))


@query(f"with {TRIPS}, d as (select day_id, any_value(pond_jour) as w, count(*) filter (where mobloc = 1) as local from trips where isfinite(pond_jour) group by 1) select substr(day_id, 1, 1) as survey, count(*) as days, count(*) filter (where local = 0) as no_local, round(sum(w) filter (where local = 0) / sum(w), 8) as weighted_share from d group by 1")
def s_zero_local_days(spark: SparkSession, folder: str) -> DataFrame:
    """Days with trips but none local."""
    d = trips(spark, folder).where(finite(F.col("pond_jour"))).groupBy("day_id").agg(F.any_value("pond_jour", True).alias("w"), F.count(F.when(F.col("mobloc") == 1, 1)).alias("local"))
    none = F.col("local") == 0
    return d.groupBy(F.substring("day_id", 1, 1).alias("survey")).agg(F.count("*").alias("days"), F.count(F.when(none, 1)).alias("no_local"), F.round(safe_div(F.sum(F.when(none, F.col("w"))), F.sum("w")), 8).alias("weighted_share"))


_DAYS7 = ("monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday")


@query("select rec_id, day, flag, ((day + 2) % 7 + 1)::int as day_shifted from (" + " union all ".join(f"select rec_id, {i + 1} as day, {d} as flag from calendar" for i, d in enumerate(_DAYS7)) + ")")
def s_weekday_unpivot(spark: SparkSession, folder: str) -> DataFrame:
    """Seven flags to seven rows, with weekday arithmetic modulo 7."""
    c = table(spark, folder, "calendar", "rec_id", *_DAYS7)
    rows = c.select("rec_id", F.explode(F.arrays_zip(F.array(*(F.lit(i) for i in range(1, 8))).alias("day"), F.array(*(F.col(d) for d in _DAYS7)).alias("flag"))).alias("z"))
    return rows.select("rec_id", F.col("z.day").alias("day"), F.col("z.flag").alias("flag"), (F.pmod(F.col("z.day") + 2, F.lit(7)) + 1).cast("int").alias("day_shifted"))


@query("""with m as (select rec_id, trancherevenumensuel as label, list_transform(regexp_extract_all(split_part(trancherevenumensuel, '(', 1), '[0-9]{1,3}(?: [0-9]{3})+|[0-9]+'), lambda x: try_cast(regexp_replace(x, ' ', '', 'g') as double)) as v, split_part(trancherevenumensuel, '(', 1) as head from q_tcm_menage)
    select rec_id, case when label is null or len(v) = 0 then null when contains(head, 'plus') then 1.5 * v[1] when len(v) = 1 then v[1] / 2 else (v[1] + v[2]) / 2 end as midpoint from m""")
def s_income_midpoint(spark: SparkSession, folder: str) -> DataFrame:
    """Income bracket texts to their midpoints."""
    return table(spark, folder, "q_tcm_menage", "rec_id", "trancherevenumensuel").select("rec_id", md.income_midpoint(F.col("trancherevenumensuel")).alias("midpoint"))


@query(f"with {_PERSONS} select rg, isodow(strptime(mdatenq2v, '%d/%m/%Y'))::int as weekday, date_diff('day', try_strptime(v2_datesemref, '%d/%m/%Y')::date, try_strptime(mdatenq2v, '%d/%m/%Y')::date)::int as lag_days, count(*) as persons from persons where regexp_full_match(mdatenq2v, '[0-9]{{2}}/[0-9]{{2}}/[0-9]{{4}}') and try_strptime(mdatenq2v, '%d/%m/%Y') is not null group by all")
def s_recall_lag(spark: SparkSession, folder: str) -> DataFrame:
    """Weekday of the interview and days since the reference date."""
    p = _persons(spark, folder)
    as_date = lambda c: F.expr(f"try_to_date({c}, 'dd/MM/yyyy')")
    rows = p.where(F.col("mdatenq2v").rlike(r"\A[0-9]{2}/[0-9]{2}/[0-9]{4}\z")).withColumns({"d": as_date("mdatenq2v"), "r": as_date("v2_datesemref")}).where("d is not null")
    return rows.groupBy("rg", iso_weekday(F.col("d")).cast("int").alias("weekday"), F.datediff("d", "r").alias("lag_days")).agg(F.count("*").alias("persons"))


# --- calibration and crosswalks

_CAL = f"{_SPEEDS}, ok as (select * from corrected where isfinite(pond_jour) and {_FINITE_TRIP} and mode_group in ('walk', 'cycle') and distance_km is not null and duration_min > 0)"


@query(f"with {_CAL} select mode_group, coalesce(age_band, 'unknown') as band, count(*) as trips, round(60 * sum(pond_jour * distance_km) / nullif(sum(pond_jour * duration_min), 0), 6) as speed_kmh from ok group by all")
def s_speed_calibration(spark: SparkSession, folder: str) -> DataFrame:
    """Speeds as ratios of weighted sums, by age band."""
    rows = legs.corrected_distances(legs.classify(trips(spark, folder))).where(finite(F.col("pond_jour")) & finite(F.col("duration_min")) & F.col("duration_min").between(0, 1440) & finite(F.col("distance_km_declared")) & F.col("mode_group").isin("walk", "cycle") & F.col("distance_km").isNotNull() & (F.col("duration_min") > 0))
    w = F.col("pond_jour")
    return rows.groupBy("mode_group", F.coalesce("age_band", F.lit("unknown")).alias("band")).agg(F.count("*").alias("trips"), F.round(60 * safe_div(F.sum(w * F.col("distance_km")), F.sum(w * F.col("duration_min"))), 6).alias("speed_kmh"))


@query(f"with {_CLASSIFIED} select floor(motive)::bigint as motive_group, mode_group, count(*) as trips, round(count(*) / sum(count(*)) over (partition by floor(motive)), 8) as share from classified where motive is not null group by floor(motive), mode_group")
def s_motive_mode_matrix(spark: SparkSession, folder: str) -> DataFrame:
    """Motive groups against modes, with shares within the motive."""
    from pyspark.sql import Window as W

    rows = legs.classify(trips(spark, folder)).where("motive is not null").groupBy(F.floor("motive").alias("motive_group"), "mode_group").agg(F.count("*").alias("trips"))
    return rows.withColumn("share", F.round(F.col("trips") / F.sum("trips").over(W.partitionBy("motive_group")), 8))


@query(f"with {DAYS} select survey, band, count(*) as days, round(sum(w * x) / sum(w), 6) as mean_min, round(sum(w * n) / sum(w), 6) as mean_trips, round(sum(w * e) filter (where isfinite(e)) / sum(w) filter (where isfinite(e)), 4) as mean_kj from days group by all")
def s_group_means(spark: SparkSession, folder: str) -> DataFrame:
    """Weighted means of days as ratios of weighted sums."""
    w, ok = F.col("w"), finite(F.col("e"))
    return days(spark, folder).groupBy("survey", "band").agg(
        F.count("*").alias("days"), F.round(F.sum(w * F.col("x")) / F.sum("w"), 6).alias("mean_min"), F.round(F.sum(w * F.col("n")) / F.sum("w"), 6).alias("mean_trips"),
        F.round(safe_div(F.sum(F.when(ok, w * F.col("e"))), F.sum(F.when(ok, w))), 4).alias("mean_kj"),
    )


# --- formulas over a grid of inputs

_GRID = "grid as (select i::double as i, (i * 0.01 - 0.3)::double as g from range(0, 61) t(i))"


def _grid(spark: SparkSession) -> DataFrame:
    return spark.range(61).select(F.col("id").cast("double").alias("i"), (F.col("id") * 0.01 - 0.3).cast("double").alias("g"))


@query(
    f"""with {_GRID} select i, round(4.8 / 3.6 * exp(-3.5 * abs(g + 0.05)) / exp(-0.175), 8) as walk_speed, round((((((280.5 * g - 58.7) * g - 76.8) * g + 51.9) * g + 19.6) * g + 2.5) / 2.5, 8) as walk_factor,
    round(74 * 9.81 * i / 0.3 / 1000, 6) as stairs_up_kj, round(74 * 9.81 * i / 0.3 / 1000 * 0.3333333333, 6) as stairs_down_kj, round(case when i <= 12 then i / 2 * (1 + 0.45 * 0.45) else 4 end, 8) as wait_min,
    round((1 - greatest(0, 1 - 1 / (0.5 + i / 20))) * 1.5 + greatest(0, 1 - 1 / (0.5 + i / 20)) * (2.6 + 4.1 * greatest(0, least(1, ((0.5 + i / 20) - 1) / 2))), 8) as ride_rate, round(4.2 + 3.8 * greatest(0, least(1, i / 20 - 1)), 8) as driving_rate,
    round(greatest(0, least(300, 100 * (1 + 10 * g))), 8) as power_w, round(i / 10 * (89 * 9.81 * (0.006 * cos(atan(g)) + sin(atan(g))) + 0.33 * i / 10 * i / 10) / 0.976, 6) as required_w, round(0.5 * 89 * i * i / 0.24 / 1000, 6) as stop_kj, round(i + 8.75 + i / 0.5, 6) as stop_s,
    round((89 * 9.81 * 100 * (0.006 * cos(atan(g)) + sin(atan(g))) + 0.33 * 25 * 100) / 0.24 / 1000 + 0.0732 * 74 * 20 / 60, 6) as ride_kj from grid"""
)
def e_formulas(spark: SparkSession, folder: str) -> DataFrame:
    """Walking, stairs, waiting, riding, driving and cycling formulas over a grid of inputs."""
    i, g = F.col("i"), F.col("g")
    load = 0.5 + i / 20
    cols = {
        "walk_speed": (en.walking_speed(g, F.lit(4.8 / 3.6)), 8), "walk_factor": (en.gradient_factor(g), 8), "stairs_up_kj": (en.stairs_energy_kj(i, F.lit(True)), 6), "stairs_down_kj": (en.stairs_energy_kj(i, F.lit(False)), 6),
        "wait_min": (en.expected_wait_min(i, F.lit(0.45)), 8), "ride_rate": (en.ride_rate(load, F.lit(3.0)), 8), "driving_rate": (en.driving_rate(i / 20), 8), "power_w": (en.power_by_slope_w(g, 100.0, 10.0, 300.0), 8),
        "required_w": (en.required_power_w(i / 10, g, F.lit(89.0)), 6), "stop_kj": (en.stop_energy_kj(i, F.lit(89.0)), 6), "stop_s": (en.stop_time_s(i), 6), "ride_kj": (en.bike_ride_energy_kj(F.lit(100.0), g, F.lit(5.0), F.lit(89.0), F.lit(20.0)), 6),
    }
    return _grid(spark).select("i", *(F.round(c, n).alias(k) for k, (c, n) in cols.items()))


@query(f"with {TRIPS}, segs as (select day_id, sum(distance_km_declared * 1000 / (4.8 / 3.6 * exp(-3.5 * abs((num_dep % 7 - 3) * 0.02 + 0.05)) / exp(-0.175))) as t from trips where isfinite(distance_km_declared) and num_dep is not null group by 1) select day_id, round(t, 3) as walk_s from segs")
def e_walking_leg(spark: SparkSession, folder: str) -> DataFrame:
    """Time of a walking leg over ordered segments, by a fold over an array."""
    t = trips(spark, folder).where(finite(F.col("distance_km_declared")) & F.col("num_dep").isNotNull())
    seg = F.struct((F.col("distance_km_declared") * 1000).alias("length_m"), ((F.col("num_dep") % 7 - 3) * 0.02).cast("double").alias("gradient"))
    return t.groupBy("day_id").agg(F.collect_list(seg).alias("s")).select("day_id", F.round(en.walking_leg(F.col("s"))["time_s"], 3).alias("walk_s"))


_BIKE = en.BIKE
_DRAG = 0.5 * _BIKE["air"] * _BIKE["cda"]


def _speed_sql(power: str, mass: float) -> str:
    """The positive root of v^3 + p v + q by Cardano's formula, or by cosines where there are three real ones."""
    p, q = f"({mass * en.GRAVITY / _DRAG!r}::double * ({_BIKE['crr']!r} * cos(atan(g)) + sin(atan(g))))", f"(-({power}) * {_BIKE['drivetrain'] / _DRAG!r}::double)"
    d = f"({q} * {q} / 4 + {p} * {p} * {p} / 27)"
    return f"case when {d} >= 0 then greatest(0, cbrt(-{q} / 2 + sqrt(greatest({d}, 0))) + cbrt(-{q} / 2 - sqrt(greatest({d}, 0)))) else 2 * sqrt(greatest(-{p} / 3, 0)) * cos(acos(greatest(-1.0, least(1.0, 3 * {q} / (2 * {p}) * sqrt(greatest(-3 / {p}, 0))))) / 3) end"


_NEED = lambda v: f"greatest(0, {v} * ({97.0 * en.GRAVITY!r}::double * ({_BIKE['crr']!r} * cos(atan(g)) + sin(atan(g))) + {_DRAG!r}::double * {v} * {v}) / {_BIKE['drivetrain']!r})"


@query(
    f"""with {_GRID}, r as (select i, g, greatest(0, least(250, 80 * (1 + 8 * g)))::double as rider, least(250, 1.5 * greatest(0, least(250, 80 * (1 + 8 * g))))::double as motor from grid), v as (select *, {_speed_sql("100.0", 89.0)} as speed, {_speed_sql("rider + motor", 97.0)} as v, {_speed_sql("rider", 97.0)} as alone, {25 / 3.6!r}::double as cap, {40 / 3.6!r}::double as down from r),
    c as (select i, g, speed, rider, down, case when v > cap and motor > 0 then greatest(alone, cap) else v end as v, case when v > cap and motor > 0 then case when alone >= cap then 0 else greatest(0, {_NEED("cap")} - rider) end else motor end as motor from v),
    f as (select i, speed, least(v, down) as v, case when v > down then least(rider, {_NEED("down")}) else rider end as rider, case when v > down then greatest(0, {_NEED("down")} - least(rider, {_NEED("down")})) else motor end as motor from c)
    select i, round(speed, 6) as speed, round(v, 6) as assisted_speed, round(rider, 4) as rider_w, round(motor, 4) as motor_w, round(case when rider + motor <= 0 then 1 else rider / (rider + motor) end, 6) as rider_share from f"""
)
def e_bike_speeds(spark: SparkSession, folder: str) -> DataFrame:
    """Speed on each gradient by the cubic force balance, and an assisted ride."""
    g = _grid(spark)
    lit = F.lit
    ride = en.ebike_ride("g", lit(80.0), lit(8.0), lit(250.0), lit(97.0), lit(1.5), lit(250.0), lit(25 / 3.6), lit(40 / 3.6))
    r = lambda c, n, k=6: F.round(c, k).alias(n)
    out = g.select("i", en.bike_speed(lit(100.0), F.col("g"), lit(89.0)).alias("speed"), ride.alias("r"))
    return out.select("i", r("speed", "speed"), r("r.speed", "assisted_speed"), r("r.rider_w", "rider_w", 4), r("r.motor_w", "motor_w", 4), r(en.rider_share(F.col("r.rider_w"), F.col("r.motor_w")), "rider_share"))
