"""Legs of survey trips: corrected distances, terminal minutes and energy above rest."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomway.functions import energy as en
from loomway.functions.exprs import code_map, safe_div
from loomway.functions.modes import CAR_MODES, SPEED_LIMIT_KMH, density_class, mode_group, vehicle

MIN_RIDE_S, MIN_RIDE_SHARE, MAX_BIKE_KMH = 60.0, 0.5, 45.0
PLUS_ONE = (*CAR_MODES, "cycle", "urban_pt")


def speed_class(mode: Column) -> Column:
    """walk, cycle or car: the classes whose declared speed has an upper bound; else null."""
    return F.when(mode.isin(*CAR_MODES), "car").when(mode.isin("walk", "cycle"), mode)


def classify(trips: DataFrame, density: str = "proxy") -> DataFrame:
    """Trips with mode_group, vehicle and the densities of origin, destination and residence (`grid` or `proxy`)."""
    place = lambda end: F.coalesce(F.col(f"density_{end}_grid"), F.lit("intermediate")) if density == "grid" else density_class(F.col(f"uu_status_{end}"), F.col("tuu_res"))
    return trips.withColumns({"mode_group": mode_group(F.col("mtp"), F.col("maccompm"), F.col("maccomphm")), "vehicle": vehicle(F.col("mtp")), "density_ori": place("ori"), "density_des": place("des"), "residence_density": place("res")})


def corrected_distances(classified: DataFrame) -> DataFrame:
    """Adds speed_kmh (declared), flagged, and distance_km.

    A trip faster than its class can be keeps its duration and takes the median
    speed of the class's other trips. The medians are one aggregate of three
    rows, joined back, not a window over everything.
    """
    speed = F.when(F.col("duration_min") > 0, F.col("distance_km_declared") / (F.col("duration_min") / 60))
    limit = code_map(F.col("speed_class"), SPEED_LIMIT_KMH)
    rows = classified.withColumn("speed_class", speed_class(F.col("mode_group"))).withColumn("speed_kmh", speed).withColumn("flagged", F.coalesce(F.col("speed_kmh") > limit, F.lit(False)))
    medians = rows.where("not flagged and speed_class is not null and speed_kmh is not null").groupBy("speed_class").agg(F.expr("percentile(speed_kmh, 0.5)").alias("median_kmh"))
    # Three classes, so three rows.
    fixed = F.when(F.col("flagged"), F.col("duration_min") / 60 * F.col("median_kmh")).otherwise(F.col("distance_km_declared"))
    return rows.join(F.broadcast(medians), "speed_class", "left").withColumn("distance_km", fixed)


def terminal_minutes(df: DataFrame, variant: str = "declared") -> DataFrame:
    """Adds walk_min and wait_min used at a trip's ends: declared (with defaults where missing), declared_plus1 or defaults."""
    ori, des, mode = F.col("density_ori"), F.col("density_des"), F.col("mode_group")
    access = lambda c: code_map(c, {k: m / (en.WALK_SPEED_KMH / 3.6) / 60 for k, m in en.ACCESS_WALK_M.items()})
    away = code_map(des, en.WALK_FROM_CAR_MIN)
    default = (
        F.when(mode.isin("car_driver", "car_passenger_household"), code_map(ori, en.WALK_TO_CAR_MIN) + away)
        .when(mode == "car_passenger_carpool", en.CARPOOL_WALK_MIN + away)
        .when(mode.isin("urban_pt", "train"), access(ori) + access(des))
        .when(mode == "cycle", F.lit(2 * en.BIKE["get_park_min"]))
    )
    wait = code_map(F.col("vehicle"), en.vehicle_tables("kh").wait_min)
    if variant == "defaults":
        walk_used, wait_used = default, wait
    else:
        walk_used, wait_used = F.coalesce(F.col("declared_walk_min"), default), F.coalesce(F.col("declared_wait_min"), wait)
        if variant == "declared_plus1":
            walk_used = walk_used + F.when(mode.isin(*PLUS_ONE), 1.0).otherwise(0.0)
    return df.withColumns({"walk_min": walk_used, "wait_min": wait_used, "parking_min": code_map(des, en.PARKING_MIN)})


def bike_ride_time(df: DataFrame, scale: float = 1.0) -> DataFrame:
    """Adds bike_ride_s, the duration less terminal walk and stops, null where what is left is not credible, and the power it implies."""
    d_s = F.col("duration_min") * 60
    s = en.BIKE_STOPS
    naive = safe_div(F.col("distance_km") * 1000, d_s)
    lost = F.col("walk_min") * 60 + s["per_km"] * F.col("distance_km") * (naive * (1 / s["deceleration"] + 1 / s["acceleration"]) + s["red_s"] ** 2 / (2 * s["cycle_s"]))
    ride = d_s - scale * lost
    ok = (F.col("mode_group") == "cycle") & (F.col("duration_min") > 0) & (ride >= F.greatest(F.lit(MIN_RIDE_S), MIN_RIDE_SHARE * d_s)) & (safe_div(F.col("distance_km") * 3600, ride) <= MAX_BIKE_KMH)
    df = df.withColumn("bike_ride_s", F.when(ok, ride))
    return df.withColumn("implied_power_w", en.required_power_w(F.col("distance_km") * 1000 / F.col("bike_ride_s"), F.lit(0.0), F.lit(en.MASS_KG)))


def flat_bike_speed(power_w: float | None = None) -> float:
    """m/s on the flat at a power, the calibrated one where none is given, the rider's mass only."""
    return float(en.bike_speed_np(np.array([power_w or en.BIKE["p0_w"]]), np.array([0.0]), np.array([en.MASS_KG]))[0])


def leg_energy(rates: str, scale: float = 1.0, bike_power_w: float | None = None) -> Column:
    """kJ above rest of a whole trip under one rate set, null for modes without a formula.

    `scale` multiplies the minutes and energy of a trip's ends; the way between takes the rest.
    """
    t = en.vehicle_tables(rates)
    mode, d = F.col("mode_group"), F.col("duration_min")
    walk_rate = en.MASS_KG * en.WALK_COST[rates] * (en.WALK_SPEED_KMH * 1000 / 60) / 1000
    stand, sit, drive = (en.rate(x, rates) for x in ("standing", "sitting", "driving"))
    walk, wait, park = (scale * F.col(c) for c in ("walk_min", "wait_min", "parking_min"))
    pool_wait = scale * en.CARPOOL_WAIT_MIN
    zero = F.lit(0.0)
    ride_s = F.coalesce(F.col("bike_ride_s"), d * 60)
    b = en.BIKE
    bike = (
        (bike_power_w or b["p0_w"]) / b["efficiency"] * ride_s / 1000
        + b["unloaded_met"] * en.MET_MINUTE_KJ_PER_KG * en.MASS_KG * ride_s / 60
        + stand * walk
        + en.BIKE_STOPS["per_km"] * F.col("distance_km") * F.lit(0.5 * (en.MASS_KG + b["mass"]) * flat_bike_speed(bike_power_w) ** 2 / b["efficiency"] / 1000 * scale)
    )
    car = lambda r: walk_rate * walk + r * park + r * F.greatest(d - walk - park, zero)
    carpool = walk_rate * walk + stand * pool_wait + sit * park + sit * F.greatest(d - walk - pool_wait - park, zero)
    stairs_min = scale * code_map(F.col("vehicle"), t.stairs_min)
    ride = walk_rate * walk + stand * wait + scale * code_map(F.col("vehicle"), t.stairs_kj) + code_map(F.col("vehicle"), t.ride_kj_per_min) * F.greatest(d - walk - wait - stairs_min, zero)
    return (
        F.when(mode == "walk", en.MASS_KG * en.WALK_COST[rates] * F.col("distance_km"))
        .when(mode == "cycle", bike)
        .when(mode == "car_driver", car(drive))
        .when(mode == "car_passenger_household", car(sit))
        .when(mode == "car_passenger_carpool", carpool)
        .when(mode.isin("urban_pt", "train"), ride)
    )


def trip_legs(trips: DataFrame, terminal: str = "declared", density: str = "proxy", scale: float = 1.0, bike_power_w: float | None = None) -> DataFrame:
    """The whole pipeline: classification, speed correction, terminal minutes, ride time and both energies.

    `scale` multiplies the ends of trips where they are the defaults, and has no
    effect on declared ones; `bike_power_w` replaces the calibrated power.
    """
    by = scale if terminal == "defaults" else 1.0
    rows = bike_ride_time(terminal_minutes(corrected_distances(classify(trips, density)), terminal), by)
    return rows.withColumns({f"energy_{r}_kj": leg_energy(r, by, bike_power_w) for r in ("kh", "cp")})


def day_summary(legs: DataFrame) -> DataFrame:
    """One row per described day: weights, totals, the set of modes other than walking and the day's mode group."""
    any_ = lambda c: F.min(c).alias(c)  # noqa: E731  constant within a day
    per = legs.groupBy("day_id").agg(
        *(any_(c) for c in ("ident_men", "pond_jour", "typejour", "age_band", "population_category", "income_quintile", "residence_density")),
        F.count("*").alias("trips_per_day"),
        F.sum("duration_min").alias("total_time_min"),
        F.sum("energy_kh_kj").alias("total_energy_kh_kj"),
        F.sum("energy_cp_kj").alias("total_energy_cp_kj"),
        F.array_sort(F.collect_set(F.when(F.col("mode_group") != "walk", F.col("mode_group")))).alias("non_walk_modes"),
    )
    n = F.size("non_walk_modes")
    return per.withColumn("day_mode_group", F.when(n == 0, "walking_only").when(n == 1, F.try_element_at("non_walk_modes", F.lit(1))).otherwise("multimodal"))
