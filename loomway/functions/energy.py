"""Time and energy formulas of travel legs as Column expressions, and the rates they use."""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Physical constants, published rates and coefficients.
GRAVITY = 9.81
MET_MINUTE_KJ_PER_KG = 0.0732
MASS_KG = 74.0
WALK_SPEED_KMH = 4.8
WALK_COST = {"kh": 3.0, "cp": 2.29}
WALK_POLYNOMIAL = (280.5, -58.7, -76.8, 51.9, 19.6, 2.5)
NET_MET = {"sitting": 0.3, "standing": 0.5, "driving": 1.0}
KJ_PER_MIN = {"sitting": 1.5, "standing": 2.6, "restless": 6.7, "driving": 4.2, "congested": 8.0}
STAIRS = {"up_speed": 0.20, "down_speed": 0.30, "efficiency": 0.30, "down_ratio": 0.3333333333, "escalator_from_m": 10.0}
PLANNED_WAIT_MIN, HEADWAY_LIMIT_MIN = 4.0, 12.0
HEADWAY_MIN = {"metro": 4.0, "tram": 8.0, "urban_bus": 10.0, "rer_suburban": 10.0, "ter": 30.0, "intercites": 60.0, "interurban_coach": 30.0, "tgv_long_distance_coach": 60.0}
HEADWAY_CV = {"metro": 0.15, "rer_suburban": 0.15, "ter": 0.15, "intercites": 0.15, "tgv_long_distance_coach": 0.15, "tram": 0.25, "urban_bus": 0.45, "interurban_coach": 0.45}
LOAD_MAX = {"metro": 4.0, "tram": 4.0, "urban_bus": 3.0, "rer_suburban": 2.5, "ter": 1.8, "intercites": 1.3, "interurban_coach": 1.2, "tgv_long_distance_coach": 1.1}
STANDING_SHARE = {"metro": 0.5, "tram": 0.4, "urban_bus": 0.3, "rer_suburban": 0.4, "ter": 0.15, "intercites": 0.0, "interurban_coach": 0.0, "tgv_long_distance_coach": 0.0}
STATION_HEIGHT_M = {"metro": 15.0, "tram": 0.0, "urban_bus": 0.0, "rer_suburban": 15.0, "ter": 4.0, "intercites": 7.0, "interurban_coach": 0.0, "tgv_long_distance_coach": 7.0}
ACCESS_WALK_M = {"dense": 300.0, "intermediate": 400.0, "sparse": 600.0, "very_sparse": 900.0}
WALK_TO_CAR_MIN = {"dense": 4.0, "intermediate": 3.0, "sparse": 2.0, "very_sparse": 1.0}
PARKING_MIN = {"dense": 5.0, "intermediate": 2.0, "sparse": 0.5, "very_sparse": 0.0}
WALK_FROM_CAR_MIN = {"dense": 5.0, "intermediate": 3.5, "sparse": 2.0, "very_sparse": 0.5}
CARPOOL_WALK_MIN, CARPOOL_WAIT_MIN = 5.0, 3.0
BIKE = {"mass": 15.0, "drivetrain": 0.976, "efficiency": 0.24, "air": 1.2, "cda": 0.55, "get_park_min": 1.0, "unloaded_met": 1.0, "crr": 0.006, "p0_w": 34.8}
BIKE_STOPS = {"per_km": 1.0, "deceleration": 1.0, "acceleration": 0.5, "red_s": 35.0, "cycle_s": 70.0}


def rate(activity: str, rates: str) -> float:
    """kJ above rest per minute of an activity under one of the two rate sets."""
    return KJ_PER_MIN[activity] if rates == "kh" else NET_MET[activity] * MET_MINUTE_KJ_PER_KG * MASS_KG


# --- walking and stairs


def walking_speed(gradient: Column, flat_speed) -> Column:
    """Hiking speed at a signed gradient, scaled so that the flat gives `flat_speed`."""
    return flat_speed * F.exp(F.lit(-3.5) * F.abs(gradient + 0.05)) / F.lit(math.exp(-0.175))


def walking_cost(gradient: Column) -> Column:
    """Net cost of walking, J per kg and m: the polynomial by Horner's scheme."""
    out = F.lit(0.0)
    for c in WALK_POLYNOMIAL:
        out = out * gradient + F.lit(c)
    return out


def gradient_factor(gradient: Column) -> Column:
    return walking_cost(gradient) / F.lit(WALK_POLYNOMIAL[-1])


def walking_leg(segments: Column, rates: str = "cp", mass: float = MASS_KG, speed_kmh: float = WALK_SPEED_KMH) -> Column:
    """struct(time_s, energy_kj) over an array of struct(length_m, gradient) in the direction of travel."""
    flat = F.lit(speed_kmh / 3.6)
    start = F.struct(F.lit(0.0).alias("t"), F.lit(0.0).alias("w"))
    step = lambda a, s: F.struct((a["t"] + s["length_m"] / walking_speed(s["gradient"], flat)).alias("t"), (a["w"] + s["length_m"] * gradient_factor(s["gradient"])).alias("w"))
    done = lambda a: F.struct(a["t"].alias("time_s"), (a["w"] * F.lit(mass * WALK_COST[rates] / 1000)).alias("energy_kj"))
    return F.aggregate(segments, start, step, done)


def stairs_energy_kj(height_m: Column, up: Column, mass: float = MASS_KG) -> Column:
    climb = height_m * F.lit(mass * GRAVITY / STAIRS["efficiency"] / 1000)
    return F.when(up, climb).otherwise(climb * F.lit(STAIRS["down_ratio"]))


def stairs_time_s(height_m: Column, up: Column) -> Column:
    return height_m / F.when(up, F.lit(STAIRS["up_speed"])).otherwise(F.lit(STAIRS["down_speed"]))


# --- waiting, riding, driving


def expected_wait_min(headway: Column, cv: Column) -> Column:
    """Half the headway, longer when it is irregular; beyond the limit the planned wait."""
    return F.when(headway <= HEADWAY_LIMIT_MIN, headway / 2 * (1 + cv * cv)).otherwise(F.lit(PLANNED_WAIT_MIN))


def standing_share(load: Column) -> Column:
    return F.greatest(F.lit(0.0), 1 - 1 / load)


def _between(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))


def ride_rate(load: Column, load_max: Column) -> Column:
    """kJ per minute of a ride: seated and standing riders by load factor, standing ones worse off in a crowd."""
    k = KJ_PER_MIN
    stand = k["standing"] + (k["restless"] - k["standing"]) * _between((load - 1) / (load_max - 1))
    share = standing_share(load)
    return (1 - share) * k["sitting"] + share * stand


def driving_rate(rho: Column, rho_max: float = 2.0) -> Column:
    """kJ per minute of driving, rising with the ratio of congested to free-flow time."""
    k = KJ_PER_MIN
    return k["driving"] + (k["congested"] - k["driving"]) * _between((rho - 1) / (rho_max - 1))


# --- cycling


def _weight(gradient: Column, mass: Column) -> Column:
    theta = F.atan(gradient)
    return mass * GRAVITY * (BIKE["crr"] * F.cos(theta) + F.sin(theta))


def required_power_w(speed: Column, gradient: Column, mass: Column, headwind: Column | None = None) -> Column:
    rel = speed + (headwind if headwind is not None else F.lit(0.0))
    return speed * (_weight(gradient, mass) + 0.5 * BIKE["air"] * BIKE["cda"] * rel * rel) / BIKE["drivetrain"]


def power_by_slope_w(gradient: Column, p0: float, k: float, p_max: float) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(p_max), p0 * (1 + k * gradient)))


def bike_speed_np(power: np.ndarray, gradient: np.ndarray, mass: np.ndarray, headwind: np.ndarray | float = 0.0) -> np.ndarray:
    """Smallest positive root v of power x drivetrain = v (weight + drag (v + wind)^2), 0 where there is none.

    All roots of all rows' cubics at once, as eigenvalues of their companion matrices.
    """
    theta = np.arctan(gradient)
    b = 0.5 * BIKE["air"] * BIKE["cda"]
    w = np.broadcast_to(np.asarray(headwind, float), power.shape)
    c1 = 2 * w
    c2 = mass * GRAVITY * (BIKE["crr"] * np.cos(theta) + np.sin(theta)) / b + w**2
    c3 = -power * BIKE["drivetrain"] / b
    m = np.zeros((len(power), 3, 3))
    m[:, 0, 0], m[:, 0, 1], m[:, 0, 2] = -c1, -c2, -c3
    m[:, 1, 0] = m[:, 2, 1] = 1
    roots = np.linalg.eigvals(m)
    real = np.where((np.abs(roots.imag) < 1e-6) & (roots.real > 1e-9), roots.real, np.inf).min(axis=1, initial=np.inf)
    return np.where(np.isfinite(real), real, 0.0)


@F.pandas_udf(T.DoubleType())
def bike_speed(power: pd.Series, gradient: pd.Series, mass: pd.Series) -> pd.Series:
    """bike_speed_np for columns; null where an input is null or not finite."""
    ok = np.isfinite(power.astype(float)) & np.isfinite(gradient.astype(float)) & np.isfinite(mass.astype(float))
    out = pd.Series(np.nan, index=power.index)
    if ok.any():
        out[ok] = bike_speed_np(power[ok].to_numpy(float), gradient[ok].to_numpy(float), mass[ok].to_numpy(float))
    return out.astype(object).where(ok, None).astype("Float64") if not ok.all() else out


@F.pandas_udf(T.StructType([T.StructField(n, T.DoubleType()) for n in ("speed", "rider_w", "motor_w")]))
def ebike_ride(gradient: pd.Series, p0: pd.Series, slope_k: pd.Series, p_max: pd.Series, mass: pd.Series, assist: pd.Series, motor_cap: pd.Series, legal_cap: pd.Series, descent_cap: pd.Series) -> pd.DataFrame:
    """Speed, rider's and motor's power with assistance up to the legal speed, and descents held at their cap.

    Above the legal speed the motor backs off first; on a capped descent the
    motor cuts out before the rider does. An assist factor of 0 is a plain bike.
    """
    g, m, cap, down = (x.to_numpy(float) for x in (gradient, mass, legal_cap, descent_cap))
    rider = np.clip(p0.to_numpy(float) * (1 + slope_k.to_numpy(float) * g), 0, p_max.to_numpy(float))
    motor = np.minimum(motor_cap.to_numpy(float), assist.to_numpy(float) * rider)
    need = lambda v: np.maximum(0, v * (m * GRAVITY * (BIKE["crr"] * np.cos(np.arctan(g)) + np.sin(np.arctan(g))) + 0.5 * BIKE["air"] * BIKE["cda"] * v * v) / BIKE["drivetrain"])
    v = bike_speed_np(rider + motor, g, m)
    alone = bike_speed_np(rider, g, m)
    over = (v > cap) & (motor > 0)
    v = np.where(over, np.maximum(alone, cap), v)
    motor = np.where(over, np.where(alone >= cap, 0.0, np.maximum(0, need(cap) - rider)), motor)
    fast = v > down
    v = np.where(fast, down, v)
    rider2 = np.where(fast, np.minimum(rider, need(down)), rider)
    motor = np.where(fast, np.maximum(0, need(down) - rider2), motor)
    return pd.DataFrame({"speed": v, "rider_w": rider2, "motor_w": motor})


def rider_share(rider_w: Column, motor_w: Column) -> Column:
    return F.when(rider_w + motor_w <= 0, F.lit(1.0)).otherwise(F.try_divide(rider_w, rider_w + motor_w))


def stop_energy_kj(speed: Column, mass: Column, share: Column | None = None) -> Column:
    return 0.5 * mass * speed * speed * (share if share is not None else F.lit(1.0)) / BIKE["efficiency"] / 1000


def stop_time_s(speed: Column) -> Column:
    s = BIKE_STOPS
    return speed / s["deceleration"] + s["red_s"] ** 2 / (2 * s["cycle_s"]) + speed / s["acceleration"]


def bike_ride_energy_kj(length_m: Column, gradient: Column, speed: Column, mass: Column, time_s: Column, share: Column | None = None, infra: float = 1.0) -> Column:
    """Rolling, climbing and drag work of the rider, and the cost of moving the legs."""
    theta = F.atan(gradient)
    work = mass * GRAVITY * length_m * (BIKE["crr"] * F.cos(theta) + F.sin(theta)) + 0.5 * BIKE["air"] * BIKE["cda"] * speed * speed * length_m
    moved = F.lit(BIKE["unloaded_met"] * MET_MINUTE_KJ_PER_KG * MASS_KG) * time_s / 60
    return work / BIKE["efficiency"] * infra * (share if share is not None else F.lit(1.0)) / 1000 + moved


# --- driver-side tables for the survey's legs


@dataclass(frozen=True)
class VehicleTables:
    """Per vehicle: expected wait, ride rate, and the stairs of both ends."""

    wait_min: dict = field(default_factory=dict)
    ride_kj_per_min: dict = field(default_factory=dict)
    stairs_min: dict = field(default_factory=dict)
    stairs_kj: dict = field(default_factory=dict)


def vehicle_tables(rates: str) -> VehicleTables:
    t = VehicleTables()
    k = KJ_PER_MIN
    for v, h in HEADWAY_MIN.items():
        t.wait_min[v] = h / 2 * (1 + HEADWAY_CV[v] ** 2) if h <= HEADWAY_LIMIT_MIN else PLANNED_WAIT_MIN
        load = 1 / (1 - STANDING_SHARE[v])
        stand = k["standing"] + (k["restless"] - k["standing"]) * min(1.0, max(0.0, (load - 1) / (LOAD_MAX[v] - 1)))
        share = max(0.0, 1 - 1 / load)
        t.ride_kj_per_min[v] = (1 - share) * k["sitting"] + share * stand
        height = STATION_HEIGHT_M[v]
        t.stairs_min[v] = height * (1 / STAIRS["up_speed"] + 1 / STAIRS["down_speed"]) / 60
        climb = MASS_KG * GRAVITY * height / STAIRS["efficiency"] / 1000
        t.stairs_kj[v] = rate("standing", rates) * t.stairs_min[v] if height > STAIRS["escalator_from_m"] else climb * (1 + STAIRS["down_ratio"])
    return t
