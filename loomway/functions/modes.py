"""Classification columns of trips: mode, vehicle, density, motive, income."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from loomway.functions.exprs import code_map

# Codes of the surveys' mode of transport, urban units and purposes.
VEHICLES = {5.1: "urban_bus", 5.2: "urban_bus", 5.3: "interurban_coach", 5.4: "interurban_coach", 5.5: "ter", 5.6: "tram", 5.7: "metro", 5.8: "rer_suburban", 5.9: "ter", 6.1: "tgv_long_distance_coach", 6.2: "tgv_long_distance_coach", 6.3: "intercites", 6.4: "intercites", 6.5: "intercites"}
CAR_MODES = ("car_driver", "car_passenger_household", "car_passenger_carpool")
SPEED_LIMIT_KMH = {"walk": 7.0, "cycle": 35.0, "car": 130.0}
RESIDENCE = ("1.1", "1.2", "1.3")
LEISURE_ANY, LEISURE_SHORT, HOLIDAY = (7.7, 7.8), 7.6, (8.1, 8.2, 8.3, 8.4)
PROFESSIONAL_ROUND = ("9.4", "9.95")
SMALL, LARGE = ("0", "1", "2", "3"), ("7", "8")
CYCLE, DRIVER, PASSENGER = (2.1, 2.2), (3.1, 3.3), 3.2
URBAN_PT, TRAIN = (5.1, 5.2, 5.3, 5.4, 5.5, 5.6, 5.7), (5.8, 5.9)
WALK_GROUP, TRAIN_GROUP = 1, 6
NO_ANSWER = 9999


def mode_group(mtp: Column, inside: Column, outside: Column) -> Column:
    """Eight classes; a passenger with only people of other households is a carpool passenger."""
    whole = F.floor(mtp)
    shared = (F.coalesce(outside, F.lit(0)) > 0) & (F.coalesce(inside, F.lit(0)) == 0)
    passenger = F.when(shared, "car_passenger_carpool").otherwise("car_passenger_household")
    known = F.when(mtp.isin(*CYCLE), "cycle").when(mtp.isin(*DRIVER), "car_driver").when(mtp == PASSENGER, passenger).when(mtp.isin(*URBAN_PT), "urban_pt").when(mtp.isin(*TRAIN) | (whole == TRAIN_GROUP), "train")
    return F.when(mtp == NO_ANSWER, "other").when(whole == WALK_GROUP, "walk").otherwise(F.coalesce(known, F.lit("other")))


def vehicle(mtp: Column) -> Column:
    return code_map(mtp, VEHICLES)


def density_class(status: Column, size: Column) -> Column:
    """Density of a trip end from its place in the urban unit and the unit's size; intermediate where unknown."""
    return (
        F.when(status == "R", "very_sparse")
        .when(status == "I", "sparse")
        .when(status.isin("C", "B") & size.isin(*SMALL), "sparse")
        .when((status == "C") & size.isin(*LARGE), "dense")
        .otherwise("intermediate")
    )


def income_midpoint(label: Column) -> Column:
    """Midpoint in euros of a bracket text: half of an upper bound, 1.5 times an open lower one; null where no number stands."""
    head = F.element_at(F.split(label, r"\("), 1)
    # Digits in groups of three behind blanks, or digits in a row.
    found = F.transform(F.regexp_extract_all(head, F.lit(r"(?U)([0-9]{1,3}(?:\s[0-9]{3})+|[0-9]+)"), 1), lambda x: F.regexp_replace(x, r"(?U)\s", "").try_cast("double"))
    return (
        F.when(label.isNull() | (F.size(found) == 0), F.lit(None).cast("double"))
        .when(F.contains(head, F.lit("plus")), F.try_element_at(found, F.lit(1)) * 1.5)
        .when(F.size(found) == 1, F.try_element_at(found, F.lit(1)) / 2)
        .otherwise((F.try_element_at(found, F.lit(1)) + F.try_element_at(found, F.lit(2))) / 2)
    )


#: GTFS route types to mode families (fixed values): single codes, then ranges.
ROUTE_TYPES = {0: "tram", 1: "metro", 2: "rail", 3: "bus", 4: "ferry", 5: "tram", 6: "metro", 7: "metro", 11: "bus", 12: "metro"}
ROUTE_TYPE_RANGES = ((100, 117, "rail"), (400, 405, "rail"), (200, 209, "bus"), (700, 716, "bus"), (900, 906, "tram"), (1000, 1021, "ferry"), (1300, 1307, "metro"), (1400, 1402, "metro"))


def route_type_family(code: Column) -> Column:
    out = code_map(code, ROUTE_TYPES)
    for lo, hi, name in ROUTE_TYPE_RANGES:
        out = F.when(code.between(lo, hi), name).otherwise(out)
    return out
