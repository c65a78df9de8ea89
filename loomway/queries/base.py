"""Relations that many queries start from, in Spark and as SQL text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomway.functions.exprs import clock_seconds, finite, norm_key
from loomway.operators.relational import first_per_key
from loomway.tables import table

SPACES = "chr(9)||chr(10)||chr(11)||chr(12)||chr(13)||chr(28)||chr(29)||chr(30)||chr(31)||' '||chr(133)||chr(160)||chr(8195)||chr(8199)||chr(8201)||chr(8239)||chr(12288)"
CLOCK = r"^([01]?[0-9]|2[0-3]):[0-5][0-9](:[0-5][0-9])?$"
TRIP_ORDER = ("num_dep", "ident_dep")


def key_sql(c: str) -> str:
    return f"nullif(lower(trim({c}, {SPACES})), '')"


def seconds_sql(c: str) -> str:
    return f"case when regexp_full_match({c}, '{CLOCK}') then split_part({c}, ':', 1)::int * 3600 + split_part({c}, ':', 2)::int * 60 + coalesce(try_cast(split_part({c}, ':', 3) as int), 0) end"


def registry() -> tuple[dict, dict, object]:
    """Queries, SQL, and the decorator that adds to both."""
    queries: dict = {}
    sql: dict = {}

    def query(text: str | None = None):
        def add(f):
            queries[f.__name__] = f
            if text:
                sql[f.__name__] = text
            return f

        return add

    return queries, sql, query


def trips(spark: SparkSession, folder: str) -> DataFrame:
    """Trips once each: the first row of every ident_dep, with clock seconds and the normalised household."""
    df = first_per_key(table(spark, folder, "trips_norm"), ["ident_dep"], ["rec_id"])
    return df.withColumns({"departure_s": clock_seconds(F.col("departure_time")), "arrival_s": clock_seconds(F.col("arrival_time")), "hh": norm_key(F.col("ident_men")), "survey": F.substring("day_id", 1, 1)})


TRIPS = f"""trips as (select *, {seconds_sql("departure_time")} as departure_s, {seconds_sql("arrival_time")} as arrival_s, {key_sql("ident_men")} as hh, substr(day_id, 1, 1) as survey
    from (select *, row_number() over (partition by ident_dep order by rec_id) as rn from trips_norm) where rn = 1)"""


def days(spark: SparkSession, folder: str) -> DataFrame:
    """Described days once each with a positive finite weight w and finite minutes x; J days are survey a, others b."""
    df = first_per_key(table(spark, folder, "day_summary"), ["day_id"], ["rec_id"])
    df = df.where(finite(F.col("pond_jour")) & (F.col("pond_jour") > 0) & finite(F.col("total_time_min")))
    unknown = lambda c, n: F.coalesce(F.col(c), F.lit("unknown")).alias(n)
    return df.select(
        "day_id", "rec_id", F.coalesce(norm_key(F.col("ident_men")), F.lit("none")).alias("hh"), F.when(F.startswith("day_id", F.lit("J")), "a").otherwise("b").alias("survey"),
        unknown("age_band", "band"), unknown("population_category", "category"), unknown("income_quintile", "income"), unknown("home_density", "density"), unknown("day_mode_group", "mode"),
        "typejour", "non_walk_modes", F.col("pond_jour").alias("w"), F.col("total_time_min").alias("x"), F.col("trips_per_day").alias("n"), F.col("total_energy_kh_kj").alias("e"), F.col("total_energy_cp_kj").alias("e2"),
    )


DAYS = f"""days as (select day_id, rec_id, coalesce({key_sql("ident_men")}, 'none') as hh, case when starts_with(day_id, 'J') then 'a' else 'b' end as survey,
    coalesce(age_band, 'unknown') as band, coalesce(population_category, 'unknown') as category, coalesce(income_quintile, 'unknown') as income, coalesce(home_density, 'unknown') as density, coalesce(day_mode_group, 'unknown') as mode,
    typejour, non_walk_modes, pond_jour as w, total_time_min as x, trips_per_day as n, total_energy_kh_kj as e, total_energy_cp_kj as e2
    from (select *, row_number() over (partition by day_id order by rec_id) as rn from day_summary) where rn = 1 and isfinite(pond_jour) and pond_jour > 0 and isfinite(total_time_min))"""
