"""Queries of percentiles, and of the text problems: encoding, mixing and subject areas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomway.llm.encoding import count_tokens, encode_corpus, round_trip
from loomway.llm.mixing import mix, shares
from loomway.llm.percentiles import merge_counts, percentiles_from_counts, value_counts
from loomway.llm.subjects import Model, assign, train, training_set
from loomway.operators.badrows import is_minutes
from loomway.session import cut
from loomway.tables import table

SQL: dict = {}

# --- 4: percentiles of very large numeric columns

PROBABILITIES = (0.01, 0.05, 0.1, 0.25, 0.5, 0.75, 0.9, 0.95, 0.99)
_P4_ROWS = """select 'day_summary.pond_jour' as field, age_band, strftime(loaded_at, '%Y-%m') as month, pond_jour as x from day_summary where isfinite(pond_jour)
    union all select 'trips_norm.duration_min', age_band, strftime(loaded_at, '%Y-%m'), duration_min from trips_norm where isfinite(duration_min) and duration_min between 0 and 1440"""
_P4_AGG = "round(case p " + " ".join(f"when {p} then quantile_cont(x, {p})" for p in PROBABILITIES) + " end, 6) as value, count(*) as n"
_P4_GRID = "(select unnest([" + ", ".join(map(str, PROBABILITIES)) + "])::double as p)"


def _pieces(spark: SparkSession, folder: str) -> DataFrame:
    """Value counts per source, age band and month of loading."""
    month = F.date_format("loaded_at", "yyyy-MM").alias("month")
    w = table(spark, folder, "day_summary", "age_band", "pond_jour", "loaded_at").select(F.lit("day_summary.pond_jour").alias("field"), "age_band", month, F.col("pond_jour").alias("x"))
    m = table(spark, folder, "trips_norm", "age_band", "duration_min", "loaded_at").where(is_minutes(F.col("duration_min"))).select(F.lit("trips_norm.duration_min").alias("field"), "age_band", month, F.col("duration_min").alias("x"))
    return value_counts(w.unionByName(m), ["field", "age_band"], "x", piece="month")


def p4_percentiles(spark: SparkSession, folder: str) -> DataFrame:
    """Exact percentiles per age band, combined from monthly pieces."""
    g = ["field", "age_band"]
    out = percentiles_from_counts(merge_counts(_pieces(spark, folder), g), g, PROBABILITIES)
    return out.select(*g, "p", F.round("value", 6).alias("value"), "n")


SQL["p4_percentiles"] = f"select field, age_band, p, {_P4_AGG} from ({_P4_ROWS}), {_P4_GRID} group by field, age_band, p"


def p4_monthly(spark: SparkSession, folder: str) -> DataFrame:
    """Quartiles of each piece: per age band and month of loading."""
    g = ["field", "age_band", "month"]
    out = percentiles_from_counts(_pieces(spark, folder), g, (0.25, 0.5, 0.75))
    return out.select(*g, "p", F.round("value", 6).alias("value"), "n")


SQL["p4_monthly"] = f"select field, age_band, month, p, {_P4_AGG} from ({_P4_ROWS}), (select unnest([0.25, 0.5, 0.75])::double as p) group by field, age_band, month, p"


def p4_pieces(spark: SparkSession, folder: str) -> DataFrame:
    """The monthly pieces themselves, which are stored and combined by adding their counts."""
    return _pieces(spark, folder).select("field", "age_band", "month", F.col("v").alias("value"), F.col("c").alias("count"))


SQL["p4_pieces"] = f'select field, age_band, month, x as value, count(*) as "count" from ({_P4_ROWS}) group by all'

# --- 7: encoding


def p7_ids(spark: SparkSession, folder: str) -> DataFrame:
    """Token ids of every document by byte_bpe_50k."""
    return encode_corpus(table(spark, folder, "documents", "doc_id", "text"))


def p7_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    """Per source: documents, tokens, and documents whose decoded ids differ from their text."""
    t = round_trip(table(spark, folder, "documents", "doc_id", "text"))
    docs = table(spark, folder, "documents", "doc_id", "source")
    return docs.join(t, "doc_id").groupBy("source").agg(F.count("*").alias("documents"), F.sum("tokens").alias("tokens"), F.count(F.when(~F.col("same"), 1)).alias("differing"))


def _sizes(spark: SparkSession, folder: str) -> DataFrame:
    """Documents with their sizes in tokens, encoded once."""
    docs = table(spark, folder, "documents", "doc_id", "source", "text").where("source is not null")
    return cut(count_tokens(docs, ["doc_id", "source"]))


def p8_mix(spark: SparkSession, folder: str) -> DataFrame:
    """The mix: each use of a document with its slot and place."""
    return mix(_sizes(spark, folder), table(spark, folder, "mix_targets"))


def p8_shares(spark: SparkSession, folder: str) -> DataFrame:
    """Target and reached shares of each source."""
    sizes, targets = _sizes(spark, folder), table(spark, folder, "mix_targets")
    return shares(mix(sizes, targets), sizes, targets)


def _subjects(spark: SparkSession, folder: str) -> list[str]:
    # Ten rows, a fixed table.
    return sorted(r[0] for r in table(spark, folder, "subject_areas", "subject").where("subject is not null").distinct().collect())


def _model(spark: SparkSession, folder: str) -> Model:
    names = _subjects(spark, folder)
    return train(training_set(table(spark, folder, "documents", "doc_id", "text"), table(spark, folder, "doc_labels"), names), names)


def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    """Subjects of each document."""
    return assign(table(spark, folder, "documents", "doc_id", "text"), _model(spark, folder))


def p9_composition(spark: SparkSession, folder: str) -> DataFrame:
    """Per source and subject: documents, and their share of the source's documents with any subject."""
    found = p9_found(spark, folder)
    docs = table(spark, folder, "documents", "doc_id", "source")
    rows = docs.join(found, "doc_id")
    any_ = rows.groupBy("source").agg(F.count_distinct("doc_id").alias("with_subject"))
    per = rows.groupBy("source", "subject").agg(F.count("*").alias("documents"))
    on = per["source"].eqNullSafe(any_["source"])
    return per.join(any_, on).select(per["source"], "subject", "documents", (F.col("documents") / F.col("with_subject")).alias("share"))


def p9_holdout(spark: SparkSession, folder: str) -> DataFrame:
    """Precision and recall on a fifth of the labelled documents, with a model of the others."""
    names = _subjects(spark, folder)
    rows = training_set(table(spark, folder, "documents", "doc_id", "text"), table(spark, folder, "doc_labels"), names)
    held = F.pmod(F.xxhash64(F.lit(3), "doc_id"), F.lit(5)) == 0
    model = train(rows.where(~held), names)
    want = rows.where(held).select("doc_id", F.explode("subjects").alias("subject")).withColumn("labelled", F.lit(1))
    got = assign(rows.where(held), model).withColumn("found", F.lit(1))
    both = want.join(got, ["doc_id", "subject"], "full_outer")
    n = lambda c: F.count(F.when(c, 1)).cast("double")
    hit, miss, extra = n(F.col("labelled").isNotNull() & F.col("found").isNotNull()), n(F.col("found").isNull()), n(F.col("labelled").isNull())
    return both.agg(F.try_divide(hit, hit + extra).alias("precision"), F.try_divide(hit, hit + miss).alias("recall"), F.count_distinct("doc_id").alias("documents"))


QUERIES: dict = {f.__name__: f for f in (p4_percentiles, p4_monthly, p4_pieces, p7_ids, p7_round_trip, p8_mix, p8_shares, p9_found, p9_composition, p9_holdout)}
