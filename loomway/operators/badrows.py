"""Rows that fail to parse, with the reason, while the others load."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomway.functions.exprs import let, strip_ws


def is_date8(c: Column) -> Column:
    """Eight ASCII digits yyyymmdd of a real date of the years 1900-2100, after stripping; null gives false."""
    s = strip_ws(c)
    digits = s.rlike(r"\A[0-9]{8}\z")
    y, m, d = (F.substring(s, a, n).try_cast("int") for a, n in ((1, 4), (5, 2), (7, 2)))
    leap = ((y % 4 == 0) & (y % 100 != 0)) | (y % 400 == 0)
    last = F.when(m.isin(4, 6, 9, 11), 30).when(m == 2, F.when(leap, 29).otherwise(28)).otherwise(31)
    return F.coalesce(digits & y.between(1900, 2100) & m.between(1, 12) & d.between(1, last), F.lit(False))


def is_exception_type(c: Column) -> Column:
    return F.coalesce(strip_ws(c).isin("1", "2"), F.lit(False))


def is_minutes_text(c: Column) -> Column:
    """Blank, or ASCII digits with an optional point and further digits, at most 1440."""
    s = strip_ws(c)
    return F.coalesce((s == "") | (s.rlike(r"\A[0-9]+(\.[0-9]+)?\z") & (s.try_cast("double") <= 1440)), F.lit(False))


def is_minutes(c: Column) -> Column:
    """Null or a finite number from 0 to 1440."""
    return c.isNull() | (~F.isnan(c) & (c >= 0) & (c <= 1440))


@dataclass(frozen=True)
class Layout:
    """Separator, field names in order, and the rule of each checked field."""

    sep: str
    fields: tuple[str, ...]
    rules: dict


CALENDAR_DAYS = ("monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday")

LAYOUTS = {
    "calendar": Layout(",", ("service_id", *CALENDAR_DAYS, "start_date", "end_date"), {"start_date": is_date8}),
    "calendar_dates": Layout(",", ("service_id", "date", "exception_type"), {"exception_type": is_exception_type}),
    "trips_norm": Layout(";", ("ident_dep", "day_id", "num_dep", "departure_time", "arrival_time", "duration_min", "mtp", "note"), {"duration_min": is_minutes_text}),
}


def _body(line: Column) -> Column:
    """The line without one carriage return at its end; a null line is an empty one."""
    return F.regexp_replace(F.coalesce(line, F.lit("")), r"\r\z", "")


def _outside(parts: Column) -> Column:
    """The pieces of a line split at its quotes that stand outside quotes."""
    return F.filter(parts, lambda _, i: i % 2 == 0)


def quoting_ok(parts: Column, sep: Column) -> Column:
    """Quotes close, open only at a field's start and end only at its end; a doubled one inside is text.

    Split at every quote, pieces at even places are outside. An empty one
    between two quotes is a doubled quote; any other must begin and end with
    the separator, save at the line's own ends.
    """
    n = F.size(parts)
    edge = lambda p, i: ((i == 0) | (p == "") | F.startswith(p, sep)) & ((i == n - 1) | (p == "") | F.endswith(p, sep))
    return (n % 2 == 1) & F.forall(F.transform(parts, lambda p, i: (i % 2 == 1) | edge(p, i)), lambda x: x)


def field_count(parts: Column, sep: Column) -> Column:
    return F.aggregate(_outside(parts), F.lit(1), lambda a, p: a + F.length(p) - F.length(F.replace(p, sep, F.lit(""))))


def fields_of(parts: Column, sep: Column) -> Column:
    """Field texts of a well-quoted line, unquoted; separators inside quotes are written aside while splitting."""
    bs, es, eb = F.lit("\\"), F.lit("\\s"), F.lit("\\b")
    hide = lambda p, i: F.when(i % 2 == 1, F.replace(F.replace(p, bs, eb), sep, es)).otherwise(F.replace(p, bs, eb))
    raw = F.split(F.array_join(F.transform(parts, hide), '"'), sep, -1)
    bare = lambda f: F.when(F.startswith(f, F.lit('"')), F.replace(f.substr(F.lit(2), F.length(f) - 2), F.lit('""'), F.lit('"'))).otherwise(f)
    return F.transform(raw, lambda f: F.replace(F.replace(bare(f), es, sep), eb, bs))


def _fault(line: Column, sep: Column, count: Column, valid) -> Column:
    """Why a line can't be read, `none` where it can: quoting before column_count before bad_value."""
    judged = lambda parts: F.when(~quoting_ok(parts, sep), "quoting").when(field_count(parts, sep) != count, "column_count").otherwise(let(fields_of(parts, sep), lambda f: F.when(valid(f), "none").otherwise("bad_value")))
    return let(F.split(_body(line), '"', -1), judged)


def _rules(layout: Layout, fields: Column) -> Column:
    return reduce(lambda a, b: a & b, (rule(F.try_element_at(fields, F.lit(layout.fields.index(n) + 1))) for n, rule in layout.rules.items()), F.lit(True))


def strict_load(raw: DataFrame, layout: Layout, rec_id: str = "rec_id", line: str = "line") -> DataFrame:
    """Only the conforming lines of one file, as typed columns: (rec_id, _line, fields of the layout)."""
    sep = F.lit(layout.sep)
    good = raw.select(F.col(rec_id).alias("rec_id"), F.col(line).alias("_line")).where(_fault(F.col("_line"), sep, F.lit(len(layout.fields)), lambda f: _rules(layout, f)) == "none")
    good = good.withColumn("_f", let(F.split(_body(F.col("_line")), '"', -1), lambda p: fields_of(p, sep)))
    return good.select("rec_id", "_line", *(F.try_element_at("_f", F.lit(i + 1)).alias(n) for i, n in enumerate(layout.fields)))


def _subtract(raw: DataFrame, loaded: DataFrame, *values: str) -> DataFrame:
    """Raw offsets that were not loaded. The values' hash goes with the offset, should an offset repeat."""
    h = F.xxhash64(*values).alias("_h")
    return raw.select("*", h).join(loaded.select("rec_id", h), ["rec_id", "_h"], "left_anti").drop("_h")


def rejected_lines(raw: DataFrame, layouts: dict[str, Layout], rec_id: str = "rec_id", line: str = "line", file_name: str = "file_name") -> DataFrame:
    """Lines of the files with a layout that did not load: (src_table, rec_id, reason).

    Strict load, subtraction from the raw offsets, and a diagnosis of the rest:
    quoting before column_count before bad_value; each file by its own layout,
    all in one pass. A null or empty line has one empty field. Rows without an
    offset can't be subtracted and are diagnosed alike. Other files are no case.
    """
    of = lambda f: F.coalesce(*(F.when(F.col("_file") == name, f(layout)) for name, layout in layouts.items()))
    fault = _fault(F.col("_line"), of(lambda x: F.lit(x.sep)), of(lambda x: F.lit(len(x.fields))), lambda f: of(lambda x: _rules(x, f)))
    read = raw.where(F.col(file_name).isin(*layouts)).select(F.col(rec_id).alias("rec_id"), F.col(line).alias("_line"), F.col(file_name).alias("_file"))
    rest = _subtract(read, read.where(fault == "none"), "_line", "_file")
    return rest.withColumn("reason", fault).where("reason != 'none'").select(F.lit("raw_records").alias("src_table"), "rec_id", "reason")


def rejected_values(stored: DataFrame, column: str, rule, src_table: str, rec_id: str = "rec_id") -> DataFrame:
    """Stored rows whose value breaks its rule, by the same strict load and subtraction: (src_table, rec_id, reason)."""
    mine = stored.select(F.col(rec_id).alias("rec_id"), F.col(column).alias("_v"))
    rest = _subtract(mine, mine.where(rule(F.col("_v"))), "_v")
    return rest.where(~rule(F.col("_v"))).select(F.lit(src_table).alias("src_table"), "rec_id", F.lit("bad_value").alias("reason"))
