"""Readers: delimited text, feeds, Parquet with boxes, GeoJSON, archives, Arrow tables and configuration."""

from __future__ import annotations

import io
import json
import zipfile
from collections.abc import Iterable
from itertools import islice
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The characters at 0x80 to 0x9f: as Latin-1 reads them, and as cp1252 does.
_C1 = "".join(chr(i) for i in range(0x80, 0xA0) if i not in (0x81, 0x8D, 0x8F, 0x90, 0x9D))
_CP1252 = _C1.encode("latin-1").decode("cp1252")


def read_delimited(spark: SparkSession, path: str, columns: Iterable[str], sep: str = ";", types: dict[str, str] | None = None, null_value: str = "NA", encoding: str = "UTF-8", header: bool = True) -> DataFrame:
    """Delimited text with an explicit schema: strings, save where `types` says otherwise; no inference, so no second pass.

    Columns are taken in their order. Rows too short are filled with nulls and
    values that do not fit their type are null.
    """
    types = types or {}
    western = encoding.lower() in ("windows-1252", "cp1252")  # Spark reads Latin-1, which differs in 27 characters
    schema = ", ".join(f"`{c}` {types.get(c, 'string')}" for c in columns)
    df = spark.read.csv(path, schema=schema, sep=sep, header=header, nullValue=null_value, encoding="ISO-8859-1" if western else encoding, mode="PERMISSIVE", multiLine=False, escape='"', enforceSchema=True)
    return df.select(*(F.translate(c, _C1, _CP1252).alias(c) if t == "string" else c for c, t in df.dtypes)) if western else df


def read_feed_table(spark: SparkSession, path: str) -> DataFrame:
    """A feed's table with its header and all columns as text, so that ids keep their zeros."""
    return spark.read.csv(path, header=True, inferSchema=False, escape='"', multiLine=True)


def read_parquet(spark: SparkSession, path: str, columns: Iterable[str] | None = None) -> DataFrame:
    """Parquet of a file, a folder or a partitioned tree."""
    df = spark.read.option("recursiveFileLookup", "false").parquet(path)
    return df.select(*columns) if columns else df


def read_parametrised(spark: SparkSession, template: str, *values: str, columns: Iterable[str] | None = None) -> DataFrame:
    """Parquet at a path whose question marks stand for the values, in their order; another number of values is an error."""
    parts = template.split("?")
    if len(parts) != len(values) + 1:
        raise ValueError(f"{len(parts) - 1} values expected")
    return read_parquet(spark, "".join(x for pair in zip(parts, [*values, ""]) for x in pair), columns)


def read_box(spark: SparkSession, path: str, west: float, south: float, east: float, north: float, box: str = "bbox") -> DataFrame:
    """Rows whose nested box meets the given one; the four comparisons are pushed to the scan."""
    b = lambda x: F.col(f"{box}.{x}")
    return spark.read.parquet(path).where((b("xmin") <= east) & (b("xmax") >= west) & (b("ymin") <= north) & (b("ymax") >= south))


def optional_columns(df: DataFrame, wanted: dict[str, str]) -> DataFrame:
    """The wanted columns by name and type; those that a file lacks as typed nulls."""
    have = {c.lower() for c in df.columns}
    return df.select(*((F.col(c).try_cast(t) if c.lower() in have else F.lit(None).cast(t)).alias(c) for c, t in wanted.items()))


def read_features(spark: SparkSession, path: str, properties: Iterable[str], lines: bool = False) -> DataFrame:
    """GeoJSON features: (properties, wkt), polygons and multipolygons as WKT; a feature without shape has a null one.

    A collection is one JSON value, so each file is one row; `lines` reads files
    with a feature in each line, which split like any text.
    """
    ring = T.ArrayType(T.ArrayType(T.DoubleType()))
    geometry = T.StructType([T.StructField("type", T.StringType()), T.StructField("coordinates", T.StringType())])
    props = T.StructType([T.StructField(p, T.StringType()) for p in properties])
    feature = T.StructType([T.StructField("properties", props), T.StructField("geometry", geometry)])
    raw = spark.read.text(path, wholetext=not lines)
    collection = T.StructType([T.StructField("features", T.ArrayType(feature))])
    rows = raw.select(F.from_json("value", feature).alias("f")).where("f is not null") if lines else raw.select(F.explode(F.from_json("value", collection)["features"]).alias("f"))
    kind, text = F.col("f.geometry.type"), F.col("f.geometry.coordinates")
    points = lambda r: F.concat(F.lit("("), F.array_join(F.transform(r, lambda p: F.concat_ws(" ", p[0].cast("string"), p[1].cast("string"))), ", "), F.lit(")"))
    polygon = lambda p: F.concat(F.lit("("), F.array_join(F.transform(p, points), ", "), F.lit(")"))
    one, many = F.from_json(text, T.ArrayType(ring)), F.from_json(text, T.ArrayType(T.ArrayType(ring)))
    wkt = F.when(kind == "Polygon", F.concat(F.lit("POLYGON "), polygon(one))).when(kind == "MultiPolygon", F.concat(F.lit("MULTIPOLYGON ("), F.array_join(F.transform(many, polygon), ", "), F.lit(")")))
    return rows.select(*(F.col(f"f.properties.{p}").alias(p) for p in properties), wkt.alias("wkt"))


def read_archived(spark: SparkSession, pattern: str, member: str, encoding: str = "UTF-8") -> DataFrame:
    """(archive, line_no, line) of a member of many zip archives; each is opened by one task and read line by line.

    Archives that can't be read or lack the member give no lines; see
    archive_report(). A member is read twice, to know that all of it can be
    decoded, and never held as a whole.
    """

    def lines_of(z: zipfile.ZipFile):
        with z.open(next(n for n in z.namelist() if n.rpartition("/")[2] == member)) as f:
            for line in io.TextIOWrapper(f, encoding, newline="\n"):
                yield line.rstrip("\r\n")

    def run(batches):
        import pandas as pd

        for pdf in batches:
            for path, content in zip(pdf["path"], pdf["content"]):
                try:
                    z = zipfile.ZipFile(io.BytesIO(content))
                    if member not in {n.rpartition("/")[2] for n in z.namelist()}:
                        continue
                    for _ in lines_of(z):
                        pass
                except (zipfile.BadZipFile, UnicodeError):
                    continue
                it, no = lines_of(z), 1
                while part := list(islice(it, 10_000)):
                    yield pd.DataFrame({"archive": path, "line_no": range(no, no + len(part)), "line": part})
                    no += len(part)

    return spark.read.format("binaryFile").load(pattern).select("path", "content").mapInPandas(run, "archive string, line_no long, line string")


def archive_report(spark: SparkSession, pattern: str, required: Iterable[str]) -> DataFrame:
    """(archive, valid, members, missing, repeated, error) of each zip archive."""
    need = list(required)

    def run(batches):
        import pandas as pd

        for pdf in batches:
            out = []
            for path, content in zip(pdf["path"], pdf["content"]):
                try:
                    with zipfile.ZipFile(io.BytesIO(content)) as z:
                        bad = z.testzip()
                        names = [n.rpartition("/")[2] for n in z.namelist() if not n.endswith("/")]
                    repeated = sorted({n for n in names if names.count(n) > 1})
                    error = f"damaged: {bad}" if bad else None
                    out.append((path, bad is None, sorted(set(names)), [n for n in need if n not in names], repeated, error))
                except zipfile.BadZipFile as e:
                    out.append((path, False, [], need, [], str(e)))
            yield pd.DataFrame(out, columns=["archive", "valid", "members", "missing", "repeated", "error"])

    return spark.read.format("binaryFile").load(pattern).select("path", "content").mapInPandas(run, "archive string, valid boolean, members array<string>, missing array<string>, repeated array<string>, error string")


def read_config(path: str, defaults: dict) -> dict:
    """A JSON or YAML configuration over its defaults; unknown keys are an error. YAML needs its library."""
    text = Path(path).read_text()
    if Path(path).suffix in (".yaml", ".yml"):
        import yaml

        given = yaml.safe_load(text) or {}
    else:
        given = json.loads(text)
    if unknown := set(given) - set(defaults):
        raise ValueError(f"unknown settings: {sorted(unknown)}")
    return defaults | given


def from_arrow(spark: SparkSession, table) -> DataFrame:
    """An Arrow table as a relation, its columns as they are."""
    return spark.createDataFrame(table)


def inline(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A literal relation; an empty one keeps its types."""
    return spark.createDataFrame(rows, schema)
