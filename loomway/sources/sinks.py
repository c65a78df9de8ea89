"""Writers: Parquet with stages and signatures, tidy CSV tables; views and fetched results."""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomway.operators.bootstrap import suppressed


def write_parquet(df: DataFrame, path: str, partition_by: Iterable[str] = (), mode: str = "overwrite") -> None:
    """Zstandard Parquet; the commit protocol publishes the files of a job together."""
    df.write.mode(mode).option("compression", "zstd").partitionBy(*partition_by).parquet(path)


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def stage(spark: SparkSession, path: str, build: Callable[[], DataFrame], schema: str | None = None) -> DataFrame:
    """The table at `path`, built only where it is not complete yet or has another schema than the one asked for."""
    done = _exists(spark, f"{path}/_SUCCESS")
    if done and schema is not None:
        want = spark.createDataFrame([], schema).schema
        done = [(f.name, f.dataType) for f in spark.read.parquet(path).schema] == [(f.name, f.dataType) for f in want]
    if not done:
        write_parquet(build(), path)
    return spark.read.parquet(path)


def signature(**parts) -> str:
    """Hash of everything a result depends on."""
    return hashlib.sha256(json.dumps(parts, sort_keys=True, default=str).encode()).hexdigest()[:16]


def publish(spark: SparkSession, df: DataFrame, path: str, partition_by: Iterable[str] = ()) -> None:
    """Writes beside the path, reads the copy back, and renames it: a reader sees the whole table or none.

    A table that another writer has published meanwhile stays, and the copy goes.
    """
    beside = f"{path}.staging-{uuid.uuid4().hex}"
    write_parquet(df, beside, partition_by)
    if sorted(spark.read.parquet(beside).columns) != sorted(df.columns):
        raise ValueError(f"{beside} lacks columns")
    at = lambda x: spark._jvm.org.apache.hadoop.fs.Path(x)
    system = at(path).getFileSystem(spark._jsc.hadoopConfiguration())
    if system.exists(at(path)) or not system.rename(at(beside), at(path)):
        system.delete(at(beside), True)


def signed(spark: SparkSession, root: str, name: str, build: Callable[[], DataFrame], partition_by: Iterable[str] = (), **parts) -> DataFrame:
    """A cached table under a folder that its inputs name: other inputs, another folder, so nothing stale is read."""
    path = f"{root}/{name}-{signature(**parts)}"
    if not _exists(spark, f"{path}/_SUCCESS"):
        publish(spark, build(), path, partition_by)
    return spark.read.parquet(path)


def shadow(spark: SparkSession, view: str, change: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """A view replaced by what `change` makes of it, under its own name; what was read from it before stays."""
    df = change(spark.table(view))
    df.createOrReplaceTempView(view)
    return df


def fetch(df: DataFrame, most: int = 100_000):
    """A small result as an Arrow table; more rows than `most` are an error, not a cut."""
    out = df.limit(most + 1).toArrow()
    if out.num_rows > most:
        raise ValueError(f"more than {most} rows")
    return out


def fetch_columns(df: DataFrame, most: int = 100_000) -> dict:
    """A small result as one NumPy array for each column."""
    return {n: c.to_numpy() for n, c in zip(df.columns, fetch(df, most).columns)}


def fetch_one(df: DataFrame) -> tuple:
    """The one row of a result; none or several are an error."""
    got = df.limit(2).collect()
    if len(got) != 1:
        raise ValueError("not one row")
    return tuple(got[0])


def write_report(df: DataFrame, path: str, values: Iterable[str] = (), count: str | None = None, least: int = 50) -> None:
    """One CSV file with a header for a report's table; the values of cells with few rows are blank.

    Reports are aggregates; `coalesce(1)` is for them only.
    """
    out = df.withColumns({v: suppressed(F.col(v), F.col(count), least) for v in values}) if count else df
    out.coalesce(1).write.mode("overwrite").option("header", True).option("emptyValue", "").csv(path)
