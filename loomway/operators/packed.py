"""Several values packed in one field: one row per value, with its place."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Letters, digits and the signs that belong to items.
ORDINARY = r"\p{L}\p{N}:\-+._"

#: Skeleton rules are broadcast up to this many bytes, and joined over salted keys beyond.
BROADCAST_BYTES = 8 << 20
SALTS = 16

_RULES = "kind int, skeleton string, items array<array<int>>"


def split_rule(skeleton: str, blanks_belong: bool) -> list[list[int]]:
    """For each item, the places (from 1) of the runs that make its text.

    Each character of a skeleton stands for one run: `a` for ordinary
    characters, anything else for itself.
    """
    items: list[list[int]] = []
    item: list[int] = []
    quoted, i, n = False, 0, len(skeleton)

    def close() -> None:
        a, z = 0, len(item)
        while a < z and skeleton[item[a] - 1].isspace():
            a += 1
        while z > a and skeleton[item[z - 1] - 1].isspace():
            z -= 1
        if a < z:
            items.append(item[a:z])
        item.clear()

    while i < n:
        c = skeleton[i]
        if quoted:
            if c != '"':
                item.append(i + 1)
            elif i + 1 < n and skeleton[i + 1] == '"':
                item.append(i + 1)
                i += 1
            else:
                quoted = False
        elif c == '"':
            quoted = True
        elif c == "a" or (blanks_belong and c == " "):
            item.append(i + 1)
        else:
            close()
        i += 1
    close()
    return items


def _resolve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        pdf["items"] = [split_rule(s, k == 1) for k, s in zip(pdf["kind"], pdf["skeleton"])]
        yield pdf


def unpack(df: DataFrame, text: str, keep: list[str], blanks_belong: bool) -> DataFrame:
    """One row per item of `text`: (keep columns, pos from 1, item).

    Ordinary characters are masked run by run, which leaves a skeleton of
    delimiters; its splitting rule is worked out once for each distinct
    skeleton and applied to the runs by position. Rules are broadcast when
    small, and joined over salted keys when not, as one skeleton may hold most
    rows.

    Null and blank fields give no row, empty items none; a quote never closed
    holds to the end. Repeated rows each give theirs.
    """
    spark = df.sparkSession
    # Each character but the ordinary ones is a run of its own, so the skeleton's characters and the runs go in step.
    runs = F.regexp_extract_all(F.col("_t"), F.lit(rf"(?s)([{ORDINARY}]+|[^{ORDINARY}])"), 1)
    skeleton = F.regexp_replace("_t", rf"[{ORDINARY}]+", "a")
    rows = df.select(*keep, F.col(text).alias("_t")).where(F.col("_t").rlike(r"(?U)[^\s]")).select(*keep, F.lit(int(blanks_belong)).alias("kind"), skeleton.alias("skeleton"), runs.alias("_r"))
    distinct = rows.select("kind", "skeleton").distinct()
    rules = distinct.mapInPandas(_resolve, _RULES)
    size = distinct.agg(F.sum(F.length("skeleton") * 12 + 64)).first()[0] or 0
    if size <= BROADCAST_BYTES:
        joined = rows.join(F.broadcast(rules), ["kind", "skeleton"])
    else:
        salt = F.pmod(F.xxhash64(*keep), F.lit(SALTS)).cast("int")
        spread = rules.withColumn("_s", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = rows.withColumn("_s", salt).join(spread, ["kind", "skeleton", "_s"])
    item = lambda idx: F.array_join(F.transform(idx, lambda i: F.element_at(F.col("_r"), i)), "")
    return joined.select(*keep, F.posexplode(F.transform("items", item)).alias("pos", "item")).withColumn("pos", F.col("pos") + 1)


def unpack_brute(text: str | None, blanks_belong: bool) -> list[str]:
    """The same rule read character by character, for tests."""
    if text is None:
        return []
    out, cur, quoted, i = [], "", False, 0
    while i < len(text):
        c = text[i]
        if quoted and c == '"' and text[i + 1 : i + 2] == '"':
            cur, i = cur + '"', i + 1
        elif c == '"':
            quoted = not quoted
        elif quoted or c.isalnum() or c in ":-+._" or (blanks_belong and c == " "):
            cur += c
        else:
            out, cur = [*out, cur], ""
        i += 1
    return [x for x in (re.sub(r"^\s+|\s+$", "", y) for y in [*out, cur]) if x]
