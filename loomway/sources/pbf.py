"""Map extracts in the protocol-buffer format: nodes, ways and relations as rows, without a converter.

A file is a row of compressed blobs. The driver reads their headers only, and
the tasks read and decode the blobs, so a file of any size spreads over the
cluster. Paths are those of pyarrow's file systems.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

SCHEMA = "kind string, id long, lat double, lon double, tags map<string,string>, refs array<long>, ref_kinds array<string>, ref_roles array<string>"
KINDS = ("node", "way", "relation")
#: Blobs of a task, each of at most 32 MiB by the format.
BLOBS_PER_TASK = 16


def _open(path: str):
    from pyarrow import fs

    system, name = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path.removeprefix("file:"))
    return system.open_input_file(name)


def _varint(buf: bytes, at: int) -> tuple[int, int]:
    out = shift = 0
    while True:
        b = buf[at]
        at += 1
        out |= (b & 0x7F) << shift
        if b < 0x80:
            return out, at
        shift += 7


def message(buf: bytes) -> dict[int, list]:
    """Fields of one message: numbers as they are, everything of a length as bytes, each in the order of the message."""
    out: dict[int, list] = {}
    at = 0
    while at < len(buf):
        key, at = _varint(buf, at)
        kind = key & 7
        if kind == 0:
            value, at = _varint(buf, at)
        elif kind == 2:
            n, at = _varint(buf, at)
            value, at = buf[at : at + n], at + n
        elif kind in (1, 5):
            n = 8 if kind == 1 else 4
            value, at = buf[at : at + n], at + n
        else:
            raise ValueError(f"unknown wire type {kind}")
        out.setdefault(key >> 3, []).append(value)
    return out


def packed(values: list[bytes], signed: bool = False) -> np.ndarray:
    """Numbers of a packed field, all at once; signed ones are zigzag."""
    raw = np.frombuffer(b"".join(values), np.uint8)
    if not len(raw):
        return np.empty(0, np.int64)
    last = np.flatnonzero(raw < 0x80)
    first = np.r_[0, last[:-1] + 1]
    place = np.arange(len(raw)) - np.repeat(first, last - first + 1)
    parts = (raw & 0x7F).astype(np.uint64) << (7 * place).astype(np.uint64)
    out = np.add.reduceat(parts, first)
    return ((out >> np.uint64(1)).astype(np.int64) ^ -(out & np.uint64(1)).astype(np.int64)) if signed else out.astype(np.int64)


def _signed(n: int) -> int:
    return (n >> 1) ^ -(n & 1)


def blobs(path: str) -> list[tuple[str, int, int]]:
    """(path, offset, size) of each data blob, from the headers alone."""
    out = []
    with _open(path) as f:
        end, at = f.size(), 0
        while at < end:
            f.seek(at)
            (n,) = struct.unpack(">I", f.read(4))
            head = message(f.read(n))
            at += 4 + n
            size = head[3][0]
            if head[1][0] == b"OSMData":
                out.append((path, at, size))
            at += size
    return out


def unpack_blob(content: bytes) -> bytes:
    b = message(content)
    if 1 in b:
        return b[1][0]
    if 3 in b:
        return zlib.decompress(b[3][0])
    if 7 in b:
        import zstandard

        return zstandard.ZstdDecompressor().decompress(b[7][0], max_output_size=b[2][0])
    raise ValueError("blob without a known compression")


def rows_of(content: bytes) -> Iterator[tuple]:
    """Rows of SCHEMA of one block."""
    block = message(content)
    texts = [s.decode("utf-8", "replace") for s in message(block[1][0]).get(1, [])]
    grain, lat0, lon0 = (block.get(k, [d])[0] for k, d in ((17, 100), (19, 0), (20, 0)))
    signed64 = lambda n: n - (1 << 64) if n >= 1 << 63 else n
    degrees = lambda v, o: 1e-9 * (signed64(o) + grain * v)
    tags = lambda m: {texts[k]: texts[v] for k, v in zip(packed(m.get(2, [])), packed(m.get(3, [])))}
    for group in map(message, block.get(2, [])):
        for m in map(message, group.get(1, [])):
            yield "node", _signed(m[1][0]), degrees(_signed(m[8][0]), lat0), degrees(_signed(m[9][0]), lon0), tags(m), None, None, None
        for m in map(message, group.get(2, [])):
            ids, lat, lon = (np.cumsum(packed(m.get(k, []), True)) for k in (1, 8, 9))
            each = _dense_tags(packed(m.get(10, [])), texts, len(ids))
            yield from (("node", int(i), degrees(int(a), lat0), degrees(int(o), lon0), t, None, None, None) for i, a, o, t in zip(ids, lat, lon, each))
        for m in map(message, group.get(3, [])):
            yield "way", signed64(m[1][0]), None, None, tags(m), np.cumsum(packed(m.get(8, []), True)).tolist(), None, None
        for m in map(message, group.get(4, [])):
            yield "relation", signed64(m[1][0]), None, None, tags(m), np.cumsum(packed(m.get(9, []), True)).tolist(), [KINDS[k] for k in packed(m.get(10, []))], [texts[k] for k in packed(m.get(8, []))]


def _dense_tags(pairs: np.ndarray, texts: list[str], n: int) -> Iterator[dict]:
    """Tags of each of n dense nodes: keys and values in a row, 0 behind each node's last."""
    it = iter(pairs.tolist())
    for _ in range(n):
        one: dict[str, str] = {}
        for k in it:
            if k == 0:
                break
            one[texts[k]] = texts[next(it)]
        yield one


def read_pbf(spark: SparkSession, *paths: str) -> DataFrame:
    """All nodes, ways and relations of the files, in the columns of SCHEMA.

    Nodes have lat and lon, ways the ids of their nodes, relations those of
    their members with kinds and roles; what a kind lacks is null.
    """
    found = [b for p in paths for b in blobs(p)]
    index = spark.createDataFrame(found, "path string, start long, size long").repartition(max(1, len(found) // BLOBS_PER_TASK))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for b in pdf.itertuples():
                with _open(b.path) as f:
                    f.seek(b.start)
                    content = unpack_blob(f.read(b.size))
                out = pd.DataFrame(list(rows_of(content)), columns=[c.split()[0] for c in SCHEMA.split(", ")])
                if len(out):
                    yield out.astype({"lat": "Float64", "lon": "Float64"})

    return index.mapInPandas(run, SCHEMA)
