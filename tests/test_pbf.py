import struct
import zlib

import pytest

from loomway.sources.pbf import packed, read_pbf


def varint(n):
    n &= (1 << 64) - 1
    out = b""
    while n > 0x7F:
        out, n = out + bytes([n & 0x7F | 0x80]), n >> 7
    return out + bytes([n])


def zig(n):
    return (n << 1) ^ (n >> 63)


def number(field, n):
    return varint(field << 3) + varint(n)


def data(field, b):
    return varint(field << 3 | 2) + varint(len(b)) + b


def many(field, numbers):
    return data(field, b"".join(map(varint, numbers)))


def deltas(values):
    return [zig(b - a) for a, b in zip([0, *values], values)]


def blob(kind, content, how="zlib"):
    b = number(2, len(content)) + data(3, zlib.compress(content)) if how == "zlib" else data(1, content)
    head = data(1, kind) + number(3, len(b))
    return struct.pack(">I", len(head)) + head + b


def block(*groups, texts=("", "name", "é", "highway", "bus", "stop"), more=b""):
    return data(1, b"".join(data(1, t.encode()) for t in texts)) + b"".join(data(2, g) for g in groups) + more


def test_all_kinds(spark, tmp_path):
    lat, lon = [488_000_000, 488_000_010, -10], [23_000_000, -1, 1_800_000_000]
    dense = data(2, many(1, deltas([5, 7, 1 << 40])) + many(8, deltas(lat)) + many(9, deltas(lon)) + many(10, [1, 2, 0, 0, 3, 4, 1, 5, 0]))
    node = data(1, number(1, zig(-9)) + many(2, [1]) + many(3, [5]) + number(8, zig(1)) + number(9, zig(2)))
    way = data(3, number(1, 11) + many(2, [3]) + many(3, [4]) + many(8, deltas([5, 7, 5])))
    empty_way = data(3, number(1, -3))
    relation = data(4, number(1, 21) + many(2, [1]) + many(3, [4]) + many(8, [5, 0]) + many(9, deltas([11, 5])) + many(10, [1, 0]))
    p = tmp_path / "x.pbf"
    p.write_bytes(blob(b"OSMHeader", b"") + blob(b"OSMData", block(dense, node)) + blob(b"OSMData", block(way, empty_way, relation, more=number(17, 1000) + number(19, 7)), "raw"))
    got = {(r.kind, r.id): r for r in read_pbf(spark, str(p)).collect()}
    assert len(got) == 7
    n = got["node", 5]
    assert (n.lat, n.lon) == pytest.approx((48.8, 2.3)) and n.tags == {"name": "é"} and n.refs is None
    assert got["node", 7].tags == {} and got["node", 1 << 40].tags == {"highway": "bus", "name": "stop"}
    assert got["node", 1 << 40].lon == pytest.approx(180.0) and got["node", 1 << 40].lat == pytest.approx(-1e-6)
    assert (got["node", -9].lat, got["node", -9].tags) == (pytest.approx(1e-7), {"name": "stop"})
    assert got["way", 11].refs == [5, 7, 5] and got["way", 11].tags == {"highway": "bus"} and got["way", 11].lat is None
    assert got["way", -3].refs == []
    r = got["relation", 21]
    assert (r.refs, r.ref_kinds, r.ref_roles) == ([11, 5], ["way", "node"], ["stop", ""])


def test_empty_file_and_long_numbers(spark, tmp_path):
    p = tmp_path / "e.pbf"
    p.write_bytes(blob(b"OSMHeader", b""))
    assert read_pbf(spark, str(p)).count() == 0
    values = [0, 1, -1, 300, -(1 << 62), (1 << 62) + 3]
    assert packed([b"".join(varint(zig(v)) for v in values)], True).tolist() == values
    assert packed([]).tolist() == []
