"""A file written here, field by field, and read back."""

from __future__ import annotations

import struct
import zlib

import pytest

from placelore.sources.osm_pbf import read_pbf


def var(n):
    n &= (1 << 64) - 1
    out = b""
    while n > 0x7F:
        out += bytes([n & 0x7F | 0x80])
        n >>= 7
    return out + bytes([n])


def zig(n):
    return (n << 1) ^ (n >> 63)


def put(number, value):
    if isinstance(value, int):
        return var(number << 3) + var(value)
    return var(number << 3 | 2) + var(len(value)) + value


def run(values, signed=False):
    return b"".join(var(zig(v) if signed else v) for v in values)


def steps(values):
    return run([b - a for a, b in zip([0, *values], values)], signed=True)


def blob(kind, data, pack):
    body = put(3, zlib.compress(data)) if pack else put(1, data)
    head = put(1, kind) + put(3, len(body))
    return struct.pack(">I", len(head)) + head + body


@pytest.fixture
def path(tmp_path):
    s = [b"", b"name", b"Ekstad", b"place", b"town", b"outer", b"highway", b"primary"]
    table = put(1, b"".join(put(1, x) for x in s))
    plain = put(1, put(1, zig(-7)) + put(2, run([1, 3])) + put(3, run([2, 4])) + put(8, zig(584000000)) + put(9, zig(156000000)))
    dense = put(2, put(1, steps([10, 12, 11])) + put(8, steps([580000000, 580000010, 570000000])) + put(9, steps([150000000, 150000001, 149999999])) + put(10, run([1, 2, 0, 0, 3, 4, 0])))
    way = put(3, put(1, 100) + put(2, run([6])) + put(3, run([7])) + put(8, steps([10, 12, 11])))
    rel = put(4, put(1, 200) + put(8, run([5, 0])) + put(9, steps([100, 12])) + put(10, run([1, 0])))
    one = table + put(2, plain + dense) + put(19, 1_000_000)
    two = table + put(2, way) + put(2, rel)
    p = tmp_path / "map.osm.pbf"
    p.write_bytes(blob(b"OSMHeader", b"", False) + blob(b"OSMData", one, True) + blob(b"OSMData", two, False))
    return str(p)


def test_elements(spark, path):
    n, w, r = read_pbf(spark, path)
    nodes = {x["id"]: (round(x["lat"], 7), round(x["lon"], 7), x["tags"]) for x in n.collect()}
    assert nodes == {
        -7: (58.401, 15.6, {"name": "Ekstad", "place": "town"}),
        10: (58.001, 15.0, {"name": "Ekstad"}),
        12: (58.001001, 15.0000001, {}),
        11: (57.001, 14.9999999, {"place": "town"}),
    }
    assert [tuple(x) for x in w.collect()] == [(100, [10, 12, 11], {"highway": "primary"})]
    got = r.collect()[0]
    assert got["id"] == 200 and [tuple(m) for m in got["members"]] == [("way", 100, "outer"), ("node", 12, "")]


def test_broken_files_are_refused(spark, path):
    with open(path, "r+b") as f:
        f.truncate(60)
    with pytest.raises(Exception, match="broken"):
        read_pbf(spark, path)[0].count()
