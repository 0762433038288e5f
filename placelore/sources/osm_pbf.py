"""OpenStreetMap PBF files as a Spark data source: a partition for a run of blobs, tags as maps.

``spark.dataSource.register(OsmPbf)``, then ``spark.read.format("osm_pbf").option("element", "nodes").load(path)`` with element
nodes, ways or relations gives the bronze tables of schema.RAW.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from placelore.schema import RAW
from placelore.shipping import ship

ELEMENTS = {"nodes": "nodes_raw", "ways": "ways_raw", "relations": "relations_raw"}
MEMBERS = ("node", "way", "relation")
#: Limits of the format.
MOST_HEADER, MOST_BLOB = 64 << 10, 32 << 20


def varint(data: bytes, at: int) -> tuple[int, int]:
    out = shift = 0
    while True:
        b = data[at]
        at += 1
        out |= (b & 0x7F) << shift
        if b < 0x80:
            return out, at
        shift += 7


def fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of a protobuf message: ints of varints, bytes of the rest."""
    at = 0
    while at < len(data):
        key, at = varint(data, at)
        kind = key & 7
        if kind == 0:
            value, at = varint(data, at)
        elif kind == 2:
            size, at = varint(data, at)
            value, at = data[at : at + size], at + size
        else:
            size = {1: 8, 5: 4}[kind]
            value, at = data[at : at + size], at + size
        yield key >> 3, value


def signed(n: int) -> int:
    """Zigzag."""
    return (n >> 1) ^ -(n & 1)


def whole(n: int) -> int:
    """A plain int64, which has ten bytes if negative."""
    return n - (1 << 64) if n >> 63 else n


def packed(data: bytes) -> list[int]:
    at, out = 0, []
    while at < len(data):
        n, at = varint(data, at)
        out.append(n)
    return out


def summed(values: list[int]) -> list[int]:
    """Of differences, zigzag."""
    now, out = 0, []
    for v in values:
        now += signed(v)
        out.append(now)
    return out


def blob_data(blob: bytes) -> bytes:
    for number, value in fields(blob):
        if number == 1:
            return value
        if number == 3:
            return zlib.decompress(value)
        if number in (4, 5, 6, 7):
            raise ValueError("only plain and zlib blobs are supported")
    return b""


def block_rows(block: bytes, element: str) -> Iterator[tuple]:
    strings, groups, step, lat0, lon0 = [], [], 100, 0, 0
    for number, value in fields(block):
        if number == 1:
            strings = [v.decode("utf-8", "replace") for n, v in fields(value) if n == 1]
        elif number == 2:
            groups.append(value)
        elif number == 17:
            step = value
        elif number == 19:
            lat0 = whole(value)
        elif number == 20:
            lon0 = whole(value)
    lat, lon = lambda v: 1e-9 * (lat0 + step * v), lambda v: 1e-9 * (lon0 + step * v)
    tags = lambda m: dict(zip((strings[k] for k in packed(m.get(2, b""))), (strings[v] for v in packed(m.get(3, b""))), strict=False))
    for group in groups:
        for number, value in fields(group):
            m = dict(fields(value)) if number in (1, 2, 3, 4) else {}
            if number == 1 and element == "nodes":
                yield signed(m[1]), lat(signed(m[8])), lon(signed(m[9])), tags(m)
            elif number == 2 and element == "nodes":
                pairs = iter(packed(m.get(10, b"")))
                for i, y, x in zip(summed(packed(m[1])), summed(packed(m[8])), summed(packed(m[9])), strict=True):
                    own = {}
                    for k in pairs:
                        if k == 0:
                            break
                        own[strings[k]] = strings[next(pairs)]
                    yield i, lat(y), lon(x), own
            elif number == 3 and element == "ways":
                yield whole(m[1]), summed(packed(m.get(8, b""))), tags(m)
            elif number == 4 and element == "relations":
                ids, kinds, roles = summed(packed(m.get(9, b""))), packed(m.get(10, b"")), packed(m.get(8, b""))
                yield whole(m[1]), [(MEMBERS[k], i, strings[r]) for k, i, r in zip(kinds, ids, roles, strict=True)], tags(m)


def open_file(path: str):
    """Local paths directly, others by their scheme."""
    if "://" not in path:
        return open(path.removeprefix("file:"), "rb")
    from pyarrow import fs

    system, inner = fs.FileSystem.from_uri(path)
    return system.open_input_file(inner)


def blobs(path: str) -> Iterator[tuple[int, int]]:
    """(offset, size) of the data blobs; only headers are read."""
    with open_file(path) as f:
        f.seek(0, 2)
        end, at = f.tell(), 0
        while at + 4 <= end:
            f.seek(at)
            (size,) = struct.unpack(">I", f.read(4))
            head = f.read(size)
            if size > MOST_HEADER or len(head) < size:
                raise ValueError(f"{path}: broken blob header at {at}")
            m = dict(fields(head))
            if m[3] > MOST_BLOB or at + 4 + size + m[3] > end:
                raise ValueError(f"{path}: broken blob at {at}")
            if m[1] == b"OSMData":
                yield at + 4 + size, m[3]
            at += 4 + size + m[3]


class Run(InputPartition):
    def __init__(self, path: str, spans: list[tuple[int, int]]):
        self.path, self.spans = path, spans


class Reader(DataSourceReader):
    def __init__(self, options):
        self.path, self.element = options["path"], options.get("element", "nodes")
        self.bytes_each = int(options.get("bytes_each", 16 << 20))

    def partitions(self):
        out, now, size = [], [], 0
        for span in blobs(self.path):
            now.append(span)
            size += span[1]
            if size >= self.bytes_each:
                out.append(Run(self.path, now))
                now, size = [], 0
        return [*out, Run(self.path, now)] if now or not out else out

    def read(self, partition: Run):
        with open_file(partition.path) as f:
            for at, size in partition.spans:
                f.seek(at)
                yield from block_rows(blob_data(f.read(size)), self.element)


class OsmPbf(DataSource):
    @classmethod
    def name(cls) -> str:
        return "osm_pbf"

    def schema(self) -> str:
        return RAW[ELEMENTS[self.options.get("element", "nodes")]]

    def reader(self, schema):
        return Reader(self.options)


def read_pbf(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes_raw, ways_raw, relations_raw) of a file; several files: see ingest.offset_union."""
    ship(spark)
    spark.dataSource.register(OsmPbf)
    return tuple(spark.read.format("osm_pbf").option("element", e).load(path) for e in ELEMENTS)
