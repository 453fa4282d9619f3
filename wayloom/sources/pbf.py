"""A Spark data source for OpenStreetMap PBF files: ``spark.read.format("osm_pbf")``.

Options: ``path`` (a local or shared-mount file) and ``kind`` ('ways' or 'nodes'). A file is a
sequence of blobs; the driver reads only their headers and makes one partition of every run of
``blobs`` blobs, so the blobs are decoded in parallel. The wire format is read here directly.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from wayloom.sources.schemas import NODES, WAYS


def varint(b: bytes, i: int) -> tuple[int, int]:
    shift = value = 0
    while True:
        c = b[i]
        i += 1
        value |= (c & 127) << shift
        if c < 128:
            return value, i
        shift += 7


def zigzag(n: int) -> int:
    return (n >> 1) ^ -(n & 1)


def fields(b: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(field number, value) of a message; lengths come as bytes."""
    i = 0
    while i < len(b):
        key, i = varint(b, i)
        if key & 7 == 0:
            value, i = varint(b, i)
        elif key & 7 == 2:
            n, i = varint(b, i)
            value, i = b[i : i + n], i + n
        elif key & 7 == 1:
            value, i = b[i : i + 8], i + 8
        elif key & 7 == 5:
            value, i = b[i : i + 4], i + 4
        else:
            raise ValueError("not a PBF message")
        yield key >> 3, value


def packed(b: bytes, signed: bool = False) -> list[int]:
    out, i = [], 0
    while i < len(b):
        n, i = varint(b, i)
        out.append(zigzag(n) if signed else n)
    return out


def summed(b: bytes) -> list[int]:
    """Delta-coded signed numbers."""
    total, out = 0, []
    for d in packed(b, True):
        total += d
        out.append(total)
    return out


def blobs(file) -> Iterator[tuple[str, int, int]]:
    """(type, offset, size) of each blob."""
    while head := file.read(4):
        info = dict(fields(file.read(struct.unpack(">I", head)[0])))
        at, size = file.tell(), info[3]
        yield info[1].decode(), at, size
        file.seek(at + size)


def payload(blob: bytes) -> bytes:
    parts = dict(fields(blob))
    if 1 in parts:
        return parts[1]
    if 3 in parts:
        return zlib.decompress(parts[3])
    raise ValueError("only raw and zlib blobs are supported")


def _signed64(n: int) -> int:
    return n - (1 << 64) if n >> 63 else n


def decode(block: bytes, kind: str) -> Iterator[tuple]:
    """Rows of a primitive block: (id, node_ids, tags) of ways or (id, lat, lon, tags) of nodes."""
    strings, groups, granularity, lat0, lon0 = [], [], 100, 0, 0
    for f, v in fields(block):
        if f == 1:
            strings = [s.decode("utf-8", "replace") for _, s in fields(v)]
        elif f == 2:
            groups.append(v)
        elif f == 17:
            granularity = v
        elif f == 19:
            lat0 = _signed64(v)
        elif f == 20:
            lon0 = _signed64(v)
    degrees = lambda n, zero: (zero + granularity * n) / 1e9
    for g in groups:
        for f, v in fields(g):
            if f == 3 and kind == "ways":
                w = dict(fields(v))
                tags = {strings[a]: strings[b] for a, b in zip(packed(w.get(2, b"")), packed(w.get(3, b"")), strict=True)}
                yield w[1], summed(w.get(8, b"")), tags
            elif f == 1 and kind == "nodes":
                n = dict(fields(v))
                tags = {strings[a]: strings[b] for a, b in zip(packed(n.get(2, b"")), packed(n.get(3, b"")), strict=True)}
                yield zigzag(n[1]), degrees(zigzag(n[8]), lat0), degrees(zigzag(n[9]), lon0), tags
            elif f == 2 and kind == "nodes":
                d = dict(fields(v))
                keys, i = packed(d.get(10, b"")), 0
                for node, lat, lon in zip(summed(d[1]), summed(d[8]), summed(d[9]), strict=True):
                    tags = {}
                    while i < len(keys) and keys[i]:
                        tags[strings[keys[i]]] = strings[keys[i + 1]]
                        i += 2
                    i += 1
                    yield node, degrees(lat, lat0), degrees(lon, lon0), tags


class _Run(InputPartition):
    def __init__(self, at: list[tuple[int, int]]):
        super().__init__(at)


class _Reader(DataSourceReader):
    def __init__(self, options):
        self.path, self.kind, self.run = options["path"], options.get("kind", "ways"), int(options.get("blobs", 16))

    def partitions(self):
        with open(self.path, "rb") as f:
            data = [(at, size) for kind, at, size in blobs(f) if kind == "OSMData"]
        return [_Run(data[i : i + self.run]) for i in range(0, len(data), self.run)] or [_Run([])]

    def read(self, partition):
        with open(self.path, "rb") as f:
            for at, size in partition.value:
                f.seek(at)
                yield from decode(payload(f.read(size)), self.kind)


class OsmPbf(DataSource):
    @classmethod
    def name(cls):
        return "osm_pbf"

    def schema(self):
        return WAYS if self.options.get("kind", "ways") == "ways" else NODES

    def reader(self, schema):
        return _Reader(self.options)
