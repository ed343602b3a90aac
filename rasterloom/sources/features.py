"""GeoJSON feature collections of any size, read by byte ranges.

A file is cut into ranges of equal size and every range is a partition. A feature belongs
to the range in which its opening brace lies; the task reads on past the end of its range
until its last feature is complete. Where features begin is found from the text: the
first brace of the range that opens a JSON object whose type is ``Feature`` and
whose neighbours are what stands between the members of a collection. Files with one
feature a line, one line in all, or pretty-printed, are read alike.

So long as there are at most ``TASKS`` ranges every range is a task; beyond that a task
takes several ranges in a row, up to ``TASK_BYTES``, so that small ranges of a large file do not cost
a task each.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from rasterloom.functions.polygons import RINGS, point

RANGE_BYTES = 32 << 20
READ_BYTES = 4 << 20
LEAST_READ = 8 << 10  # what is read on behind the end of a range, doubled from time to time
TASKS, TASK_BYTES = 48, 32 << 20
ROWS = "path string, offset long, properties string, geometry string"
_BLANK = b" \t\r\n"


class Range:
    def __init__(self, path: str, start: int, end: int) -> None:
        self.path, self.start, self.end = path, start, end


class Ranges(InputPartition):
    """Ranges that one task reads one after the other."""

    def __init__(self, ranges: list[Range]) -> None:
        self.ranges = ranges


def _dealt(ranges: list[Range]) -> list[Ranges]:
    """One range a task while there are few; else tasks of equal size, no larger than ``TASK_BYTES`` unless a range is."""
    total = sum(r.end - r.start for r in ranges)
    most = 0 if len(ranges) <= TASKS else min(TASK_BYTES, -(-total // TASKS))
    tasks: list[Ranges] = []
    held = 0
    for r in ranges:
        if not tasks or held + r.end - r.start > most:
            tasks.append(Ranges([]))
            held = 0
        tasks[-1].ranges.append(r)
        held += r.end - r.start
    return tasks


def _store(path: str):
    from pyarrow import fs

    uri = re.sub(r"^s3a:", "s3:", re.sub(r"^file:/+", "file:///", path))
    return fs.FileSystem.from_uri(uri) if "://" in uri else (fs.LocalFileSystem(), uri)


class _Text:
    """A window over a file that grows to the right."""

    def __init__(self, handle, start: int, end: int, size: int) -> None:
        self.handle, self.start, self.end, self.size = handle, start, end, size
        self.data = b""

    def more(self) -> bool:
        at = self.start + len(self.data)
        if at >= self.size:
            return False
        self.handle.seek(at)
        wanted = max(LEAST_READ, min(READ_BYTES, self.end - at), len(self.data))
        self.data += self.handle.read(min(wanted, self.size - at))
        return True

    def drop(self, n: int) -> None:
        self.data, self.start = self.data[n:], self.start + n


def _object_end(data: bytes, at: int) -> int | None:
    """Where the object that opens at ``at`` ends; None if it is not complete, -1 if braces do not match."""
    depth, inside = 0, False
    for m in _MARKS.finditer(data, at):
        c = m.group()
        if inside:
            inside = c != b'"'
        elif c == b'"':
            inside = True
        elif c in b"{[":
            depth += 1
        elif c in b"}]":
            depth -= 1
            if not depth:
                return m.end()
            if depth < 0:
                return -1
    return None


_MARKS = re.compile(rb'\\.|["{}\[\]]', re.S)
_OPEN = re.compile(rb'\{\s*"(?!type"\s*:\s*"FeatureCollection")')  # a collection is no candidate where it says so first


def _feature(data: bytes) -> dict | None:
    try:
        found = json.loads(data)
    except ValueError:
        return None
    return found if isinstance(found, dict) and found.get("type") == "Feature" and "geometry" in found else None


def features_between(handle, start: int, end: int, size: int, longest: int) -> Iterator[tuple[int, dict]]:
    """(offset, feature) of all features whose brace lies in the range.

    An object longer than ``longest`` bytes is taken for a collection, not a feature.
    """
    text, at = _Text(handle, start, end, size), 0
    while True:
        m = _OPEN.search(text.data, at)
        if m is None:
            at = max(at, len(text.data) - 4096)  # an opening with very much white space aside, none is cut
            if text.start + at >= end or not text.more():
                return
            continue
        at = m.start()
        if text.start + at >= end:
            return
        stop = _object_end(text.data, at)
        while stop is None and len(text.data) - at < longest and text.more():
            stop = _object_end(text.data, at)
        found = _feature(text.data[at:stop]) if stop is not None and stop > 0 else None
        if found is None or not _between_members(text, stop):
            at += 1
            continue
        yield text.start + at, found
        at = stop
        if at > len(text.data) // 2:  # now and then, as what is left is copied
            text.drop(at)
            at = 0


def _between_members(text: _Text, stop: int) -> bool:
    """Behind a member of a collection comes ``]``, or a comma and the next object; behind a lone feature nothing."""
    while True:
        rest = text.data[stop : stop + 4096].lstrip(_BLANK)
        if rest[:1] == b",":
            rest = rest[1:].lstrip(_BLANK)
            if rest:
                return rest[:1] == b"{"
        elif rest:
            return rest[:1] == b"]"
        if not text.more():
            return True


class FeatureReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.path = options["path"]
        self.range_bytes = int(options.get("rangebytes", RANGE_BYTES))
        self.longest = int(options.get("longestfeature", 64 << 20))

    def partitions(self) -> list[Range]:
        from pyarrow import fs

        store, base = _store(self.path)
        info = store.get_file_info(base)
        if info.type == fs.FileType.NotFound:
            raise FileNotFoundError(self.path)
        files = [info] if info.type == fs.FileType.File else store.get_file_info(fs.FileSelector(base, recursive=True))
        files = [f for f in files if f.type == fs.FileType.File and f.path.endswith((".geojson", ".json"))]
        return _dealt([Range(f.path, s, min(s + self.range_bytes, f.size)) for f in sorted(files, key=lambda f: f.path) for s in range(0, f.size, self.range_bytes)])

    def read(self, partition: Ranges) -> Iterator[pa.RecordBatch]:
        if partition is None:
            return
        store, _ = _store(self.path)
        rows = []
        for path, ranges in groupby(partition.ranges, key=lambda r: r.path):
            with store.open_input_file(path) as handle:
                size = handle.size()
                for r in ranges:
                    for offset, f in features_between(handle, r.start, r.end, size, self.longest):
                        rows.append((path, offset, json.dumps(f.get("properties"), ensure_ascii=False), json.dumps(f["geometry"])))
                        if len(rows) == 2000:
                            yield _batch(rows)
                            rows = []
        if rows:
            yield _batch(rows)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    path, offset, properties, geometry = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays(
        [pa.array(path), pa.array(offset, pa.int64()), pa.array(properties), pa.array(geometry)], names=["path", "offset", "properties", "geometry"]
    )


class FeatureSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "geojson_features"

    def schema(self) -> str:
        return ROWS

    def reader(self, schema) -> FeatureReader:
        return FeatureReader(self.options)


def scan_features(spark: SparkSession, path: str, properties: dict[str, str] | None = None, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Features of GeoJSON files: (properties..., kind, lon, lat, rings).

    Points fill ``lon`` and ``lat``, polygons and multipolygons ``rings``; other
    geometries have neither. The folder must be reachable through Arrow's file
    systems (``file``, ``hdfs``, ``s3``); ``scan_geojson_points`` reads whatever
    Spark reads, one task a file.
    """
    spark.dataSource.register(FeatureSource)
    rows = spark.read.format("geojson_features").option("rangeBytes", range_bytes).load(path)
    fields = ", ".join(f"`{k}` {v}" for k, v in (properties or {"class": "int"}).items())
    kind = F.get_json_object("geometry", "$.type")
    rows = rows.select(F.from_json("properties", fields).alias("p"), kind.alias("kind"), "geometry")

    def read(ddl: str) -> Column:
        return F.from_json("geometry", f"coordinates {ddl}")["coordinates"]

    def rings(parts: Column) -> Column:
        return F.transform(parts, lambda r: F.transform(r, lambda p: point(p[0], p[1])))

    at = F.when(F.col("kind") == "Point", read("array<double>"))
    many = F.when(F.col("kind") == "Polygon", rings(read("array<array<array<double>>>"))).when(
        F.col("kind") == "MultiPolygon", rings(F.flatten(read("array<array<array<array<double>>>>")))
    )
    return rows.select("p.*", "kind", at[0].alias("lon"), at[1].alias("lat"), many.cast(RINGS).alias("rings"))
