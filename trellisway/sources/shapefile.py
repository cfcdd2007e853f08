"""Shapefiles as a Spark data source: partitions come from the record index, and tasks read ranges of the main and the attribute file."""

from __future__ import annotations

import struct

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .geopackage import as_parts, as_points, parts_wkb, wkb

#: Records that one task reads.
RECORDS_PER_TASK = 50_000

_POINT, _LINE, _POLYGON = 1, 3, 5


def _open(path: str):
    files, where = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)
    return files.open_input_file(where)


def _beside(path: str, ending: str) -> str:
    return path[: -len(".shp")] + ending if path.lower().endswith(".shp") else path + ending


def _fields(head: bytes, encoding: str) -> tuple[list[tuple[str, str, int, int]], int, int, int]:
    """Attributes ``(name, type, offset, length)`` of a .dbf header, the rows, and the lengths of header and row."""
    rows, start, width = struct.unpack_from("<IHH", head, 4)
    out, at, offset = [], 32, 1
    while head[at] != 0x0D:
        name = head[at : at + 11].split(b"\0")[0].decode(encoding)
        length, digits = head[at + 16], head[at + 17]
        kind = chr(head[at + 11])
        out.append((name, "long" if kind in "NF" and not digits and kind == "N" and length < 19 else "double" if kind in "NF" else "boolean" if kind == "L" else "string", offset, length))
        at, offset = at + 32, offset + length
    return out, rows, start, width


def _value(raw: bytes, kind: str, encoding: str):
    text = raw.decode(encoding).strip("\0 ")
    if kind == "string":
        return text or None
    if not text or set(text) == {"*"}:
        return None
    if kind == "boolean":
        return {"T": True, "Y": True, "F": False, "N": False}.get(text.upper())
    return int(text) if kind == "long" else float(text)


def _turn(ring: list[tuple[float, float]]) -> float:
    """Twice the area of a ring, negative with the clock, as outer rings are here."""
    return sum(x0 * y1 - x1 * y0 for (x0, y0), (x1, y1) in zip(ring, ring[1:] + ring[:1], strict=True))


def _holds(ring: list[tuple[float, float]], x: float, y: float) -> bool:
    hit = False
    for (ax, ay), (bx, by) in zip(ring, ring[1:] + ring[:1], strict=True):
        if (ay > y) != (by > y) and x < ax + (y - ay) / (by - ay) * (bx - ax):
            hit = not hit
    return hit


def geometry(record: bytes) -> bytes | None:
    """WKB of a record's shape: a point, the parts of a line one after the other, or polygons with their holes. Null shapes give null.

    Rings with the clock are outer ones; a ring against it is a hole of the smallest outer ring that holds its first corner, or else a part.
    """
    (kind,) = struct.unpack_from("<i", record)
    kind %= 10  # kinds with heights and measures have the same plan
    if kind == 0:
        return None
    if kind == _POINT:
        return wkb([struct.unpack_from("<2d", record, 4)], "point")
    if kind not in (_LINE, _POLYGON):
        raise ValueError(f"shapes of kind {kind} are neither points, lines nor polygons")
    n_parts, n_points = struct.unpack_from("<2i", record, 36)
    starts = [*struct.unpack_from(f"<{n_parts}i", record, 44), n_points]
    flat = struct.unpack_from(f"<{2 * n_points}d", record, 44 + 4 * n_parts)
    points = list(zip(flat[::2], flat[1::2], strict=True))
    rings = [points[a:b] for a, b in zip(starts, starts[1:], strict=False) if b > a]
    if not rings:
        return None
    if kind == _LINE:
        return wkb([p for r in rings for p in r], "line")
    outer = [r for r in rings if _turn(r) <= 0]
    parts = [[r] for r in outer]
    for hole in (r for r in rings if _turn(r) > 0):
        around = [i for i, r in enumerate(outer) if _holds(r, *hole[0])]
        if around:
            parts[min(around, key=lambda i: abs(_turn(outer[i])))].append(hole)
        else:
            parts.append([hole])
    return parts_wkb(parts)


class _Records(InputPartition):
    def __init__(self, first: int, last: int):
        self.first, self.last = first, last


class _Reader(DataSourceReader):
    def __init__(self, schema: T.StructType, path: str, encoding: str, per_task: int):
        self.schema, self.path, self.encoding, self.per_task = schema, path, encoding, per_task

    def partitions(self):
        with _open(_beside(self.path, ".shx")) as index:
            n = (index.size() - 100) // 8
        return [_Records(i, min(i + self.per_task, n)) for i in range(0, n, self.per_task)] or [_Records(0, 0)]

    def read(self, partition: _Records):
        n = partition.last - partition.first
        if not n:
            return
        with _open(_beside(self.path, ".shx")) as index:
            places = struct.unpack(f">{2 * n}i", index.read_at(8 * n, 100 + 8 * partition.first))
        with _open(_beside(self.path, ".dbf")) as table:
            size = struct.unpack("<H", table.read_at(2, 8))[0]
            fields, _, start, width = _fields(table.read_at(size, 0), self.encoding)
            rows = table.read_at(n * width, start + partition.first * width)
        known = {f[0]: f for f in fields}
        with _open(self.path) as shapes:
            for low in range(0, n, 5000):
                high = min(low + 5000, n)
                begin, end = 2 * places[2 * low], 2 * (places[2 * high - 2] + places[2 * high - 1]) + 8
                body, columns = shapes.read_at(end - begin, begin), []
                for f in self.schema:
                    if f.name == "geometry":
                        columns.append(pa.array([geometry(body[2 * places[2 * i] - begin + 8 : 2 * (places[2 * i] + places[2 * i + 1]) - begin + 8]) for i in range(low, high)], pa.binary()))
                    else:
                        _, kind, at, length = known[f.name]
                        columns.append(pa.array([_value(rows[i * width + at : i * width + at + length], kind, self.encoding) for i in range(low, high)], _ARROW[kind]))
                yield pa.RecordBatch.from_arrays(columns, names=self.schema.names)


_ARROW = {"long": pa.int64(), "double": pa.float64(), "boolean": pa.bool_(), "string": pa.string()}
_TYPES = {"long": T.LongType(), "double": T.DoubleType(), "boolean": T.BooleanType(), "string": T.StringType()}


class Shapefile(DataSource):
    """``spark.read.format("shapefile").load(path)`` of a .shp file with its .shx and .dbf beside it.

    Attributes keep their names, and ``geometry`` is WKB. Tasks read runs of ``recordsPerTask`` records, which must lie in the order of their
    index. ``encoding`` is that of the attributes. Paths need a scheme that ``pyarrow.fs`` can read, or are local ones that all executors see.
    """

    @classmethod
    def name(cls) -> str:
        return "shapefile"

    def schema(self) -> T.StructType:
        with _open(_beside(self.options["path"], ".dbf")) as table:
            size = struct.unpack("<H", table.read_at(2, 8))[0]
            fields, *_ = _fields(table.read_at(size, 0), self.options.get("encoding", "utf-8"))
        return T.StructType([*(T.StructField(name, _TYPES[kind]) for name, kind, _, _ in fields), T.StructField("geometry", T.BinaryType())])

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return _Reader(schema, self.options["path"], self.options.get("encoding", "utf-8"), int(self.options.get("recordsPerTask", RECORDS_PER_TASK)))


def read_shapes(spark: SparkSession, path: str, areas: bool = True, encoding: str = "utf-8", per_task: int = RECORDS_PER_TASK) -> DataFrame:
    """The records of a shapefile with ``parts`` of polygons, or ``points`` of other shapes, beside their attributes."""
    spark.dataSource.register(Shapefile)
    rows = spark.read.format("shapefile").option("path", path).option("encoding", encoding).option("recordsPerTask", per_task).load()
    shape = as_parts(F.col("geometry")).alias("parts") if areas else as_points(F.col("geometry")).alias("points")
    return rows.select(*(c for c in rows.columns if c != "geometry"), shape)
