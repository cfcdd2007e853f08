"""GeoPackage features as DataFrames, and the geometry encodings they need."""

from __future__ import annotations

import os
import re
import sqlite3
import struct
from collections.abc import Iterable
from pathlib import Path

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Rows of a layer that one task reads.
ROWS_PER_TASK = 50_000

_TYPES = [(r"BOOL", T.BooleanType()), (r"INT", T.LongType()), (r"REAL|DOUBLE|FLOAT", T.DoubleType()), (r"BLOB", T.BinaryType())]

POINTS = "array<struct<x:double,y:double>>"


def _points(data: bytes, at: int, order: str, n: int, dims: int) -> tuple[list[tuple[float, float]], int]:
    values = struct.unpack_from(f"{order}{n * dims}d", data, at)
    return [(values[i], values[i + 1]) for i in range(0, n * dims, dims)], at + 8 * n * dims


def _geometry(data: bytes, at: int) -> tuple[list[tuple[float, float]], int]:
    order = "<" if data[at] else ">"
    (code,) = struct.unpack_from(f"{order}I", data, at + 1)
    at += 5
    if code & 0x20000000:
        at += 4
    kind = code & 0xFFFF
    dims = 2 + bool(code & 0x80000000 or kind // 1000 in (1, 3)) + bool(code & 0x40000000 or kind // 1000 in (2, 3))
    kind %= 1000
    if kind == 1:
        return _points(data, at, order, 1, dims)
    (n,) = struct.unpack_from(f"{order}I", data, at)
    at += 4
    if kind == 2:
        return _points(data, at, order, n, dims)
    first: list[tuple[float, float]] = []
    for i in range(n):
        if kind == 3:
            (m,) = struct.unpack_from(f"{order}I", data, at)
            part, at = _points(data, at + 4, order, m, dims)
        else:
            part, at = _geometry(data, at)
        if i == 0 or kind in (4, 5):
            first += part
    return first, at


def corners(data: bytes | None) -> list[tuple[float, float]] | None:
    """Points of a geometry in (GeoPackage) WKB: a point, a line's points, or a polygon's outer ring.

    Of a multi-polygon the first polygon's ring counts, and lines and points of a collection follow one another. Null and
    empty geometries give null.
    """
    if not data:
        return None
    at = 0
    if data[:2] == b"GP":
        if data[3] & 0x10:
            return None
        at = 8 + (0, 32, 48, 48, 64)[data[3] >> 1 & 7]
    return _geometry(data, at)[0] or None


Rings = list[list[list[tuple[float, float]]]]
PARTS = f"array<array<{POINTS}>>"


def polygons(data: bytes | None) -> Rings | None:
    """Polygons of a geometry in (GeoPackage) WKB, each with its outer ring and its holes; those of a collection follow one another.

    Null and empty geometries give null; points and lines have no polygon.
    """
    if not data:
        return None
    at = 0
    if data[:2] == b"GP":
        if data[3] & 0x10:
            return None
        at = 8 + (0, 32, 48, 48, 64)[data[3] >> 1 & 7]
    found: Rings = []
    _collect(data, at, found)
    return found or None


def _collect(data: bytes, at: int, found: Rings) -> int:
    """Add the polygons of one geometry; returns where it ends."""
    order = "<" if data[at] else ">"
    (code,) = struct.unpack_from(f"{order}I", data, at + 1)
    at += 9 if code & 0x20000000 else 5
    kind = code & 0xFFFF
    dims = 2 + bool(code & 0x80000000 or kind // 1000 in (1, 3)) + bool(code & 0x40000000 or kind // 1000 in (2, 3))
    kind %= 1000
    if kind == 1:
        return at + 8 * dims
    (n,) = struct.unpack_from(f"{order}I", data, at)
    at += 4
    if kind == 2:
        return at + 8 * dims * n
    rings = []
    for _ in range(n):
        if kind == 3:
            (m,) = struct.unpack_from(f"{order}I", data, at)
            ring, at = _points(data, at + 4, order, m, dims)
            rings.append(ring)
        else:
            at = _collect(data, at, found)
    if kind == 3 and rings:
        found.append(rings)
    return at


def as_parts(geometry: Column) -> Column:
    """A WKB column as polygons with all their parts and holes."""

    @F.pandas_udf(PARTS)
    def convert(values):
        return values.map(lambda v: [[[{"x": x, "y": y} for x, y in ring] for ring in part] for part in polygons(bytes(v)) or []] if v is not None else None)

    return convert(geometry)


def parts_wkb(parts: Rings) -> bytes:
    """WKB of one polygon with its holes, or of several."""

    def polygon(rings):
        closed = [r if r[0] == r[-1] else [*r, r[0]] for r in rings]
        return struct.pack("<BII", 1, 3, len(closed)) + b"".join(struct.pack("<I", len(r)) + b"".join(struct.pack("<2d", *p) for p in r) for r in closed)

    return polygon(parts[0]) if len(parts) == 1 else struct.pack("<BII", 1, 6, len(parts)) + b"".join(map(polygon, parts))


def as_points(geometry: Column) -> Column:
    """A WKB column as an array of points."""

    @F.pandas_udf(POINTS)
    def convert(values):
        return values.map(lambda v: [{"x": x, "y": y} for x, y in corners(bytes(v)) or []] if v is not None else None)

    return convert(geometry)


def wkb(points: list[tuple[float, float]], kind: str) -> bytes:
    """WKB of a point, line or polygon (its ring is closed if need be)."""
    flat = lambda ps: b"".join(struct.pack("<2d", *p) for p in ps)
    if kind == "point":
        return struct.pack("<BI", 1, 1) + flat(points[:1])
    if kind == "line":
        return struct.pack("<BII", 1, 2, len(points)) + flat(points)
    if kind != "polygon":
        raise ValueError(f"unknown kind of geometry {kind}")
    ring = points if points[0] == points[-1] else [*points, points[0]]
    return struct.pack("<BIII", 1, 3, 1, len(ring)) + flat(ring)


def _open(path: str) -> sqlite3.Connection:
    return sqlite3.connect(f"file:{path.removeprefix('file://')}?mode=ro&immutable=1", uri=True)


def _name(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def _files(path: str) -> list[str]:
    """The GeoPackage itself, or those of a folder."""
    path = path.removeprefix("file://")
    return sorted(str(p) for p in Path(path).glob("*.gpkg")) if os.path.isdir(path) else [path]


class _Rows(InputPartition):
    def __init__(self, path: str, low: int, high: int):
        self.path, self.low, self.high = path, low, high


class _Reader(DataSourceReader):
    def __init__(self, schema: T.StructType, path: str, layer: str):
        self.schema, self.path, self.layer = schema, path, layer

    def partitions(self):
        out = []
        for path in _files(self.path):
            with _open(path) as con:
                low, high = con.execute(f"SELECT min(rowid), max(rowid) FROM {_name(self.layer)}").fetchone()
            out += [] if low is None else [_Rows(path, i, min(i + ROWS_PER_TASK, high + 1)) for i in range(low, high + 1, ROWS_PER_TASK)]
        return out or [_Rows(_files(self.path)[0], 0, 0)]

    def read(self, partition: _Rows):
        columns = ", ".join(_name(f.name) for f in self.schema)
        flags = [i for i, f in enumerate(self.schema) if isinstance(f.dataType, T.BooleanType)]
        with _open(partition.path) as con:
            rows = con.execute(f"SELECT {columns} FROM {_name(self.layer)} WHERE rowid >= ? AND rowid < ?", (partition.low, partition.high))
            while batch := rows.fetchmany(5000):
                columns_of = [list(c) for c in zip(*batch, strict=True)]
                for i in flags:
                    columns_of[i] = [None if v is None else bool(v) for v in columns_of[i]]
                yield pa.RecordBatch.from_arrays([pa.array(c, _ARROW[type(f.dataType)]) for c, f in zip(columns_of, self.schema, strict=True)], names=self.schema.names)


_ARROW = {T.BooleanType: pa.bool_(), T.LongType: pa.int64(), T.DoubleType: pa.float64(), T.BinaryType: pa.binary(), T.StringType: pa.string()}


class GeoPackage(DataSource):
    """``spark.read.format("geopackage").load(path)``; the first feature layer unless option ``layer`` names one.

    Attributes keep their names and the geometry is WKB. Tasks read ranges of row ids. A folder is read as one layer of all its files, which have the
    same columns. Files must be where every executor can open them, as with any SQLite file.
    """

    @classmethod
    def name(cls) -> str:
        return "geopackage"

    def _layer(self) -> str:
        if "layer" in self.options:
            return self.options["layer"]
        with _open(_files(self.options["path"])[0]) as con:
            found = con.execute("SELECT table_name FROM gpkg_contents WHERE data_type = 'features' ORDER BY rowid LIMIT 1").fetchone()
        if not found:
            raise ValueError("no feature layer")
        return found[0]

    def schema(self) -> T.StructType:
        layer = self._layer()
        with _open(_files(self.options["path"])[0]) as con:
            geometry = con.execute("SELECT column_name FROM gpkg_geometry_columns WHERE table_name = ?", (layer,)).fetchone()
            found = con.execute(f"PRAGMA table_info({_name(layer)})").fetchall()
        fields = []
        for _, name, kind, *_ in found:
            known = next((t for p, t in _TYPES if re.search(p, kind.upper())), T.StringType())
            fields.append(T.StructField(name, T.BinaryType() if geometry and name == geometry[0] else known))
        return T.StructType(fields)

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return _Reader(schema, self.options["path"], self._layer())


def read_features(spark: SparkSession, path: str, id_column: str | None = None, layer: str | None = None, areas: bool = False) -> DataFrame:
    """Features with ``points`` beside their attributes, or with the ``parts`` of polygons where ``areas`` is asked for.

    Ids that repeat are an error where ``id_column`` is given.
    """
    spark.dataSource.register(GeoPackage)
    reader = spark.read.format("geopackage").option("path", path)
    if layer:
        reader = reader.option("layer", layer)
    rows = reader.load()
    geometry = next((f.name for f in rows.schema if isinstance(f.dataType, T.BinaryType)), None)
    if geometry:
        rows = (rows.withColumn("parts", as_parts(F.col(geometry))) if areas else rows.withColumn("points", as_points(F.col(geometry)))).drop(geometry)
    if id_column:
        n = F.count("*").over(Window.partitionBy(id_column))
        bad = F.raise_error(F.concat(F.lit("repeated feature id "), F.col(id_column).cast("string")))
        rows = rows.withColumn("_n", n).withColumn(id_column, F.when(F.col("_n") == 1, F.col(id_column)).otherwise(bad.cast(rows.schema[id_column].dataType))).drop("_n")
    return rows


def read_boundary(spark: SparkSession, path: str) -> Rings:
    """The parts of the first feature, one row; what :func:`spatial.inside_boundary` takes."""
    row = read_features(spark, path, areas=True).select("parts").first()
    if row is None or not row[0]:
        raise ValueError("no boundary")
    return [[[(p.x, p.y) for p in ring] for ring in part] for part in row[0]]


def _write(path: str, layer: str, kind: str, declared: dict[str, str], areas: bool, rows: Iterable) -> None:
    """One GeoPackage from rows by name; ``declared`` has the attributes' types."""
    names = list(declared)
    Path(path).unlink(missing_ok=True)
    with sqlite3.connect(path) as con:
        con.execute("PRAGMA application_id = 1196444487")
        con.execute("CREATE TABLE gpkg_contents (table_name TEXT PRIMARY KEY, data_type TEXT, identifier TEXT, srs_id INTEGER)")
        con.execute("CREATE TABLE gpkg_geometry_columns (table_name TEXT, column_name TEXT, geometry_type_name TEXT, srs_id INTEGER, z INTEGER, m INTEGER)")
        con.execute("INSERT INTO gpkg_contents VALUES (?, 'features', ?, 0)", (layer, layer))
        con.execute("INSERT INTO gpkg_geometry_columns VALUES (?, 'geom', 'GEOMETRY', 0, 0, 0)", (layer,))
        con.execute(f"CREATE TABLE {_name(layer)} (fid INTEGER PRIMARY KEY, geom BLOB{''.join(f', {_name(c)} {t}' for c, t in declared.items())})")
        marks = ", ".join("?" * (len(names) + 1))
        head = b"GP\x00\x01\x00\x00\x00\x00"

        def values():
            for row in rows:
                found = row["parts"] if areas else row["points"]
                body = None if not found else parts_wkb([[[(p["x"], p["y"]) for p in r] for r in part] for part in found]) if areas else wkb([(p["x"], p["y"]) for p in found], kind)
                yield (None if body is None else head + body, *(row[c] for c in names))

        con.executemany(f"INSERT INTO {_name(layer)} (geom{''.join(f', {_name(c)}' for c in names)}) VALUES ({marks})", values())


def _declared(rows: DataFrame) -> dict[str, str]:
    kinds = {"bigint": "INTEGER", "int": "INTEGER", "double": "REAL", "boolean": "BOOLEAN"}
    return {c: kinds.get(t, "TEXT") for c, t in rows.dtypes if c not in ("points", "parts")}


def write_features(rows: DataFrame, path: str, layer: str, kind: str, max_rows: int = 1_000_000) -> int:
    """One GeoPackage file from rows with ``points`` or ``parts``, through the driver, for results of a checked size.

    A GeoPackage is one SQLite file with one writer. Rows beyond ``max_rows`` are an error before any is fetched: write a file a task by
    :func:`write_feature_files`, or Parquet with a WKB column by :func:`with_wkb`. Returns the number of rows.
    """
    n = rows.count()
    if n > max_rows:
        raise ValueError(f"{n} rows are too many for one file; write Parquet")
    _write(path, layer, kind, _declared(rows), "parts" in rows.columns, rows.toLocalIterator())
    return n


def write_feature_files(rows: DataFrame, folder: str, layer: str, kind: str) -> int:
    """K02, K06 to K09 for results of any size: a GeoPackage a task in a folder that all executors share, read again as one layer. Returns the number of rows."""
    declared, areas = _declared(rows), "parts" in rows.columns

    def write(batches):
        held, n = TaskContext.get(), 0

        def listed():
            nonlocal n
            for batch in batches:
                n += batch.num_rows
                yield from batch.to_pylist()

        path = f"{folder}/part-{held.partitionId():05d}.gpkg"
        _write(f"{path}.{held.taskAttemptId()}", layer, kind, declared, areas, listed())
        os.replace(f"{path}.{held.taskAttemptId()}", path)  # whole or not at all, and once for a task that is run again
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], names=["n"])

    n = rows.mapInArrow(write, "n long").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]
    if not _files(folder):  # no task
        _write(f"{folder}/part-00000.gpkg", layer, kind, declared, areas, [])
    return n


def with_wkb(rows: DataFrame, kind: str = "polygon") -> DataFrame:
    """Adds ``geometry`` in WKB to rows with ``points`` or ``parts``, for Parquet sinks of any size."""

    @F.pandas_udf("binary")
    def convert(values):
        return values.map(lambda ps: wkb([(p["x"], p["y"]) for p in ps], kind) if ps is not None and len(ps) else None)

    @F.pandas_udf("binary")
    def convert_parts(values):
        return values.map(lambda v: parts_wkb([[[(p["x"], p["y"]) for p in r] for r in part] for part in v]) if v is not None and len(v) else None)

    return rows.withColumn("geometry", convert_parts("parts") if "parts" in rows.columns else convert("points"))
