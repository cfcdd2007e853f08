"""Readers of text and XML inputs: diaries, places, pairs, census matrices, networks, events, choices, routes."""

from __future__ import annotations

import csv
from itertools import islice

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Modes of a diary and what they are counted as; anything else is "other".
MODES = {
    "Walk": "walk", "Walking": "walk", "Bicycle": "bike", "Motorcycle": "motorcycle", "Motorcycle, scooter, moped": "motorcycle",
    "Car or van driver": "car", "Vehicle Driver": "car", "Train": "train", "2+ Train": "train", "Taxi": "taxi",
    "Taxi, minicab": "taxi", "Public Bus": "pt", "School Bus": "pt", "Tram": "pt",
}

# Purposes of a diary.
PURPOSES = {
    "Home": "home",
    "Usual place of work": "work",
    "Education as pupil, student": "education",
    "Visit friends or relatives": "visit_friends_or_family",
    "Shopping Food": "shopping_food",
    "Shopping Non food": "shopping_non_food",
    "Escorting to place of work, pick-up, drop-off": "escort_work",
    "Escorting to place of education, pick-up, drop-off": "escort_education",
    "Childcare  taking or collecting child to or from babysitter, nursery etc": "escort_childcare",
    "Accompanying or giving lift to other person, not school, or work": "escort_other",
    "Use Services, Personal Business, bank, hairdresser, library etc": "personal_business",
    "Health or medical visit": "medical",
    "Social - Entertainment, recreation, Participate in sport, pub, restaurant": "social",
    "Work - Business, other": "business_trip",
    "Moving people or goods in connection with employment": "business_transport",
    "Worship or religious observance": "worship",
    "Round trip walk, cycle, drive for enjoyment": "recreational_round_trip",
    "Unpaid, voluntary work": "volunteering",
    "Tourism, sightseeing": "tourism",
    "Staying at hotel or other temporary accommodation": "temporary_accommodation",
    "Other": "other",
    "NR": "no_response",
}

# Modes of a census matrix; anything else is an error.
CENSUS_MODES = {"On foot": "walk", "Bicycle": "bike", "Driving a car or van": "car"}


def recode(value: str | Column, table: dict[str, str], default: str | None = None, what: str = "value") -> Column:
    """A label's code; others take the default, and are an error without one. NULL stays NULL."""
    c = F.col(value) if isinstance(value, str) else value
    found = F.create_map(*(F.lit(x) for pair in table.items() for x in pair))[c]
    other = F.lit(default) if default is not None else F.raise_error(F.concat(F.lit(f"unknown {what} "), c)).cast("string")
    return F.when(c.isNotNull(), F.coalesce(found, other))


def read_diary(spark: SparkSession, path: str, columns: dict[str, str], sep: str = ",", where: str | None = None, purposes: dict[str, str] = PURPOSES) -> DataFrame:
    """Trips from a delimited file with a header.

    columns: our name -> the file's. household, person and trip are needed; start, mode, origin_purpose, target_purpose, the
    ``*_zone`` and the ``*_x``, ``*_y`` of home, main, origin and target are taken where given. ``where`` filters in the file's
    own names. Unreadable coordinates are null, and so is the place; the start is a whole number, else the whole part of a
    decimal, else 28800. An unknown purpose is an error.
    """
    raw = spark.read.csv(path, header=True, sep=sep, quote='"', escape='"')
    if where:
        raw = raw.filter(where)
    if missing := {"household", "person", "trip"} - set(columns):
        raise ValueError(f"missing columns {sorted(missing)}")

    def one(name: str) -> Column:
        c = F.col(f"`{columns[name]}`")
        if name in ("person", "trip"):
            return c.cast("int")
        if name == "start":
            return F.coalesce(c.try_cast("int"), F.floor(c.try_cast("double")).cast("int"), F.lit(28_800))
        if name == "mode":
            return recode(c, MODES, "other")
        if name.endswith("_purpose"):
            return recode(c, purposes, what="purpose")
        return c.try_cast("double") if name.endswith(("_x", "_y")) else c

    out = raw.select(*(one(n).alias(n) for n in columns))
    places = [n[:-2] for n in columns if n.endswith("_x") and f"{n[:-2]}_y" in columns]
    known = {p: F.col(f"{p}_x").isNotNull() & F.col(f"{p}_y").isNotNull() for p in places}
    return out.withColumns({f"{p}_{a}": F.when(known[p], F.col(f"{p}_{a}")) for p in places for a in "xy"})


def routable(trips: DataFrame, ring_contains, start: str = "origin", end: str = "target") -> DataFrame:
    """Adds ``inside_<place>`` by a ``(x, y) -> Column`` predicate, and ``routable``: both ends inside and apart.

    Without a place both are NULL.
    """
    inside = {f"inside_{p}": ring_contains(F.col(f"{p}_x"), F.col(f"{p}_y")) for p in (start, end)}
    same = (F.col(f"{start}_x") == F.col(f"{end}_x")) & (F.col(f"{start}_y") == F.col(f"{end}_y"))
    return trips.withColumns(inside).withColumn("same_place", same).withColumn("routable", F.col(f"inside_{start}") & F.col(f"inside_{end}") & ~F.col("same_place"))


def read_locations(spark: SparkSession, path: str, ring_contains=None, sep: str = ";") -> DataFrame:
    """Access points ``(id, x, y, weight)``; a repeated ID is one place with several of them. The weight is 1 if not given.

    Points outside of the boundary go first; then a place whose weights differ is an error.
    """
    raw = spark.read.csv(path, header=True, sep=sep)
    weight = F.col("WEIGHT").cast("double") if "WEIGHT" in raw.columns else F.lit(1.0)
    out = raw.select(F.col("ID").alias("id"), F.col("X").cast("double").alias("x"), F.col("Y").cast("double").alias("y"), weight.alias("weight"))
    if ring_contains is not None:
        out = out.filter(ring_contains(F.col("x"), F.col("y")))
    own = Window.partitionBy("id")
    agree = F.min("weight").over(own) == F.max("weight").over(own)
    bad = F.raise_error(F.concat(F.lit("weights differ for location "), F.col("id"))).cast("double")
    return out.withColumn("_ok", agree).withColumn("weight", F.when(F.col("_ok"), F.col("weight")).otherwise(bad)).drop("_ok")


def read_population(spark: SparkSession, path: str, nearest) -> DataFrame:
    """``(node, population)`` from a locations file whose places have one access point; the last place of a node counts.

    nearest: ``DataFrame(point, x, y) -> DataFrame(point, best)``, a node per point.
    """
    own = read_locations(spark, path)
    n = F.count("*").over(Window.partitionBy("id"))
    bad = F.raise_error(F.concat(F.lit("several access points of "), F.col("id"))).cast("string")
    one = own.withColumn("_n", n).withColumn("id", F.when(F.col("_n") == 1, F.col("id")).otherwise(bad)).drop("_n")
    met = nearest(one.select(F.col("id").alias("point"), "x", "y")).join(one.select(F.col("id").alias("point"), "weight"), "point")
    return met.groupBy(F.col("best").alias("node")).agg(F.max_by("weight", "point").alias("population"))


def read_pairs(spark: SparkSession, path: str, nodes: DataFrame) -> DataFrame:
    """``(origin, target[, ambience, stress])`` of node pairs; a pair with an unknown node is an error."""
    raw = spark.read.csv(path, header=True)
    own = raw.select(
        F.col("originNode").cast("long").alias("origin"), F.col("destinationNode").cast("long").alias("target"),
        *(F.col(c).cast("double").alias(n) for c, n in (("mcAmbience", "ambience"), ("mcStress", "stress")) if c in raw.columns),
    )
    for end in ("origin", "target"):
        at = nodes.select(F.col("node").alias(end), F.lit(True).alias("_known"))
        bad = F.raise_error(F.concat(F.lit(f"unknown {end} node "), F.col(end).cast("string"))).cast("long")
        own = own.join(at, end, "left").withColumn(end, F.when(F.col("_known"), F.col(end)).otherwise(bad)).drop("_known")
    return own


def read_census(spark: SparkSession, path: str) -> DataFrame:
    """Flows ``(mode, o, d, trips)`` of a wide matrix: mode in the seventh line, zones in the tenth, rows from the twelfth on.

    Rows end at the first blank line. Empty and zero cells are left out.
    """
    lines = spark.read.text(path).withColumn("i", F.monotonically_increasing_id())  # one file keeps the order of its lines
    head = lines.orderBy("i").limit(10).collect()
    cells = lambda line: next(csv.reader([line]))
    mode = CENSUS_MODES.get(label := cells(head[6]["value"])[1])
    if mode is None:
        raise ValueError(f'unknown mode "{label}"')
    zones = F.array(*map(F.lit, cells(head[9]["value"])[1:]))
    rows = lines.filter(F.col("i") > head[9]["i"] + 1)
    blank = rows.filter("trim(value) = ''").agg(F.min("i").alias("end"))
    parts = F.split(F.regexp_replace("value", '"', ""), ",")
    own = rows.join(F.broadcast(blank)).filter(F.col("end").isNull() | (F.col("i") < F.col("end")))  # one row on that side
    flat = own.select(parts[0].alias("o"), F.posexplode(F.slice(parts, 2, F.size(zones))).alias("k", "v"), zones.alias("z"))
    return flat.select(F.lit(mode).alias("mode"), "o", F.get("z", "k").alias("d"), F.col("v").try_cast("int").alias("trips")).filter("trips > 0")


def read_matrix(spark: SparkSession, path: str) -> DataFrame:
    """A matrix in long form ``(matrix, o, d, value)`` of Parquet, as :func:`trellisway.sources.sinks.write_matrices` writes it."""
    return spark.read.parquet(path)


def read_minutes(spark: SparkSession, path: str) -> DataFrame:
    """``(minute, weight)`` from a file with 1,440 numbers; another number of lines is an error."""
    values = [float(r[0]) for r in islice(spark.read.text(path).filter("trim(value) <> ''").toLocalIterator(), 1441)]
    if len(values) != 1440:
        raise ValueError("a day has 1440 minutes")
    return spark.createDataFrame(list(enumerate(values)), "minute int, weight double")


def read_network(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Nodes ``(node, x, y)`` and links of a network in XML; attributes of a link come as a map."""
    nodes = spark.read.format("xml").option("rowTag", "node").schema("_id string, _x double, _y double").option("recursiveFileLookup", "true").load(path)
    fields = "_id string, _from string, _to string, _length double, _freespeed double, _capacity double, _permlanes double, _modes string"
    inner = "attributes struct<attribute: array<struct<_name: string, _VALUE: string>>>"
    links = spark.read.format("xml").option("rowTag", "link").schema(f"{fields}, {inner}").option("recursiveFileLookup", "true").load(path)
    named = F.map_from_entries(F.transform("attributes.attribute", lambda a: F.struct(a["_name"], a["_VALUE"])))
    return (
        nodes.select(F.col("_id").alias("node"), F.col("_x").alias("x"), F.col("_y").alias("y")),
        links.select(
            F.col("_id").alias("link_id"), F.col("_from").alias("a"), F.col("_to").alias("b"), F.col("_length").alias("length"), F.col("_freespeed").alias("freespeed"),
            F.col("_capacity").alias("capacity"), F.col("_permlanes").alias("lanes"), F.split("_modes", ",").alias("modes"), named.alias("attributes"),
        ),
    )


def read_events(spark: SparkSession, path: str) -> DataFrame:
    """``(vehicle, link, time, kind)`` of the link events in a log in XML, gzipped or not; kind is enter or leave."""
    raw = spark.read.format("xml").option("rowTag", "event").schema("_time double, _type string, _link string, _vehicle string").load(path)
    kind = F.when(F.col("_type") == "entered link", "enter").when(F.col("_type") == "left link", "leave")
    return raw.select(F.col("_vehicle").alias("vehicle"), F.col("_link").alias("link"), F.col("_time").alias("time"), kind.alias("kind")).filter("kind is not null")


def read_vehicles(spark: SparkSession, path: str) -> DataFrame:
    """``(vehicle, type)``."""
    raw = spark.read.format("xml").option("rowTag", "vehicle").schema("_id string, _type string").load(path)
    return raw.select(F.col("_id").alias("vehicle"), F.col("_type").alias("type"))


WEEKDAYS = ["monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday"]


def service_dates(calendar: DataFrame | None, exceptions: DataFrame | None) -> DataFrame:
    """``(service_id, date)`` on which services run, dates as yyyyMMdd.

    calendar: ``(service_id, monday, ..., sunday, start_date, end_date)``, whose weeks are written out from first to last date;
    exceptions: ``(service_id, date, exception_type)``, where 1 adds a date and 2 takes it away, which holds if both are said. A
    service may stand in either or both.
    """
    found = None
    if calendar is not None:
        day = lambda c: F.to_date(F.col(c).cast("string"), "yyyyMMdd")
        runs = F.array(*(F.col(d).cast("string") == "1" for d in WEEKDAYS))
        days = calendar.filter(day("start_date") <= day("end_date")).select("service_id", runs.alias("_runs"), F.explode(F.sequence(day("start_date"), day("end_date"))).alias("_day"))
        found = days.filter(F.get("_runs", F.weekday("_day"))).select("service_id", F.date_format("_day", "yyyyMMdd").alias("date"))
    if exceptions is not None:
        own = exceptions.select("service_id", F.col("date").cast("string").alias("date"), F.col("exception_type").cast("string").alias("kind"))
        added = own.filter("kind = '1'").select("service_id", "date")
        found = (added if found is None else found.unionByName(added)).distinct()
        found = found.join(own.filter("kind = '2'").select("service_id", "date"), ["service_id", "date"], "left_anti")
    if found is None:
        raise ValueError("a feed needs calendar.txt or calendar_dates.txt")
    return found.distinct()


def _optional_csv(spark: SparkSession, path: str) -> DataFrame | None:
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    there = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place)
    return spark.read.csv(path, header=True) if there else None


def read_services(spark: SparkSession, folder: str) -> DataFrame:
    """:func:`service_dates` of a feed's calendar.txt and calendar_dates.txt, of which one may be missing."""
    return service_dates(_optional_csv(spark, f"{folder}/calendar.txt"), _optional_csv(spark, f"{folder}/calendar_dates.txt"))


def read_gtfs(spark: SparkSession, *folders: str) -> tuple[DataFrame, DataFrame]:
    """``(stops, times)`` of the day on which most trips run, of one feed or of several side by side.

    A feed's services run on the dates of :func:`read_services`. Of days with as many trips the first counts, for each
    feed by itself. Ids get the feed's number in front where there are several. stops: ``(stop, lat, lon)``; times: see
    :func:`read_gtfs_stop_times`.
    """
    stops = times = None
    for number, folder in enumerate(folders):
        trips = spark.read.csv(f"{folder}/trips.txt", header=True).select(F.col("trip_id").alias("trip"), "service_id")
        runs = trips.join(read_services(spark, folder), "service_id")
        by_day = runs.groupBy("date").agg(F.count("*").alias("n"))
        busiest = by_day.agg(F.max_by("date", F.struct("n", (-F.col("date").cast("long")).alias("early"))).alias("date"))
        today = runs.join(F.broadcast(busiest), "date").select("trip")  # one date
        here = spark.read.csv(f"{folder}/stops.txt", header=True)
        own = here.select(F.col("stop_id").alias("stop"), F.col("stop_lat").cast("double").alias("lat"), F.col("stop_lon").cast("double").alias("lon"))
        run = read_gtfs_stop_times(spark, folder).join(today, "trip", "left_semi")
        if len(folders) > 1:
            named = lambda c: F.concat(F.lit(f"{number}:"), c).alias(c)  # noqa: B023, E731
            own, run = own.select(named("stop"), "lat", "lon"), run.select(named("trip"), "seq", named("stop"), "arrival", "departure")
        stops = own if stops is None else stops.unionByName(own)
        times = run if times is None else times.unionByName(run)
    return stops, times


def read_gtfs_stop_times(spark: SparkSession, folder: str) -> DataFrame:
    """``(trip, seq, stop, arrival, departure)`` in seconds; times may pass midnight."""
    raw = spark.read.csv(f"{folder}/stop_times.txt", header=True)

    def seconds(c: str) -> Column:
        p = F.split(F.trim(c), ":")
        return p[0].cast("double") * 3600 + p[1].cast("double") * 60 + p[2].cast("double")

    return raw.select(
        F.col("trip_id").alias("trip"), F.col("stop_sequence").cast("int").alias("seq"), F.col("stop_id").alias("stop"),
        seconds("arrival_time").alias("arrival"), seconds("departure_time").alias("departure"),
    )


def read_choices(spark: SparkSession, path: str, id_column: str, choice_column: str, sep: str = ",") -> DataFrame:
    """Choice data: the id a string, the choice an int, all other columns doubles."""
    raw = spark.read.csv(path, header=True, sep=sep)
    kind = {id_column: "string", choice_column: "int"}
    return raw.select(*(F.col(f"`{c}`").cast(kind.get(c, "double")).alias(c) for c in raw.columns))


def read_coefficients(spark: SparkSession, path: str, names: list[str]) -> dict[str, float]:
    """The last iteration of an estimation's file, whose columns must be the specification's in order."""
    rows = [r[0].split(",") for r in spark.read.text(path).coalesce(1).toLocalIterator() if r[0].strip()]
    if rows[0][2:] != names:
        raise ValueError(f"coefficients {rows[0][2:]} are not {names}")
    last = [r for r in rows[1:] if r[0][:1].isdigit()][-1]
    return dict(zip(names, map(float, last[2:]), strict=True))


def read_routes(spark: SparkSession, path: str, modes: list[str], known: DataFrame, id_column: str = "ID") -> DataFrame:
    """Precomputed route data ``(id, <mode>_time, ...)``; ids must be those of ``known (id)``."""
    raw = spark.read.csv(path, header=True, inferSchema=True).withColumnRenamed(id_column, "id").withColumn("id", F.col("id").cast("string"))
    if missing := [f"{m}_time" for m in modes if f"{m}_time" not in raw.columns]:
        raise ValueError(f"missing columns {missing}")
    lost = known.select(F.col("id").cast("string").alias("id")).exceptAll(raw.select("id"))
    if not lost.isEmpty():
        raise ValueError(f"no route data for {lost.first()[0]}")
    return raw


def read_paths(spark: SparkSession, path: str) -> DataFrame:
    """Earlier paths ``(household, person, trip, path, distance, links array)``."""
    raw = spark.read.csv(path, header=True)
    return raw.select(
        F.col("IDNumber").alias("household"), F.col("PersonNumber").cast("int").alias("person"), F.col("TripNumber").cast("int").alias("trip"),
        F.col("path").cast("int").alias("path"), F.col("distance").cast("double").alias("distance"), F.split("links", "-").alias("links"),
    )


def read_edge_ids(spark: SparkSession, path: str) -> DataFrame:
    """``(edge_id)``; the header must be edgeIDs."""
    raw = spark.read.csv(path, header=True)
    if raw.columns != ["edgeIDs"]:
        raise ValueError(f"the header is {raw.columns}, not edgeIDs")
    return raw.select(F.col("edgeIDs").cast("int").alias("edge_id"))


def read_zones(spark: SparkSession, path: str, sep: str = ";") -> DataFrame:
    """``(zone, parts)`` from a delimited file with ``id`` and polygon ``wkt``, with all parts and holes."""
    raw = spark.read.csv(path, header=True, sep=sep)
    return raw.select(F.col("id").alias("zone"), parts_of("wkt").alias("parts"))


def read_feature_table(rows: DataFrame, sets: list[str]) -> DataFrame:
    """Features ``(id, points[, description, ...])`` with the columns that accessibility fills.

    The centroid is the mean of a polygon's corners where none is given; a point is its own. ``radius`` comes from a
    description ``grid_<n>m``. Features without points are an error.
    """
    bad = F.raise_error(F.lit("a feature is neither a point nor a polygon")).cast("double")
    ring = F.when((F.size("points") > 1) & (F.get("points", 0) == F.element_at("points", -1)), F.slice("points", 1, F.size("points") - 1)).otherwise(F.col("points"))

    def middle(axis: str) -> Column:
        total = F.aggregate(F.transform(ring, lambda p: p[axis]), F.lit(0.0), lambda a, v: a + v)
        own = F.when(F.col("points").isNull() | (F.size("points") == 0), bad).otherwise(total / F.size(ring))
        return F.coalesce(F.col(f"centroid_{axis}"), own) if f"centroid_{axis}" in rows.columns else own

    size = F.regexp_extract("description", r"^grid_(\d+)m$", 1).try_cast("double") if "description" in rows.columns else F.lit(None).cast("double")
    empty = {f"{kind}_{s}": F.lit(None).cast("double") for s in sets for kind in ("accessibility", "normalised")}
    return rows.withColumns({"centroid_x": middle("x"), "centroid_y": middle("y"), "radius": size, "nodes_within": F.lit(0)} | empty)


def ring_of(wkt: str | Column) -> Column:
    """Outer ring of a WKT polygon, or of the first polygon of several; an error for other kinds."""
    c = F.col(wkt) if isinstance(wkt, str) else wkt
    first = F.regexp_extract(c, r"^\s*(?:MULTI)?POLYGON[ ZM]*\s*\(+([^()]*)\)", 1)
    number = lambda p, i: F.get(F.split(F.trim(p), r"\s+"), i).cast("double")
    ring = F.transform(F.split(first, ","), lambda p: F.struct(number(p, 0).alias("x"), number(p, 1).alias("y")))
    bad = F.raise_error(F.concat(F.lit("no polygon: "), F.substring(c, 1, 40))).cast("array<struct<x:double,y:double>>")
    return F.when(c.isNull(), F.lit(None)).when(first != "", ring).otherwise(bad)


PARTS = "array<array<array<struct<x:double,y:double>>>>"


def parts_of(wkt: str | Column) -> Column:
    """Polygons, rings and corners of a WKT polygon or several; an empty one has none, and other kinds are an error."""
    c = F.col(wkt) if isinstance(wkt, str) else wkt
    kind = r"^\s*(?:MULTI)?POLYGON\s*[ZM]{0,2}\s*"
    body = F.regexp_replace(F.regexp_replace(c, kind, ""), r"^[\s(]+|[\s)]+$", "")
    number = lambda p, i: F.get(F.split(F.trim(p), r"\s+"), i).cast("double")
    corners = lambda r: F.transform(F.split(r, ","), lambda p: F.struct(number(p, 0).alias("x"), number(p, 1).alias("y")))
    polygons = F.transform(F.split(body, r"\)\s*\)\s*,\s*\(\s*\("), lambda p: F.transform(F.split(p, r"\)\s*,\s*\("), corners))
    bad = F.raise_error(F.concat(F.lit("no polygon: "), F.substring(c, 1, 40))).cast(PARTS)
    return F.when(c.isNull(), F.lit(None)).when(c.rlike(kind + "EMPTY"), F.array().cast(PARTS)).when(c.rlike(kind + r"\("), polygons).otherwise(bad)
