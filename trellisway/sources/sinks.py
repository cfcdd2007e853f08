"""Writers of results: CSV of trips, paths, volumes and matrices, estimation reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def write_csv(rows: DataFrame, path: str, mode: str = "overwrite", sep: str = ",") -> None:
    """A folder of CSV parts with headers, written by the tasks."""
    rows.write.csv(path, mode=mode, header=True, sep=sep, nullValue="null")


def trip_table(trips: DataFrame, routes: DataFrame, attributes: list[str], keys: tuple[str, ...] = ("household", "person", "trip")) -> DataFrame:
    """One row per trip and route with all attributes; those that a route lacks are "null" in the file.

    routes: ``(<keys>, route, attribute, value)``. Trips without a route keep one row. The attributes are named, so the pivot
    needs no pass over the data.
    """
    wide = routes.groupBy(*keys, "route").pivot("attribute", attributes).agg(F.first("value"))
    return trips.join(wide, list(keys), "left")


def path_lines(steps: DataFrame, edges: DataFrame, *keys: str) -> DataFrame:
    """A path's polyline ``(<keys>, points)`` from ``(<keys>, seq, edge_id, forward)`` and edges' points.

    Edges used against their direction are turned, and the point shared by two edges stays once. Edges whose ends don't meet
    are an error.
    """
    turned = F.when(F.col("forward"), F.col("points")).otherwise(F.reverse("points"))
    parts = steps.join(edges.select("edge_id", "points"), "edge_id").groupBy(*keys).agg(
        F.array_sort(F.collect_list(F.struct("seq", turned.alias("p")))).alias("parts")
    )
    meets = F.forall(F.sequence(F.lit(1), F.size("parts")), lambda i: (i == 1) | (F.element_at(F.col("parts")[i - 2]["p"], -1) == F.col("parts")[i - 1]["p"][0]))
    rest = F.flatten(F.transform("parts", lambda s, i: F.when(i == 0, s["p"]).otherwise(F.slice(s["p"], 2, F.size(s["p"])))))
    bad = F.raise_error(F.lit("edges of a path do not line up")).cast("array<struct<x:double,y:double>>")
    return parts.select(*keys, F.when(meets, rest).otherwise(bad).alias("points"))


def write_matrices(values: DataFrame, path: str) -> None:
    """Matrices ``(matrix, o, d, value)`` in long form, a folder per matrix."""
    values.repartition("matrix", "o").sortWithinPartitions("o", "d").write.mode("overwrite").partitionBy("matrix").parquet(path)


def wide_matrix(values: DataFrame, zones: list, numeric: bool = False) -> DataFrame:
    """A row per origin and a column per destination of ``(o, d, value)``, in the order of the zones or of their numbers."""
    order = sorted(zones, key=int) if numeric else list(zones)
    out = values.groupBy("o").pivot("d", order).agg(F.first("value"))
    return out.orderBy(F.col("o").cast("long")) if numeric else out


def link_volume_table(links: DataFrame, volumes: DataFrame, routes: list[str]) -> DataFrame:
    """A row per link with a column per route type of ``(link, route, trips)``; 0 where nobody goes."""
    wide = volumes.groupBy("link").pivot("route", routes).agg(F.sum("trips"))
    return links.select("link").join(wide, "link", "left").na.fill(0, routes)


def iteration_table(rows: DataFrame, iterations: int, value: str = "demand", sparse: bool = True) -> DataFrame:
    """A row per node and a column per iteration of ``(iteration, node, <value>)``; sparse keeps the first and powers of two."""
    kept = [i for i in range(iterations) if not sparse or i == 0 or i & (i - 1) == 0]
    return rows.groupBy("node").pivot("iteration", kept).agg(F.first(value))


def links_per_zone(pairs: DataFrame | None, links: DataFrame) -> DataFrame:
    """``(zone, link, length, time, gradient, vgvi_gap, stress_link, stress_jct)`` of the links that touch each zone.

    pairs: ``(zone, link)``; None where links stand with their zone already.
    """
    gap = F.greatest(F.lit(0.0), F.lit(0.81) - F.col("vgvi"))
    own = links if pairs is None else pairs.join(links, "link")
    return own.select("zone", "link", "length", "time", "gradient", gap.alias("vgvi_gap"), "stress_link", "stress_jct")


def network_table(links: DataFrame, ratings: dict[str, Column], drop_misaligned: bool | None = None) -> DataFrame:
    """Links with the named ratings. With ``points`` and the ends' coordinates, misaligned ones go or are an error.

    drop_misaligned: True leaves out links whose line doesn't start at ``ax, ay`` and end at ``bx, by``; False fails; None
    doesn't look.
    """
    out = links.withColumns(ratings)
    if drop_misaligned is None:
        return out
    first, last = F.get("points", 0), F.element_at("points", -1)
    fits = (first["x"] == F.col("ax")) & (first["y"] == F.col("ay")) & (last["x"] == F.col("bx")) & (last["y"] == F.col("by"))
    return out.filter(fits) if drop_misaligned else out.filter(F.when(fits, True).otherwise(F.raise_error(F.lit("a link does not line up")).cast("boolean")))


def estimation_lines(estimate, names: list[str], iterations: list[tuple[int, float, list[float]]]) -> list[str]:
    """An estimation's CSV: the iterations, then standard errors, t and p."""
    rows = [",".join(["Iteration", "LL", *names])]
    rows += [",".join(map(str, [i, ll, *values])) for i, ll, values in iterations]
    for at, label in ((2, "std.err"), (3, "t.test"), (4, "p.val")):
        rows.append(",".join([label, "", *("" if r[at] is None else str(r[at]) for r in estimate.rows)]))
    return rows


def prediction_table(predicted: DataFrame, alternatives: list[str], *keys: str) -> DataFrame:
    """Keys and a probability per alternative from ``p array<double>``."""
    return predicted.select(*keys, *(F.get("p", i).alias(f"p_{a}") for i, a in enumerate(alternatives)))


def path_table(paths: DataFrame, steps: DataFrame, links: DataFrame) -> DataFrame:
    """Indicators of each path ``(trip, path)``: sums over its links and the links joined by ``-``.

    steps: ``(trip, path, seq, link)``; links: ``(link, length, time, gradient, vgvi, stress_link, stress_jct)``.
    """
    total = [F.sum(c).alias(c) for c in ("length", "time", "gradient", "vgvi", "stress_link", "stress_jct")]
    ids = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "link"))), lambda s: s["link"].cast("string")), "-")
    return paths.join(steps.join(links, "link").groupBy("trip", "path").agg(*total, ids.alias("links")), ["trip", "path"], "left")


def append_samples(rows: DataFrame, path: str) -> None:
    """Add a partition of corridors or a sample's row to a folder of CSV."""
    write_csv(rows, path, mode="append")


def write_plans(trips: DataFrame, path: str) -> None:
    """Plans and networks as Parquet."""
    trips.write.mode("overwrite").parquet(path)


def write_network_xml(nodes: DataFrame, links: DataFrame, path: str, mode: str | None = None, rows_per_file: int = 100_000) -> None:
    """A network in XML, folders ``nodes`` and ``links`` of it; with ``mode`` only that mode's links, and their nodes.

    A task reads a file of XML as a whole, so a file holds at most ``rows_per_file`` elements, about 400 bytes each.

    nodes: ``(node, x, y)``; links: ``(link_id, a, b, length, freespeed, capacity, lanes, modes array, attributes map)``.
    """
    if mode is not None:
        links = links.filter(F.array_contains("modes", mode)).withColumn("modes", F.array(F.lit(mode)))
        nodes = nodes.join(links.select(F.explode(F.array("a", "b")).alias("node")).distinct(), "node", "left_semi")
    named = F.transform(F.map_entries("attributes"), lambda e: F.struct(e["key"].alias("_name"), e["value"].alias("_VALUE")))
    nodes.select(F.col("node").alias("_id"), F.col("x").alias("_x"), F.col("y").alias("_y")).write.format("xml").options(rootTag="nodes", rowTag="node", maxRecordsPerFile=rows_per_file).mode(
        "overwrite"
    ).save(f"{path}/nodes")
    links.select(
        F.col("link_id").alias("_id"), F.col("a").alias("_from"), F.col("b").alias("_to"), F.col("length").alias("_length"), F.col("freespeed").alias("_freespeed"),
        F.col("capacity").alias("_capacity"), F.col("lanes").alias("_permlanes"), F.array_join("modes", ",").alias("_modes"), F.struct(named.alias("attribute")).alias("attributes"),
    ).write.format("xml").options(rootTag="links", rowTag="link", maxRecordsPerFile=rows_per_file).mode("overwrite").save(f"{path}/links")


def write_routes(routes: DataFrame, path: str, modes: list[str], attributes: list[str]) -> None:
    """Static route data: the id, minutes by mode and attributes, as :func:`trellisway.sources.tables.read_routes` reads them.

    routes: ``(id, <mode>_time in seconds, <attributes>)``. A route that is not there stays empty.
    """
    minutes = [(F.col(f"{m}_time") / 60).alias(f"{m}_time") for m in modes]
    routes.select(F.col("id").alias("ID"), *minutes, *attributes).write.csv(path, mode="overwrite", header=True)


def histogram_table(histogram: DataFrame, bins: int = 500) -> DataFrame:
    """Every bin of a detour histogram ``(bin, n)``, 0 where it is empty, with the detour at which the bin starts."""
    every = histogram.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    return every.join(histogram, "bin", "left").select("bin", (1 + F.col("bin") / 100).alias("detour"), F.coalesce("n", F.lit(0)).alias("n"))
