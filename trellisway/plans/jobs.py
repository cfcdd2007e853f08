"""Whole analyses as compositions of the operators: what the command-line entry points of a toolkit would run."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.decay import Decay
from ..operators import access as A
from ..operators import choice as M
from ..operators import demand as Q
from ..operators import network as N
from ..operators import paths as P
from ..operators import spatial as S
from ..operators.corridor import corridors
from ..sources import sinks as K
from ..sources import tables as R


def build_network(edges: DataFrame, volumes: DataFrame | None = None) -> DataFrame:
    """Directed links with volumes both ways, crossings, and modes only where a mode's network hangs together.

    volumes: ``(link_id, aadt_fwd)`` counted on the links; without them the edges' own ``aadt_fwd`` counts, or 0.
    """
    links = N.directed_links(edges)
    extra = [c for c in ("osm_id", "name", "limit_mph", "aadt_fwd") if c in edges.columns]
    links = links.join(edges.select("edge_id", *extra), "edge_id")
    if volumes is not None:
        links = links.drop("aadt_fwd").join(volumes, "link_id", "left")
    links = links.withColumn("aadt_fwd", F.coalesce("aadt_fwd", F.lit(0.0)) if "aadt_fwd" in links.columns else F.lit(0.0))
    links = N.with_opposite_volume(links)
    if {"osm_id", "name", "limit_mph"} <= set(links.columns):
        links = links.join(N.crossing_attributes(links), "link_id")
    for mode in ("walk", "bike", "car"):
        links = N.mark_disconnected(links, mode)
    return links


def snapped(trips: DataFrame, links: DataFrame, cell: float, *places: str) -> DataFrame:
    """Adds ``<place>_node``: the end node of the nearest of straight links ``(link, ax, ay, bx, by, b)``."""
    for place in places:
        points = trips.select(F.col("trip_id").alias("point"), F.col(f"{place}_x").alias("x"), F.col(f"{place}_y").alias("y"))
        near = S.nearest_link(points, links, cell).select(F.col("point").alias("trip_id"), F.col("best").alias("link"))
        ends = near.join(links.select("link", F.col("b").alias(f"{place}_node")), "link").drop("link")
        trips = trips.join(ends, "trip_id", "left")
    return trips


def route_trips(trips: DataFrame, costed: dict[str, DataFrame], attributes: dict[str, Column]) -> DataFrame:
    """Long rows ``(trip_id, route, cost, time, dist, <attributes>)``, a route per named cost.

    trips: ``(trip_id, origin_node, target_node)``. costed: links ``(a, b, cost, time, dist, ...)`` by the route's name. Trips of
    the same pair share a tree and a path; those without a path have no row.
    """
    pairs = trips.select("trip_id", F.col("origin_node").alias("origin"), F.col("target_node").alias("target")).dropna()
    out = None
    for name, links in costed.items():
        found = P.paths(links, pairs)
        sums = A.path_indicators(P.path_links(found), links, attributes)
        rows = pairs.join(found.drop("nodes"), ["origin", "target"]).join(sums, ["origin", "target"], "left").withColumn("route", F.lit(name))
        out = rows if out is None else out.unionByName(rows)
    return out.drop("origin", "target")


def sample_routes(trips: DataFrame, links: DataFrame, ranges: dict[str, tuple[float, float]], draws: int, seed: int = 1) -> tuple[DataFrame, DataFrame]:
    """``(draws, counts)``: the weights drawn uniformly from each attribute's range, and the distinct paths of each trip.

    One job over draws times origins; counts are ``(trip_id, routes, paths)``.
    """
    spark = trips.sparkSession
    drawn = spark.range(1, draws + 1).select(
        F.col("id").alias("draw"), F.array(*(F.lit(lo) + (hi - lo) * S.uniform(F.lit(seed), F.col("id"), F.lit(n)) for n, (lo, hi) in ranges.items())).alias("weights")
    )
    pairs = trips.select("trip_id", F.col("origin_node").alias("origin"), F.col("target_node").alias("target")).dropna()
    found = P.sampled_paths(links, pairs, drawn, list(ranges))
    each = found.groupBy("origin", "target", "nodes").agg(F.count("*").alias("n"))
    totals = each.groupBy("origin", "target").agg(F.sum("n").alias("routes"), F.count("*").alias("paths"))
    return drawn, pairs.join(totals, ["origin", "target"]).select("trip_id", "routes", "paths")


def corridor_table(trips: DataFrame, links: DataFrame, limit: float = 1.25) -> DataFrame:
    """``(trip_id, a, b, detour)`` of the links in each trip's corridor; trips of one pair share it."""
    pairs = trips.select("trip_id", F.col("origin_node").alias("origin"), F.col("target_node").alias("target"))
    return pairs.join(corridors(links, pairs, limit), ["origin", "target"]).select("trip_id", "a", "b", "detour")


def boundary_counts(trips: DataFrame) -> DataFrame:
    """Trips by purpose and mode, and how many start, end and do both inside."""
    o, t = F.coalesce("inside_origin", F.lit(False)), F.coalesce("inside_target", F.lit(False))
    return trips.groupBy("target_purpose", "mode").agg(F.count("*").alias("n"), F.count_if(o).alias("n_origin"), F.count_if(t).alias("n_target"), F.count_if(o & t).alias("n_both"))


def accessibility(links: DataFrame, origins: DataFrame, locations: DataFrame, decay: Decay, alpha: dict[str, float] | None = None, two_way: bool = False) -> DataFrame:
    """``(origin, set, accessibility, normalised_accessibility)``; ``alpha`` is the power of the weights by set, 1 if not given."""
    power = F.create_map(*(x for s, a in (alpha or {"": 1.0}).items() for x in (F.lit(s), F.lit(float(a)))))
    weighed = locations.withColumn("weight", F.pow("weight", F.coalesce(power[F.col("set")], F.lit(1.0))))
    weighed = A.check_weights(weighed)
    if not two_way:
        return A.normalised(A.accessibility(links, origins, weighed, decay))
    return A.normalised(A.node_accessibility(P.two_way_tree(links, origins), weighed, decay, origins))


def intervention(links: DataFrame, candidates: DataFrame, population: DataFrame, locations: DataFrame, decay: Decay, places: int) -> DataFrame:
    """``(set, iteration, node, demand)``, new destinations of each set one after the other, of its upper-median weight."""
    both = P.two_way_tree(links, candidates).checkpoint()
    weights = {r["set"]: r["weight"] for r in A.new_destination_weight(locations).collect()}  # one row per destination set
    out = None
    for name, weight in sorted(weights.items()):
        supply = A.node_accessibility(both, locations.filter(F.col("set") == name), decay).select(F.col("origin").alias("node"), F.col("accessibility").alias("access"))
        found = A.allocate(both, population, supply, weight, decay, places).withColumn("set", F.lit(name))
        out = found if out is None else out.unionByName(found)
    return out


def census_volumes(flows: DataFrame, zone_nodes: DataFrame, links: DataFrame, scale: float = 1.0, seed: int = 1) -> DataFrame:
    """``(a, b, trips)`` on the links when every trip of ``flows (o, d, trips)`` goes between nodes drawn in its zones."""
    made = Q.expand(flows, "trips", "o", "d", scale=scale)
    nodes = zone_nodes.groupBy("zone").agg(F.array_sort(F.collect_set("node")).alias("nodes"))
    pick = lambda key: F.get("nodes", F.floor(S.uniform(F.lit(seed), "o", "d", "n", F.lit(key)) * F.size("nodes")).cast("int"))
    for end, zone in (("origin", "o"), ("target", "d")):
        made = made.join(nodes.withColumnRenamed("zone", zone), zone).withColumn(end, pick(end)).drop("nodes")
    found = P.paths(links, made.filter("origin <> target").select("origin", "target").distinct())
    return A.link_volumes(P.path_links(found), made)


def hourly_table(spark: SparkSession, events: str, vehicles: str, links: DataFrame, scale: float = 1.0) -> DataFrame:
    """Volumes by link and hour from an event log and a vehicles file, 0 where nothing passed."""
    seen = R.read_events(spark, events).filter("kind = 'enter'")
    return N.volumes_dense(links, N.volumes_hourly(seen, R.read_vehicles(spark, vehicles), scale))


def plans(flows: DataFrame, zones: DataFrame, minutes: DataFrame, scale: float = 1.0, region_contains=None) -> DataFrame:
    """Trips with points inside their zones and a time of the day, from flows ``(period, uc, o, d, trips)``.

    All trips of a flow share its two points. Flows of external classes keep only trips that leave or enter the region, where its
    ``(x, y) -> Column`` predicate is given (A25). The start is the drawn middle of the trip less half its free time, at 50 km/h in a
    straight line.
    """
    daily = Q.period_factors(flows)
    made = Q.expand(daily, "daily", "period", "uc", "o", "d", scale=scale)
    ends = daily.select("period", "uc", "o", "d", F.concat_ws("|", "period", "uc", "o", "d").alias("id"))
    spots = ends.select("id", F.col("o").alias("zone"))
    from_ = S.random_points(spots, zones).select("id", F.col("x").alias("origin_x"), F.col("y").alias("origin_y"))
    to = S.random_points(ends.select(F.concat("id", F.lit("|to")).alias("id"), F.col("d").alias("zone")), zones)
    to = to.select(F.expr("substring(id, 1, length(id) - 3)").alias("id"), F.col("x").alias("target_x"), F.col("y").alias("target_y"))
    timed = Q.sample_times(made.withColumn("id", F.concat_ws("|", "period", "uc", "o", "d")), minutes, "id", "n")
    free = F.hypot(F.col("target_x") - F.col("origin_x"), F.col("target_y") - F.col("origin_y")) / 13.9
    placed = timed.join(from_, "id").join(to, "id")
    if region_contains is not None:
        inside = region_contains(F.col("origin_x"), F.col("origin_y")) & region_contains(F.col("target_x"), F.col("target_y"))
        placed = placed.filter(~(F.col("external_only") & inside))
    return placed.withColumn("start", Q.departure(F.col("seconds"), free))


def estimate_or_predict(data: DataFrame, spec: M.Specification, results: str, alternatives: list[str], *keys: str) -> DataFrame:
    """Probabilities at the coefficients in a results file; without the file they are estimated and written to it first."""
    spark, names = data.sparkSession, spec.coefficients()
    if not Path(results).exists():
        found = M.estimate(data, spec)
        values = [r[1] for r in found.rows]
        Path(results).write_text("\n".join(K.estimation_lines(found, names, [(0, found.at_zero, [0.0] * len(names)), (found.rounds, found.final, values)])) + "\n")
    values = R.read_coefficients(spark, results, names) | spec.fixed
    return K.prediction_table(M.probabilities(data, spec, values), alternatives, *keys)
