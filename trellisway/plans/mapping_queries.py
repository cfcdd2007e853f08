"""Queries over stops mapped to roads; and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import mapping as M
from ..operators.demand import gated_plans
from . import derived as D
from .journey_queries import calls

PARAMS = M.MappingParams(reach=200.0, links=3, off=2.0, lost=10.0)


def stops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stops a little beside the suppliers' places."""
    return D.nodes(spark, sf_dir).select(F.col("node").alias("stop"), (F.col("x") + 3).alias("x"), (F.col("y") + 4).alias("y"))


def roads(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = D.nodes(spark, sf_dir)
    own = D.links(spark, sf_dir).select(F.expr("a * 1000003 + b").alias("link"), "a", "b", "length")
    return own.join(n.selectExpr("node AS a", "x AS ax", "y AS ay"), "a").join(n.selectExpr("node AS b", "x AS bx", "y AS by"), "b")


def q_candidates(spark, sf_dir):
    """The three links nearest to each stop."""
    found = M.candidate_links(stops(spark, sf_dir), roads(spark, sf_dir).checkpoint(), PARAMS)
    return found.select("stop", F.round("away", 6).alias("away"))


def q_mapping(spark, sf_dir):
    """The whole cost of every route of the timetable in which each order is a vehicle."""
    _, routes = M.patterns(calls(spark, sf_dir))
    mapped = M.map_routes(routes, stops(spark, sf_dir), roads(spark, sf_dir).checkpoint(), PARAMS)
    return mapped.groupBy("route").agg(F.count("*").alias("n_stops"), F.round(F.max("total"), 4).alias("total"))


def q_mapping_links(spark, sf_dir):
    """The links that the routes pass."""
    _, routes = M.patterns(calls(spark, sf_dir))
    links = roads(spark, sf_dir).checkpoint()
    return M.route_links(M.map_routes(routes, stops(spark, sf_dir), links, PARAMS).checkpoint(), links)


def q_gated(spark, sf_dir):
    """First and last link and departure of every trip, by gates around the diamond: links inside, into and out of it."""
    inside = lambda x, y: F.abs(x - 5000) + F.abs(y - 5000) < 4000.5
    a, b = inside(F.col("ax"), F.col("ay")), inside(F.col("bx"), F.col("by"))
    links = roads(spark, sf_dir).select("*", (F.col("length") / 2).alias("time"), (a & b).alias("internal"), (~a & b).alias("entry"), (a & ~b).alias("exit")).checkpoint()
    at = stops(spark, sf_dir)
    trips = D.trips(spark, sf_dir).select(F.col("trip").alias("id"), F.col("start").cast("double").alias("seconds"), "origin", "target")
    trips = trips.join(at.select(F.col("stop").alias("origin"), F.col("x").alias("ox"), F.col("y").alias("oy")), "origin").join(at.select(F.col("stop").alias("target"), F.col("x").alias("dx"), F.col("y").alias("dy")), "target")
    return gated_plans(trips.select("id", "seconds", "ox", "oy", "dx", "dy"), links, inside, 400.0).select("id", "origin_link", "target_link", F.round("start", 4).alias("start"))


QUERIES = {"gated_plans": q_gated, "stop_candidates": q_candidates, "stop_mapping": q_mapping, "stop_mapping_links": q_mapping_links}

_CANDIDATES = "WITH RECURSIVE " + ",\n".join([
    D.SQL["links"], D.SQL["nodes"],
    "r AS (SELECT l.a * 1000003 + l.b AS link, l.a, l.b, length, p.x AS ax, p.y AS ay, q.x AS ex, q.y AS ey FROM links l JOIN nodes p ON p.node = l.a JOIN nodes q ON q.node = l.b)",
    "s AS (SELECT node AS stop, x + 3 AS x, y + 4 AS y FROM nodes)",
    """t AS (SELECT stop, link, a, b, length, x - ax AS px, y - ay AS py, ex - ax AS dx, ey - ay AS dy, greatest(0.0::DOUBLE, least(1.0::DOUBLE,
      coalesce(((x - ax) * (ex - ax) + (y - ay) * (ey - ay)) / nullif((ex - ax) * (ex - ax) + (ey - ay) * (ey - ay), 0), 0))) AS k FROM s CROSS JOIN r)""",
    "d AS (SELECT stop, link, a, b, length, sqrt((px - k * dx) * (px - k * dx) + (py - k * dy) * (py - k * dy)) AS away FROM t)",
    "c AS (SELECT * FROM d QUALIFY row_number() OVER (PARTITION BY stop ORDER BY away > 200, away, link) <= CASE WHEN min(away) OVER (PARTITION BY stop) <= 200 THEN 3 ELSE 1 END AND (away <= 200 OR min(away) OVER (PARTITION BY stop) > 200))",
])

_DIAMOND = "abs({0}x - 5000) + abs({0}y - 5000) < 4000.5"

ORACLE_SQL = {
    "gated_plans": _CANDIDATES + f""",
    e AS (SELECT a, b, length / 2 AS w FROM links), seeds AS (SELECT s_suppkey AS node FROM supplier), {D.SQL["tree"]}, {D.SQL["trips"]},
    g AS (SELECT link, a, b, {_DIAMOND.format("a")} AS fa, {_DIAMOND.format("e")} AS fb FROM r),
    near AS (SELECT d.stop, k.kind, arg_min(d.link, (d.away, d.link)) AS link FROM d JOIN g USING (link) JOIN (VALUES ('internal', true, true), ('entry', false, true), ('exit', true, false)) k(kind, fa, fb)
      ON k.fa = g.fa AND k.fb = g.fb GROUP BY 1, 2),
    w AS (SELECT stop, {_DIAMOND.format("")} AS inside FROM s),
    p AS (SELECT trip AS id, start, o.link AS origin_link, t.link AS target_link FROM trips JOIN w wo ON wo.stop = origin JOIN w wt ON wt.stop = target
      LEFT JOIN near o ON o.stop = origin AND o.kind = CASE WHEN wo.inside THEN 'internal' ELSE 'entry' END LEFT JOIN near t ON t.stop = target AND t.kind = CASE WHEN wt.inside THEN 'internal' ELSE 'exit' END)
    SELECT id, origin_link, target_link, round((CAST(start AS DOUBLE) - cost / 2 + 86400) % 86400, 4) AS start FROM p LEFT JOIN r x ON x.link = origin_link LEFT JOIN r y ON y.link = target_link
      LEFT JOIN tree ON tree.origin = x.a AND tree.node = y.b""",
    "stop_candidates": _CANDIDATES + " SELECT stop, round(away, 6) AS away FROM c",
    "stop_mapping": _CANDIDATES + """,
    e AS (SELECT a, b, length AS w FROM links), seeds AS (SELECT s_suppkey AS node FROM supplier), """ + D.SQL["tree"] + """,
    calls AS (SELECT l_orderkey AS vehicle, list(l_suppkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity) AS stops FROM lineitem GROUP BY 1),
    routes AS (SELECT min(vehicle) AS route, stops FROM calls GROUP BY stops),
    hop AS (SELECT DISTINCT stops[i] AS u, stops[i + 1] AS v FROM routes, unnest(range(1, len(stops))) AS x(i)),
    step AS (SELECT u, v, f.link AS f, g.link AS g, 2 * g.away + CASE WHEN f.link = g.link THEN 0 ELSE coalesce(tree.cost + g.length,
        10 * sqrt((p.x - q.x) * (p.x - q.x) + (p.y - q.y) * (p.y - q.y))) END AS cost
      FROM hop JOIN c f ON f.stop = u JOIN c g ON g.stop = v JOIN s p ON p.stop = u JOIN s q ON q.stop = v LEFT JOIN tree ON tree.origin = f.b AND tree.node = g.a),
    walk(route, i, link, cost) AS (
      SELECT route, 1, link, 2 * away FROM routes JOIN c ON c.stop = stops[1]
      UNION ALL
      SELECT walk.route, walk.i + 1, step.g, min(walk.cost + step.cost) FROM walk JOIN routes ON routes.route = walk.route AND walk.i < len(stops)
        JOIN step ON step.u = stops[walk.i] AND step.v = stops[walk.i + 1] AND step.f = walk.link GROUP BY 1, 2, 3)
    SELECT walk.route, len(stops) AS n_stops, round(min(cost), 4) AS total FROM walk JOIN routes ON routes.route = walk.route AND i = len(stops) GROUP BY 1, 2""",
}
