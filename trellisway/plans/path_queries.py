"""Queries over shortest paths: trees, accessibility, skims, detours, trips; and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.decay import Decay, percentile_beta, slope_through_origin
from ..operators import access as A
from ..operators import paths as P
from . import derived as D


def graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.links(spark, sf_dir).withColumn("cost", F.col("length"))


def origins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.nodes(spark, sf_dir).select(F.col("node").alias("origin"))


_TREE = D.with_sql("links", "e AS (SELECT a, b, length AS w FROM links)", "seeds AS (SELECT s_suppkey AS node FROM supplier)", "tree", recursive=True)
_BACK = D.with_sql("links", "e AS (SELECT b AS a, a AS b, length AS w FROM links)", "seeds AS (SELECT s_suppkey AS node FROM supplier)", "tree", recursive=True)


def q_forward(spark, sf_dir):
    return P.tree(graph(spark, sf_dir), origins(spark, sf_dir)).select("origin", "node", "cost")


def q_reverse(spark, sf_dir):
    return P.tree(graph(spark, sf_dir), origins(spark, sf_dir), reverse=True).select("origin", "node", "cost")


def q_two_way(spark, sf_dir):
    return P.two_way_tree(graph(spark, sf_dir), origins(spark, sf_dir)).select("origin", "node", "cost")


def q_cutoff(spark, sf_dir):
    return P.tree(graph(spark, sf_dir), origins(spark, sf_dir), limit=120.0).select("origin", "node", "cost")


def q_joins(spark, sf_dir):
    """The relational form for graphs too large to send, from every node up to a cost of 150."""
    return P.tree(graph(spark, sf_dir), origins(spark, sf_dir), limit=150.0, max_links=0).select("origin", "node", "cost")


def q_two_seed(spark, sf_dir):
    """Trees from both ends of every node's shortest link, the far end at half its length."""
    links = graph(spark, sf_dir).persist()  # for the seeds and for the search
    near = links.groupBy("a").agg(F.min_by(F.struct("b", "length"), F.struct("length", "b")).alias("n"))
    seed = lambda node, cost: F.struct(node.alias("node"), cost.alias("cost"), cost.alias("time"), cost.alias("dist"))
    seeds = near.select(F.col("a").alias("origin"), F.array(seed(F.col("a"), F.lit(0.0)), seed(F.col("n.b"), F.col("n.length") / 2)).alias("seeds"))
    try:
        return P.seeded_tree(links, seeds.checkpoint()).select("origin", "node", "cost")
    finally:
        links.unpersist()


def _access(decay: Decay):
    def query(spark, sf_dir):
        found = A.accessibility(D.links(spark, sf_dir).withColumnRenamed("length", "cost"), origins(spark, sf_dir), D.locations(spark, sf_dir), decay)
        return found.select("origin", "set", F.round("accessibility", 6).alias("accessibility"))

    return query


_DECAYS = {
    "node_accessibility": (Decay("exponential", beta=0.001203989 * 10), "exp(-0.01203989 * cost)", "true"),
    "accessibility_cumulative": (Decay("cumulative", cut_dist=200.0), "1.0", "cost <= 200"),
    "accessibility_power": (Decay("power", a=1.0, cut_dist=400.0), "1.0 / cost", "cost <= 400 AND cost > 0"),
    "accessibility_gaussian": (Decay("gaussian", v=57708.0), "exp(-cost * cost / 57708.0)", "true"),
    "accessibility_cumgauss": (Decay("cumulative_gaussian", a=200.0, v=57708.0), "CASE WHEN cost <= 200 THEN 1.0 ELSE exp(-(cost - 200) * (cost - 200) / 57708.0) END", "true"),
}


def q_power(spark, sf_dir):
    """Power decay of paths longer than 0, a place at the origin being infinitely near."""
    links = D.links(spark, sf_dir).withColumnRenamed("length", "cost")
    found = A.accessibility(links, origins(spark, sf_dir), D.locations(spark, sf_dir), _DECAYS["accessibility_power"][0], away=True)
    return found.select("origin", "set", F.round("accessibility", 6).alias("accessibility"))


def _access_sql(decay: str, within: str) -> str:
    return _TREE + ", " + D.SQL["locations"] + f""", near AS (
  SELECT origin, set, id, min(cost) AS cost, max(weight) AS weight FROM tree JOIN locations USING (node) WHERE {within} GROUP BY 1, 2, 3),
acc AS (SELECT origin, set, sum({decay} * weight) AS s FROM near GROUP BY 1, 2),
result AS (SELECT o.node AS origin, t.set, round(coalesce(s, 0.0), 6) AS accessibility
  FROM seeds o CROSS JOIN (SELECT DISTINCT set FROM locations) t LEFT JOIN acc ON acc.origin = o.node AND acc.set = t.set)
"""


_WALKING = _access_sql(*_DECAYS["node_accessibility"][1:])


def q_normalised(spark, sf_dir):
    found = _access(_DECAYS["node_accessibility"][0])(spark, sf_dir)
    out = A.normalised(found)
    return out.select("origin", "set", F.round("normalised_accessibility", 6).alias("normalised"))


def q_zone(spark, sf_dir):
    found = _access(_DECAYS["node_accessibility"][0])(spark, sf_dir)
    out = A.zone_accessibility(found, D.nodes(spark, sf_dir).select("node", "zone"))
    return out.select("zone", "set", F.round("accessibility", 4).alias("accessibility"), "n_nodes")


def q_skim(spark, sf_dir):
    out = A.skim(graph(spark, sf_dir), D.nodes(spark, sf_dir).select("node", "zone"))
    return out.select("o", "d", F.round("value", 6).alias("value"))


def q_detours(spark, sf_dir):
    links = D.full_links(spark, sf_dir)
    fast = P.tree(links.select("a", "b", F.col("length").alias("cost")), origins(spark, sf_dir))
    return fast, links


def q_detour_histogram(spark, sf_dir):
    """Cheapest way over the straight line between two nodes."""
    reached = P.tree(graph(spark, sf_dir), origins(spark, sf_dir))
    return A.detour_histogram(_straight(spark, sf_dir, reached))


def _straight(spark, sf_dir, reached):
    n = D.nodes(spark, sf_dir)
    o, d = n.select(F.col("node").alias("origin"), F.col("x").alias("ox"), F.col("y").alias("oy")), n.select("node", "x", "y")
    line = (F.abs(F.col("x") - F.col("ox")) + F.abs(F.col("y") - F.col("oy"))) / 2000
    return reached.filter("origin <> node").join(A.sent_if_small(o), "origin").join(A.sent_if_small(d), "node").select(
        "origin", "node", F.when(line > 0, F.greatest(F.lit(1.0), F.col("cost") / line)).alias("detour")
    ).dropna()


def q_large_detours(spark, sf_dir):
    reached = P.tree(graph(spark, sf_dir), origins(spark, sf_dir))
    return _straight(spark, sf_dir, reached).filter("detour > 6").select("origin", "node", F.round("detour", 6).alias("detour"))


_DETOUR = _TREE + ", " + D.SQL["nodes"] + """, ratio AS (SELECT origin, t.node, cost, (abs(d.x - o.x) + abs(d.y - o.y)) / 2000 AS line FROM tree t
  JOIN nodes o ON o.node = t.origin JOIN nodes d ON d.node = t.node WHERE origin <> t.node),
detour AS (SELECT origin, node, greatest(1.0, cost / line) AS detour FROM ratio WHERE line > 0)
"""


def _trip_costs(spark, sf_dir, *columns):
    """The named columns of trips, their ends and their costs."""
    return P.trip_paths(graph(spark, sf_dir), D.trips(spark, sf_dir).select("origin", "target", *columns))


_TRIPS = _TREE + ", " + D.SQL["trips"] + ", costed AS (SELECT t.*, cost FROM trips t JOIN tree ON tree.origin = t.origin AND tree.node = t.target)\n"


def q_trip_indicators(spark, sf_dir):
    return _trip_costs(spark, sf_dir, "trip", "mode").select("trip", "origin", "target", "mode", F.round("cost", 6).alias("cost"))


def q_beta(spark, sf_dir):
    out = percentile_beta(_trip_costs(spark, sf_dir), "cost")
    return out.select(F.round("value", 6).alias("value"), F.round("beta", 9).alias("beta"))


def q_slope(spark, sf_dir):
    n = D.nodes(spark, sf_dir)
    o, d = n.select(F.col("node").alias("origin"), F.col("x").alias("ox")), n.select(F.col("node").alias("target"), "x")
    t = _trip_costs(spark, sf_dir).join(A.sent_if_small(o), "origin").join(A.sent_if_small(d), "target")
    return slope_through_origin(t.withColumn("dist", F.abs(F.col("x") - F.col("ox"))), "dist", "cost").select(F.round("slope", 9).alias("slope"))


def q_summary(spark, sf_dir):
    out = A.summary(_trip_costs(spark, sf_dir), "cost")
    return out.withColumn("mean", F.round("mean", 6))


def q_beeline(spark, sf_dir):
    n = D.nodes(spark, sf_dir)
    t = D.trips(spark, sf_dir).join(n.select(F.col("node").alias("origin"), F.col("x").alias("ox"), F.col("y").alias("oy")), "origin").join(
        n.select(F.col("node").alias("target"), "x", "y"), "target"
    )
    return t.select("trip", F.round(F.hypot(F.col("x") - F.col("ox"), F.col("y") - F.col("oy")), 6).alias("beeline"))


def q_boundary(spark, sf_dir):
    """Trips by purpose and mode, and how many start, end and do both inside the box x < 5000."""
    n = D.nodes(spark, sf_dir).select("node", (F.col("x") < 5000).alias("inside"))
    t = D.trips(spark, sf_dir).join(n.withColumnsRenamed({"node": "origin", "inside": "i"}), "origin").join(n.withColumnsRenamed({"node": "target", "inside": "j"}), "target")
    return t.groupBy("purpose", "mode").agg(
        F.count("*").alias("n"), F.count_if("i").alias("n_origin"), F.count_if("j").alias("n_target"), F.count_if(F.col("i") & F.col("j")).alias("n_both")
    )


def q_volumes(spark, sf_dir):
    """Total trip length by two ways that must agree: over paths' links, and over paths."""
    trips = D.trips(spark, sf_dir)
    found = P.paths(graph(spark, sf_dir), trips.filter("origin <> target"))
    over = A.path_volumes(found, trips).join(D.links(spark, sf_dir), ["a", "b"])
    return over.agg(F.sum(F.col("trips") * F.col("length")).alias("metres"))


def q_unique_paths(spark, sf_dir):
    t = D.trips(spark, sf_dir).groupBy("origin", "target").agg(F.min("trip").alias("trip"), F.count("*").alias("n"))
    found = P.trip_paths(graph(spark, sf_dir), t, with_nodes=True)
    routes = found.select("trip", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("seq"), "dist", "nodes")
    routes = routes.select("trip", "seq", "dist", F.when(F.col("seq") % 3 == 0, F.reverse("nodes")).otherwise(F.col("nodes")).alias("links"))  # each third turned
    return A.unique_paths(routes).groupBy("trip").agg(F.count("*").alias("routes"), (F.max("path_id") + 1).cast("int").alias("paths"))


def _population(spark, sf_dir):
    n = D.table(spark, sf_dir, "supplier").agg(F.count("*").alias("n"))
    own = D.table(spark, sf_dir, "orders").join(F.broadcast(n))
    return own.groupBy(F.expr("o_custkey % n").alias("node")).agg(F.count("*").alias("population"))


def _supply(spark, sf_dir):
    return D.nodes(spark, sf_dir).select("node", (F.col("node") % 7).cast("double").alias("access"))


_NEAR = Decay("exponential", beta=0.01, cut_dist=300.0)


def q_demand(spark, sf_dir):
    both = P.two_way_tree(graph(spark, sf_dir), origins(spark, sf_dir), limit=_NEAR.cut_dist)
    out = A.intervention_demand(both, _population(spark, sf_dir), _supply(spark, sf_dir), 5.0, _NEAR)
    return out.select("node", F.round("demand", 6).alias("demand"))


def q_allocate(spark, sf_dir):
    both = P.two_way_tree(graph(spark, sf_dir), origins(spark, sf_dir), limit=_NEAR.cut_dist).checkpoint()
    out = A.allocate(both, _population(spark, sf_dir), _supply(spark, sf_dir), 5.0, _NEAR, 3)
    return out.select("iteration", "node", F.round("demand", 6).alias("demand"))


def q_pick(spark, sf_dir):
    return q_allocate(spark, sf_dir).filter("iteration = 0").select("node", "demand")


_TWO = D.with_sql(
    "links", "e AS (SELECT a, b, length AS w FROM links)", "seeds AS (SELECT s_suppkey AS node FROM supplier)", "tree", recursive=True
) + """, two AS (SELECT x.origin, x.node, (x.cost + y.cost) / 2 AS cost FROM tree x JOIN tree y ON y.origin = x.node AND y.node = x.origin)
"""
_DEMAND = _TWO + """, population AS (SELECT o_custkey % n AS node, count(*) AS population FROM orders, (SELECT count(*) AS n FROM supplier) GROUP BY 1),
pull AS (SELECT origin AS node, population * (5 * exp(-0.01 * cost)) / (5 * exp(-0.01 * cost) + CAST(node % 7 AS DOUBLE)) AS d FROM two JOIN population USING (node) WHERE cost <= 300),
demand AS (SELECT node, round(sum(d), 6) AS demand FROM pull GROUP BY 1)
"""


def _allocation_sql(places: int) -> str:
    out = _TWO + """, population AS (SELECT o_custkey % n AS node, count(*) AS population FROM orders, (SELECT count(*) AS n FROM supplier) GROUP BY 1),
near AS (SELECT origin, node, 5 * exp(-0.01 * cost) AS pull FROM two WHERE cost <= 300),
s0 AS (SELECT s_suppkey AS node, CAST(s_suppkey % 7 AS DOUBLE) AS access FROM supplier)"""
    for i in range(places):
        out += f""",
p{i} AS (SELECT origin AS node, sum(population * pull / (pull + access)) AS demand FROM near JOIN population USING (node) JOIN s{i} USING (node) GROUP BY 1 ORDER BY demand DESC, node LIMIT 1),
s{i + 1} AS (SELECT s.node, access + coalesce(pull, 0) AS access FROM s{i} s LEFT JOIN (SELECT near.node, pull FROM near JOIN p{i} ON origin = p{i}.node) g ON g.node = s.node)"""
    return out + "\n" + " UNION ALL ".join(f"SELECT {i} AS iteration, node, round(demand, 6) AS demand FROM p{i}" for i in range(places))


def q_new_weight(spark, sf_dir):
    out = A.new_destination_weight(D.locations(spark, sf_dir), 0.5)
    return out.select("set", F.round("weight", 6).alias("weight"))


QUERIES = {
    "sssp_forward": q_forward,
    "sssp_reverse": q_reverse,
    "sssp_two_way": q_two_way,
    "sssp_cutoff": q_cutoff,
    "sssp_by_joins": q_joins,
    "sssp_two_seed": q_two_seed,
    **{name: _access(decay) for name, (decay, _, _) in _DECAYS.items()},
    "accessibility_power": q_power,
    "accessibility_normalised": q_normalised,
    "zone_accessibility": q_zone,
    "skim_distance": q_skim,
    "detour_histogram": q_detour_histogram,
    "large_detours": q_large_detours,
    "trip_indicators": q_trip_indicators,
    "decay_beta_percentile": q_beta,
    "cost_dist_slope": q_slope,
    "cost_summary": q_summary,
    "beeline": q_beeline,
    "trip_boundary_counts": q_boundary,
    "path_volume_metres": q_volumes,
    "unique_paths": q_unique_paths,
    "intervention_demand": q_demand,
    "intervention_pick": q_pick,
    "intervention_allocation": q_allocate,
    "new_destination_weight": q_new_weight,
}

ORACLE_SQL = {
    "sssp_forward": _TREE + "SELECT origin, node, cost FROM tree",
    "sssp_reverse": _BACK + "SELECT origin, node, cost FROM tree",
    "sssp_two_way": _TWO + "SELECT origin, node, cost FROM two",
    "sssp_cutoff": _TREE + "SELECT origin, node, cost FROM tree WHERE cost <= 120",
    "sssp_by_joins": _TREE + "SELECT origin, node, cost FROM tree WHERE cost <= 150",
    "sssp_two_seed": _TREE + """, near AS (SELECT a, arg_min(b, (length, b)) AS b, min(length) AS length FROM links GROUP BY 1)
SELECT origin, node, min(cost) AS cost FROM (SELECT origin, node, cost FROM tree JOIN near ON near.a = tree.origin
  UNION ALL SELECT near.a, tree.node, tree.cost + near.length / 2 FROM near JOIN tree ON tree.origin = near.b) GROUP BY 1, 2""",
    **{name: _access_sql(decay, within) + "SELECT * FROM result" for name, (_, decay, within) in _DECAYS.items()},
    "accessibility_normalised": _WALKING + """SELECT origin, set, round((accessibility - low) / nullif(high - low, 0), 6) AS normalised
FROM result JOIN (SELECT set, min(accessibility) AS low, max(accessibility) AS high FROM result GROUP BY 1) USING (set)""",
    "zone_accessibility": _WALKING + """SELECT s_nationkey AS zone, set, round(avg(accessibility), 4) AS accessibility, count(*) AS n_nodes
FROM result JOIN supplier ON s_suppkey = origin GROUP BY 1, 2""",
    "skim_distance": _TREE + """, zs AS (SELECT s_nationkey AS zone, count(*) AS n FROM supplier GROUP BY 1),
s AS (SELECT o.s_nationkey AS o, d.s_nationkey AS d, sum(cost) AS total, count(*) AS pairs FROM tree JOIN supplier o ON o.s_suppkey = origin
  JOIN supplier d ON d.s_suppkey = node GROUP BY 1, 2)
SELECT a.zone AS o, b.zone AS d, round(CASE WHEN pairs = a.n * b.n THEN total / (a.n * b.n) ELSE 'Infinity'::DOUBLE END, 6) AS value
FROM zs a CROSS JOIN zs b LEFT JOIN s ON s.o = a.zone AND s.d = b.zone""",
    "detour_histogram": _DETOUR + "SELECT CAST(least(floor((detour - 1) * 100), 499) AS INTEGER) AS bin, count(*) AS n FROM detour GROUP BY 1",
    "large_detours": _DETOUR + "SELECT origin, node, round(detour, 6) AS detour FROM detour WHERE detour > 6",
    "trip_indicators": _TRIPS + "SELECT trip, origin, target, mode, round(cost, 6) AS cost FROM costed",
    "decay_beta_percentile": _TRIPS + "SELECT round(q, 6) AS value, round(-ln(1 - 0.85) / q, 9) AS beta FROM (SELECT quantile_cont(cost, 0.85) AS q FROM costed)",
    "cost_dist_slope": _TRIPS + """SELECT round(sum(abs(d.x - o.x) * cost) / sum(abs(d.x - o.x) * abs(d.x - o.x)), 9) AS slope FROM costed
JOIN (SELECT s_suppkey AS node, CAST((s_suppkey * 7919) % 10007 AS DOUBLE) AS x FROM supplier) o ON o.node = origin
JOIN (SELECT s_suppkey AS node, CAST((s_suppkey * 7919) % 10007 AS DOUBLE) AS x FROM supplier) d ON d.node = target""",
    "cost_summary": _TRIPS + """, o AS (SELECT list_sort(list(cost)) AS l, count(*) AS n, avg(cost) AS m FROM costed)
SELECT l[1] AS min, l[n // 4 + 1] AS q25, l[n // 2 + 1] AS median, round(m, 6) AS mean, l[3 * n // 4 + 1] AS q75, l[n] AS max FROM o""",
    "beeline": D.with_sql("nodes", "trips") + """SELECT trip, round(sqrt((d.x - o.x) ** 2 + (d.y - o.y) ** 2), 6) AS beeline FROM trips
JOIN nodes o ON o.node = origin JOIN nodes d ON d.node = target""",
    "trip_boundary_counts": D.with_sql("nodes", "trips") + """SELECT purpose, mode, count(*) AS n, count(*) FILTER (o.x < 5000) AS n_origin, count(*) FILTER (d.x < 5000) AS n_target,
  count(*) FILTER (o.x < 5000 AND d.x < 5000) AS n_both FROM trips JOIN nodes o ON o.node = origin JOIN nodes d ON d.node = target GROUP BY 1, 2""",
    "path_volume_metres": _TRIPS + "SELECT sum(cost) AS metres FROM costed",
    "unique_paths": _TRIPS + "SELECT min(trip) AS trip, count(*) AS routes, CASE WHEN count(*) >= 3 AND origin <> target THEN 2 ELSE 1 END AS paths FROM costed GROUP BY origin, target",
    "intervention_demand": _DEMAND + "SELECT node, demand FROM demand",
    "intervention_pick": _DEMAND + "SELECT node, demand FROM demand ORDER BY demand DESC, node LIMIT 1",
    "intervention_allocation": _allocation_sql(3),
    "new_destination_weight": D.with_sql("locations") + """, p AS (SELECT DISTINCT set, id, sqrt(weight) AS w FROM locations)
SELECT set, round(list_sort(list(w))[count(*) // 2 + 1], 6) AS weight FROM p GROUP BY 1""",
}
