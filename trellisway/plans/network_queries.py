"""Queries over links: cost expressions, network building, volumes; and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import link as L
from ..operators import network as N
from . import derived as D

_FULL = D.with_sql("links", "nodes", "full")
_GRAD = "CASE WHEN z_from IS NULL OR z_to IS NULL THEN 0 ELSE (z_to - z_from) / length END"
_WALK = f"3 * length / (5 * exp(-3.5 * abs(greatest(-1.0, least(1.0, {_GRAD})) + 0.05)))"
_SURFACE = "CASE WHEN road IS NULL OR road = 'cycleway' OR surface IS NULL THEN 1.0 WHEN surface IN ('asphalt') THEN 1.0 WHEN surface = 'compacted' THEN 0.9 " \
    "WHEN surface = 'gravel' THEN 0.7 WHEN surface = 'sett' THEN 0.6 WHEN surface = 'grass' THEN 0.4 WHEN surface = 'sand' THEN 0.2 ELSE 0.5 END"  # fmt: skip
_UP = f"CASE WHEN {_GRAD} > 0 THEN greatest(0.1, 1 - 5 * ({_GRAD})) ELSE 1.0 END"
_BIKE = f"least(5.5 * ({_SURFACE}) * ({_UP}), freespeed)"
_KIND = """CASE WHEN cycleosm IN ('offroad', 'kerbed') THEN 'KERBED' WHEN cycleosm = 'protected' THEN 'PROTECTED' WHEN cycleosm = 'painted' THEN 'LANE'
  WHEN cycleosm = 'integrated' THEN 'MIXED' WHEN cycleway = 'track' THEN 'PROTECTED' WHEN cycleway IN ('lane', 'share_busway') THEN 'LANE' ELSE 'MIXED' END"""
_SPEED = "CASE WHEN speed85_kph * 0.621371 >= limit_mph * 1.1 THEN speed85_kph * 0.621371 ELSE limit_mph END"
_STRESS = f"""CASE WHEN NOT allows_bike THEN NULL WHEN NOT allows_car THEN 0.0 WHEN junction IN ('roundabout', 'circular') THEN 1.0 ELSE
  greatest(0.0, least(1.0, CASE kind WHEN 'KERBED' THEN 0.0 WHEN 'PROTECTED' THEN -1.5 + 0.05 * v WHEN 'LANE' THEN -1.625 + 0.0625 * v + 0.000125 * (aadt * 0.865)
  ELSE -1.25 + 0.0583 * v + 0.000167 * (aadt * 0.865) END + 0.2 * least(1.0, 24 * hgv_pois / length))) END"""
_WALK_STRESS = """CASE WHEN NOT allows_car THEN 0.0 ELSE greatest(0.0, least(1.0, CASE kind WHEN 'KERBED' THEN 0.0 ELSE -1.5 + 0.05 * v END
  + 0.2 * least(1.0, 24 * hgv_pois / length))) END"""
_CROSS = "CASE WHEN crossing IS NULL THEN 'UNCONTROLLED' WHEN crossing = 'crossing point' THEN 'ZEBRA' WHEN crossing = 'Car signal' THEN 'SIGNAL_MIXED' ELSE 'SIGNAL_ACTIVE' END"
_CV = "CASE WHEN cross_speed85_kph * 0.621371 >= cross_limit_mph * 1.1 THEN cross_speed85_kph * 0.621371 ELSE cross_limit_mph END"
_JCT = """CASE WHEN NOT crosses THEN 0.0 ELSE greatest(0.0, least(1.0, CASE crossing_kind WHEN 'UNCONTROLLED' THEN
    CASE WHEN cv < 60 THEN coalesce(cross_aadt * 0.865, 800) / (300 * cv + 16500) + cv / 90 + cross_lanes / 3 - 0.5 ELSE 1.0 END
  WHEN 'ZEBRA' THEN CASE WHEN cv <= 30 THEN coalesce(cross_aadt * 0.865, 800) / 24000 + cross_lanes / 3 - 2.0 / 3 ELSE cv / 90 + 1.0 / 3 END
  WHEN 'SIGNAL_MIXED' THEN CASE WHEN cv < 60 THEN walk_stress ELSE 1.0 END
  ELSE CASE WHEN cv < 60 THEN 0.0 ELSE 1.0 END END)) END"""
_AMBIENT = """greatest(0.0, least(1.0, 0.5 - (0.5 * vgvi + least(0.5, 0.5 * least(1.0, 5 * pois / length) + 0.5 * least(1.0, shannon / 1.6)))
  + 0.5 * least(1.0, 5 * neg_pois / length) + 0.5 * least(1.0, 4 * crime / length)))"""
_NIGHT = """greatest(0.0, least(1.0, 0.5 - (0.25 * vgvi + least(0.5, 0.5 * least(1.0, 5 * pois / length) + 0.5 * least(1.0, shannon / 1.6)))
  + 0.5 * least(1.0, 5 * neg_pois / length) + 0.5 * least(1.0, 4 * crime / length)
  + 0.25 * (1 - least(1.0, CASE WHEN road = 'primary' THEN 30.0 ELSE 15.0 END * lights / length))))"""
_COMFORT = """1 - CASE coalesce(surface, 'null') WHEN 'asphalt' THEN 1.0 WHEN 'null' THEN 1.0 WHEN 'compacted' THEN 0.7 WHEN 'gravel' THEN 0.6
  WHEN 'sett' THEN 0.5 WHEN 'grass' THEN 0.4 WHEN 'sand' THEN 0.3 ELSE 0.85 END"""
_RATED = (
    _FULL + f""", v1 AS (SELECT *, {_KIND} AS kind, {_SPEED} AS v, {_GRAD} AS grad, {_WALK} AS walk_s, {_BIKE} AS bike_mps, {_CROSS} AS crossing_kind, {_CV} AS cv,
  {_AMBIENT} AS ambient, {_COMFORT} AS rough FROM full_links),
v2 AS (SELECT *, {_WALK_STRESS} AS walk_stress, {_STRESS} AS bike_stress, CASE WHEN dismount THEN walk_s ELSE length / bike_mps END AS bike_s FROM v1),
rated AS (SELECT *, {_JCT} AS jct FROM v2)
"""
)


def rated_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links with all derived ratings that the queries below select from."""
    base = D.full_links(spark, sf_dir).withColumns({
        "kind": L.protection("cycleosm", "cycleway", F.lit(True)), "v": L.effective_speed("limit_mph", "speed85_kph"),
        "grad": L.gradient("z_from", "z_to", "length"), "crossing_kind": L.crossing_type("crossing"),
        "ambient": L.ambience("vgvi", "shannon", "pois", "neg_pois", "crime", "length"), "rough": L.comfort("surface"),
    })
    base = base.withColumns({
        "walk_s": L.walk_time("length", "grad"),
        "bike_mps": L.bike_speed(5.5, F.lit(1.0), "surface", "road", "grad", "freespeed"),
        "walk_stress": L.link_stress("walk", F.lit(True), "allows_car", "junction", "limit_mph", "speed85_kph", "aadt", "kind", "hgv_pois", "length"),
        "bike_stress": L.link_stress("bike", "allows_bike", "allows_car", "junction", "limit_mph", "speed85_kph", "aadt", "kind", "hgv_pois", "length"),
    })
    return base.withColumns({
        "bike_s": L.bike_time("length", "bike_mps", "dismount", "walk_s"),
        "jct": L.junction_stress("crosses", "crossing_kind", "cross_limit_mph", "cross_speed85_kph", "cross_aadt", "cross_lanes", "walk_stress"),
    })


def _rated(digits=None, **columns):
    """A query of ratings: name -> (Column or None for the column itself).

    Plain arithmetic stays unrounded, as a tie at the last digit may go either way; exponentials and decimal constants are rounded.
    """

    def one(c):
        return c if digits is None else F.round(c, digits)

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = rated_links(spark, sf_dir)
        return df.select("a", "b", *(one(c() if c else F.col(n)).alias(n) for n, c in columns.items()))

    return query


def _text(*names):
    return lambda spark, sf_dir: rated_links(spark, sf_dir).select("a", "b", *names)


_W, _B = L.CompositeWeights.of("walk"), L.CompositeWeights.of("bike")
_COST_SQL = {
    "walk": "walk_s * (1 + 4.0 * greatest(0.0, least(0.5, grad)) + 0.0 * rough + 3.0 * ambient + 1.0 * walk_stress) + 1.0 * walk_s * (least(length, cross_width) / length * jct)",
    "bike": "bike_s * (1 + 15.0 * greatest(0.0, least(0.5, grad)) + 0.15 * rough + 1.0 * ambient + 3.0 * bike_stress) + 3.0 * bike_s * (least(length, cross_width) / length * jct)",
}


def _cost(mode):
    w = {"walk": _W, "bike": _B}[mode]
    return L.composite_cost(w, f"{mode}_s", "grad", "rough", "ambient", f"{mode}_stress", "cross_width", "length", "jct")


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Undirected edges for the network build: the supplier links with a <> b, as edge input."""
    full = D.full_links(spark, sf_dir)
    modes = F.concat(
        F.array(F.lit("walk")), F.when(F.expr("h % 3 <> 0"), F.array(F.lit("bike"))).otherwise(F.array().cast("array<string>")),
        F.when(F.expr("h % 10 <> 0"), F.array(F.lit("car"), F.lit("truck"))).otherwise(F.array().cast("array<string>")),
    )
    return full.select(F.expr("a * 1000003 + b").alias("edge_id"), "a", "b", "length", modes.alias("modes"), F.expr("h % 7 = 0").alias("one_way"), "width", "lanes", "capacity", "road")


def q_directed_links(spark, sf_dir):
    out = N.directed_links(edges(spark, sf_dir))
    return out.select("link_id", "a", "b", F.array_join("modes", ",").alias("modes"), "dismount", "width", "lanes", "capacity", "allows_car")


def q_junctions(spark, sf_dir):
    return N.junctions(edges(spark, sf_dir), D.tasks(spark, sf_dir))


def _crossing_input(spark, sf_dir):
    return D.full_links(spark, sf_dir).select(
        F.concat_ws("-", "a", "b").alias("link_id"), F.expr("a * 1000003 + b").alias("edge_id"), "a", "b", "osm_id", F.col("road_name").alias("name"),
        "allows_car", "width", "lanes", "aadt_fwd", "limit_mph",
    )


def q_crossing(spark, sf_dir):
    return N.crossing_attributes(_crossing_input(spark, sf_dir).checkpoint(), D.tasks(spark, sf_dir))  # derived once, read three times


def q_opposite(spark, sf_dir):
    base = D.full_links(spark, sf_dir).select(F.concat_ws("-", "a", "b").alias("link_id"), "a", "b", "aadt_fwd")
    return N.with_opposite_volume(base)


def q_strong(spark, sf_dir):
    return N.strong_component(D.links(spark, sf_dir))


def q_mode_network(spark, sf_dir):
    links = N.for_mode(N.directed_links(edges(spark, sf_dir)), "bike")
    return links.groupBy("road").agg(F.count("*").alias("n_links"), F.round(F.sum("length"), 3).alias("length"))


def q_xy2links(spark, sf_dir):
    """Links that places may be attached to: no motorways or trunk roads (here: primary)."""
    return D.full_links(spark, sf_dir).filter("coalesce(road, '') <> 'primary'").select("a", "b", "length", "road")


def q_daily(spark, sf_dir):
    return N.volumes_daily(*D.link_events(spark, sf_dir), scale=0.3)


def q_hourly(spark, sf_dir):
    events, vehicles = D.link_events(spark, sf_dir)
    return N.volumes_hourly(events, vehicles.filter("type <> 'other'"))


def q_dense(spark, sf_dir):
    events, vehicles = D.link_events(spark, sf_dir)
    return N.volumes_dense(events.select("link").distinct(), N.volumes_hourly(events, vehicles.filter("type <> 'other'")))


def q_marginal(spark, sf_dir):
    df = rated_links(spark, sf_dir)
    jct = L.junction_cost(_W, "walk_s", "cross_width", "length", "jct")
    return df.select(
        "a", "b", F.round(L.marginal(_cost("walk"), jct, "length"), 6).alias("cost_per_m"), F.round(L.marginal("walk_s", 0.0, "length"), 6).alias("time_per_m")
    )


def q_connectors(spark, sf_dir):
    """From the first to the last link of every order's way, for each pair of links once."""
    base = D.full_links(spark, sf_dir).select(F.concat_ws("-", "a", "b").alias("link_id"), "a", "b", "freespeed", "capacity", "lanes").checkpoint()
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity")
    steps = D.table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_suppkey").alias("a"), F.lead("l_suppkey").over(order).alias("b"), F.row_number().over(order).alias("k"))
    steps = steps.filter("b is not null and a <> b").withColumn("link", F.concat_ws("-", "a", "b"))
    ends = steps.groupBy("l_orderkey").agg(F.min_by("link", "k").alias("from_link"), F.max_by("link", "k").alias("to_link")).select("from_link", "to_link").distinct()
    out = N.connectors(base, D.nodes(spark, sf_dir), ends)
    return out.select("link_id", "a", "b", F.round("length", 6).alias("length"), "capacity", "lanes")


QUERIES = {
    "derived_links": D.links,
    "link_gradient": _rated(grad=None),
    "walk_time": _rated(6, walk_s=None),
    "bike_speed": _rated(6, bike_mps=None),
    "bike_time": _rated(6, bike_s=None),
    "bike_speed_gradient_only": _rated(speed=lambda: L.bike_speed_gradient_only(5.5, "grad", "freespeed")),
    "surface_comfort": _rated(6, rough=None),
    "protection_type": _text("kind"),
    "crossing_type": _text("crossing_kind"),
    "link_stress": _rated(walk_stress=None, bike_stress=None),
    "link_stress_discrete": lambda spark, sf_dir: rated_links(spark, sf_dir).select(
        "a", "b", L.link_stress_discrete("allows_bike", "allows_car", "junction", "limit_mph", "speed85_kph", "aadt", "kind").alias("level")
    ),
    "junction_stress": _rated(jct=None, jct_share=lambda: L.junction_share("cross_width", "length", "jct")),
    "ambience_day": _rated(ambient=None),
    "ambience_night": _rated(
        ambient=lambda: L.ambience("vgvi", "shannon", "pois", "neg_pois", "crime", "length", True, L.darkness(F.coalesce(F.col("road") == "primary", F.lit(False)), "lights", "length"))
    ),
    "composite_cost_v3": _rated(6, walk_cost=lambda: _cost("walk"), bike_cost=lambda: _cost("bike")),
    "composite_cost_v4": _rated(
        6, cost=lambda: L.weighted_cost("walk_s", [(F.greatest(F.lit(0.0), 0.81 - F.col("vgvi")), 0.3307472), (F.least(F.lit(1.0), F.col("v") / 50), 0.4479527), (L.junction_share("cross_width", "length", "jct"), 4.988739)])
    ),
    "marginal_cost": q_marginal,
    "directed_links": q_directed_links,
    "mode_network": q_mode_network,
    "xy2links_filter": q_xy2links,
    "junction_nodes": q_junctions,
    "crossing_attributes": q_crossing,
    "opposite_volume": q_opposite,
    "strong_component": q_strong,
    "vehicle_connectors": q_connectors,
    "congested_capacity": _rated(capacity=lambda: L.congested_capacity("capacity", "road", "length")),
    "link_volumes_daily": q_daily,
    "link_volumes_hourly": q_hourly,
    "link_volumes_dense": q_dense,
}


def _from(columns: str, source: str = _RATED) -> str:
    return f"{source}SELECT a, b, {columns} FROM {'rated' if source is _RATED else 'full_links'}"


_EDGES = (
    _FULL + """, edges AS (SELECT a * 1000003 + b AS edge_id, a, b, length, h % 3 <> 0 AS bike, h % 10 <> 0 AS car, h % 7 = 0 AS one_way, width, lanes, capacity, road
  FROM full_links)"""
)
_DIRECTED = (
    _EDGES + """, ways AS (
  SELECT edge_id, 'out' AS way, a, b, length, road, car, NOT bike AS dismount, CASE WHEN (car AND NOT one_way) OR NOT car THEN width / 2 ELSE width END AS width, lanes, capacity FROM edges
  UNION ALL
  SELECT edge_id, 'rtn', b, a, length, road, car AND NOT one_way, NOT bike OR one_way, CASE WHEN (car AND NOT one_way) OR NOT car THEN width / 2 ELSE 0 END, lanes, capacity FROM edges)
"""
)

_JUNCTION = "junction_nodes AS (SELECT node, count(DISTINCT edge_id) AS n_edges FROM (SELECT a AS node, edge_id FROM edges UNION ALL SELECT b, edge_id FROM edges) GROUP BY 1 HAVING count(DISTINCT edge_id) > 2)"

ORACLE_SQL = {
    "derived_links": D.with_sql("links") + "SELECT a, b, length FROM links",
    "link_gradient": _from("grad"),
    "walk_time": _from("round(walk_s, 6) AS walk_s"),
    "bike_speed": _from("round(bike_mps, 6) AS bike_mps"),
    "bike_time": _from("round(bike_s, 6) AS bike_s"),
    "bike_speed_gradient_only": _from(f"least(5.5 * ({_UP}), freespeed) AS speed"),
    "surface_comfort": _from("CAST(round(rough, 6) AS DOUBLE) AS rough"),
    "protection_type": _from("kind"),
    "crossing_type": _from("crossing_kind"),
    "link_stress": _from("walk_stress, bike_stress"),
    "link_stress_discrete": _from(
        """CASE WHEN NOT allows_bike THEN NULL WHEN NOT allows_car THEN 'GREEN' WHEN junction = 'roundabout' THEN 'RED'
  WHEN v <= 21.75 THEN CASE WHEN kind = 'LANE' AND aadt * 0.865 >= 4000 THEN 'AMBER' WHEN kind = 'MIXED' AND aadt * 0.865 >= 4000 THEN 'RED'
    WHEN kind = 'MIXED' AND aadt * 0.865 >= 2000 THEN 'AMBER' ELSE 'GREEN' END
  WHEN v <= 31.07 THEN CASE WHEN kind = 'LANE' AND aadt * 0.865 >= 4000 THEN 'RED' WHEN kind = 'LANE' THEN 'AMBER'
    WHEN kind = 'MIXED' AND aadt * 0.865 >= 2000 THEN 'RED' WHEN kind = 'MIXED' THEN 'AMBER' ELSE 'GREEN' END
  WHEN v <= 40.39 THEN CASE WHEN kind IN ('LANE', 'MIXED') THEN 'RED' WHEN kind = 'PROTECTED' THEN 'AMBER' ELSE 'GREEN' END
  ELSE CASE WHEN kind = 'KERBED' THEN 'GREEN' ELSE 'RED' END END AS level"""
    ),
    "junction_stress": _from("jct, least(length, cross_width) / length * jct AS jct_share"),
    "ambience_day": _from("ambient"),
    "ambience_night": _from(f"{_NIGHT} AS ambient"),
    "composite_cost_v3": _from(f"round({_COST_SQL['walk']}, 6) AS walk_cost, round({_COST_SQL['bike']}, 6) AS bike_cost"),
    "composite_cost_v4": _from(
        "round(walk_s * (1 + 0.3307472 * greatest(0.0, 0.81 - vgvi) + 0.4479527 * least(1.0, v / 50) + 4.988739 * (least(length, cross_width) / length * jct)), 6) AS cost"
    ),
    "marginal_cost": _from(
        f"round(({_COST_SQL['walk']} - 1.0 * walk_s * (least(length, cross_width) / length * jct)) / length, 6) AS cost_per_m, round(walk_s / length, 6) AS time_per_m"
    ),
    "directed_links": _DIRECTED + """SELECT CAST(edge_id AS VARCHAR) || way AS link_id, a, b, CASE WHEN car THEN 'bike,car,truck,walk' ELSE 'bike,walk' END AS modes,
  dismount, width, CASE WHEN car THEN least(lanes, 8) ELSE 1 END AS lanes, CASE WHEN car THEN capacity ELSE 0 END AS capacity, car AS allows_car FROM ways""",
    "mode_network": _DIRECTED + "SELECT road, count(*) AS n_links, round(sum(length), 3) AS length FROM ways GROUP BY 1",
    "xy2links_filter": _FULL + "SELECT a, b, length, road FROM full_links WHERE coalesce(road, '') <> 'primary'",
    "junction_nodes": _EDGES + ", " + _JUNCTION + " SELECT node, n_edges FROM junction_nodes",
    "crossing_attributes": _EDGES + ", " + _JUNCTION + """, met AS (
  SELECT f.a, f.b, sum(o.width) AS w, sum(o.lanes) AS l, sum(o.aadt_fwd) AS t, max(o.limit_mph) AS v FROM full_links f
  JOIN junction_nodes j ON j.node = f.b JOIN full_links o ON o.b = f.b AND o.allows_car
  WHERE NOT (f.osm_id = o.osm_id OR (length(f.road_name) > 0 AND f.road_name = o.road_name)) GROUP BY 1, 2)
SELECT CAST(f.a AS VARCHAR) || '-' || CAST(f.b AS VARCHAR) AS link_id, coalesce(w, 0) AS cross_width, coalesce(l, 0) AS cross_lanes, coalesce(t, 0) AS cross_aadt,
  v AS cross_speed, w IS NOT NULL AS crosses FROM full_links f LEFT JOIN met USING (a, b)""",
    "opposite_volume": _FULL + """SELECT CAST(f.a AS VARCHAR) || '-' || CAST(f.b AS VARCHAR) AS link_id, f.a, f.b, f.aadt_fwd, f.aadt_fwd + coalesce(o.aadt_fwd, 0) AS aadt
FROM full_links f LEFT JOIN full_links o ON o.a = f.b AND o.b = f.a""",
    "strong_component": D.with_sql(
        "links", "r(s, n) AS (SELECT a, a FROM links UNION SELECT r.s, links.b FROM r JOIN links ON links.a = r.n)", recursive=True
    ) + """, mutual AS (SELECT x.s, x.n FROM r x JOIN r y ON y.s = x.n AND y.n = x.s), size AS (SELECT s, count(*) AS c, min(n) AS least FROM mutual GROUP BY 1)
SELECT n AS node FROM mutual WHERE s = (SELECT s FROM size ORDER BY c DESC, least, s LIMIT 1)""",
    "vehicle_connectors": _FULL + """, f AS (SELECT *, CAST(a AS VARCHAR) || '-' || CAST(b AS VARCHAR) AS id FROM full_links),
  st AS (SELECT l_orderkey, l_suppkey AS a, lead(l_suppkey) OVER o AS b, row_number() OVER o AS k FROM lineitem WINDOW o AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity)),
  en AS (SELECT DISTINCT arg_min(a || '-' || b, k) AS one, arg_max(a || '-' || b, k) AS two FROM st WHERE b IS NOT NULL AND a <> b GROUP BY l_orderkey)
SELECT 'connector_' || p.id || '_' || q.id AS link_id, p.b AS a, q.a AS b, round(sqrt((nb.x - na.x) ** 2 + (nb.y - na.y) ** 2), 6) AS length,
  greatest(p.capacity, q.capacity) AS capacity, greatest(p.lanes, q.lanes) AS lanes FROM en JOIN f p ON p.id = one JOIN f q ON q.id = two JOIN nodes nb ON nb.node = q.a JOIN nodes na ON na.node = p.b""",
    "congested_capacity": _from(
        "CASE WHEN road IN ('primary', 'secondary') THEN 0.7 * capacity ELSE capacity END * CASE WHEN length < 100 THEN 2 ELSE 1 END AS capacity"
    ),
    "link_volumes_daily": D.with_sql("events") + """SELECT link, CAST(3 * count(*) FILTER (type = 'car') AS BIGINT) AS car, CAST(3 * count(*) FILTER (type = 'truck') AS BIGINT) AS truck,
  CAST(3 * count(*) FILTER (type = 'car') + 18 * count(*) FILTER (type = 'truck') AS BIGINT) AS pcu FROM ev WHERE type <> 'other' GROUP BY 1""",
    "link_volumes_hourly": D.with_sql("events") + """SELECT link, CAST(floor(time / 3600) AS INTEGER) % 24 AS hour, count(*) FILTER (type = 'car') AS car,
  count(*) FILTER (type = 'truck') AS truck FROM ev WHERE type <> 'other' GROUP BY 1, 2""",
    "link_volumes_dense": D.with_sql("events") + """, h AS (SELECT link, CAST(floor(time / 3600) AS INTEGER) % 24 AS hour, count(*) FILTER (type = 'car') AS car,
  count(*) FILTER (type = 'truck') AS truck FROM ev WHERE type <> 'other' GROUP BY 1, 2)
SELECT l.link, CAST(g.hour AS INTEGER) AS hour, coalesce(car, 0) AS car, coalesce(truck, 0) AS truck
FROM (SELECT DISTINCT link FROM ev) l CROSS JOIN generate_series(0, 23) AS g(hour) LEFT JOIN h ON h.link = l.link AND h.hour = g.hour""",
}
