"""Queries over zones of several parts with holes, which the nations have here; and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import spatial as S
from ..sources import geopackage as G
from ..sources import tables as R
from ..sources.shared import new_folder
from . import derived as D
from .io_queries import _local
from .spatial_queries import _SEGMENTS, _U, CELL, DIAMOND, segments

#: Rings from a zone's corner: a hook, the hole in it, whose side is g, and an island. Of each the part, whether it is a hole, and its corners.
_RINGS = [
    (0, [("0", "0"), ("1800", "0"), ("1800", "1800"), ("1000", "1800"), ("1000", "900"), ("0", "900")]),
    (0, [("200", "200"), ("200 + g", "200"), ("200 + g", "200 + g"), ("200", "200 + g")]),
    (1, [("100", "1100"), ("700", "1100"), ("100", "1700")]),
]
_PLACE = {"x0": "(n_nationkey % 5) * 2002 + 0.25", "g": "100 + 50 * n_regionkey"}


def areas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(zone, g, parts)`` of the nations; the holes are larger in later regions."""
    own = D.table(spark, sf_dir, "nation").selectExpr(
        "cast(n_nationkey as bigint) AS zone", f"cast({_PLACE['x0']} as double) AS x0", "cast((n_nationkey div 5) * 2002 + 0.25 as double) AS y0", f"{_PLACE['g']} AS g"
    )
    ring = lambda corners: F.array(*(F.struct(F.expr(f"x0 + {x}").alias("x"), F.expr(f"y0 + {y}").alias("y")) for x, y in corners))
    return own.select("zone", "g", F.array(F.array(ring(_RINGS[0][1]), ring(_RINGS[1][1])), F.array(ring(_RINGS[2][1]))).alias("parts"))


def _measures(found: DataFrame) -> DataFrame:
    own = found.select("zone", S.parts_area("parts").alias("area"), S.parts_centroid("parts").alias("c"), F.size("parts").alias("n_parts"), F.size(F.flatten("parts")).alias("n_rings"))
    return own.select("zone", F.round("area", 4).alias("area"), F.round("c.x", 4).alias("x"), F.round("c.y", 4).alias("y"), "n_parts", "n_rings")


def q_area_file(spark, sf_dir):
    """Areas and centres of zones that were written as WKT."""
    path = new_folder(spark, "areas")
    ring = lambda r: F.concat(F.lit("("), F.array_join(F.transform(r, lambda p: F.concat_ws(" ", p["x"], p["y"])), ", "), F.lit(")"))
    part = lambda p: F.concat(F.lit("("), F.array_join(F.transform(p, ring), ", "), F.lit(")"))
    text = F.concat(F.lit("MULTIPOLYGON ("), F.array_join(F.transform("parts", part), ", "), F.lit(")"))
    areas(spark, sf_dir).select(F.col("zone").alias("id"), text.alias("wkt")).write.csv(path, header=True, sep=";")
    return _measures(R.read_zones(spark, path).withColumn("zone", F.col("zone").cast("long")))


def q_area_package(spark, sf_dir):
    """The same of a GeoPackage."""
    path = f"{_local(spark, 'gpkg')}/areas.gpkg"
    G.write_features(areas(spark, sf_dir).select("zone", "parts"), path, "areas", "polygon")
    return _measures(G.read_features(spark, path, "zone", areas=True))


def q_point_in_area(spark, sf_dir):
    return S.assign_zones(D.nodes(spark, sf_dir).select("node", "x", "y"), areas(spark, sf_dir), CELL).select("node", "zone")


def q_links_in_areas(spark, sf_dir):
    return S.links_in_zones(segments(spark, sf_dir), areas(spark, sf_dir), CELL, D.tasks(spark, sf_dir))


def q_random_points(spark, sf_dir):
    """A point for every order, in the hook, beside the hole, or on the island of a nation."""
    wanted = D.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), (F.col("o_custkey") % 25).alias("zone"))
    return S.random_points(wanted, areas(spark, sf_dir)).select("id", "zone", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))


def q_hex_grid(spark, sf_dir):
    """The cells of a hexagonal grid, and how many suppliers are nearest to each one's centre."""
    cells = S.hex_grid(spark, DIAMOND, 250.0)
    near = S.nearest_node(D.nodes(spark, sf_dir).select(F.col("node").alias("point"), "x", "y"), cells.withColumnRenamed("cell", "node"), 2 * CELL)
    counts = near.groupBy(F.col("best").alias("cell")).agg(F.count("*").alias("n"))
    return cells.join(counts, "cell", "left").select("cell", F.round("x", 4).alias("x"), F.round("y", 4).alias("y"), F.coalesce("n", F.lit(0)).alias("n"))


QUERIES = {
    "area_file": q_area_file, "area_package": q_area_package, "point_in_area": q_point_in_area, "links_in_areas": q_links_in_areas,
    "random_point_sampling": q_random_points, "hex_grid": q_hex_grid,
}

_EDGE_ROWS = " UNION ALL ".join(
    f"SELECT zone, x0 + {a[0]} AS ex, y0 + {a[1]} AS ey, x0 + {b[0]} AS fx, y0 + {b[1]} AS fy FROM own" for _, ring in _RINGS for a, b in zip(ring, ring[1:] + ring[:1], strict=True)
)
_AREAS = (
    f"own AS (SELECT CAST(n_nationkey AS BIGINT) AS zone, CAST({_PLACE['x0']} AS DOUBLE) AS x0, CAST((n_nationkey // 5) * 2002 + 0.25 AS DOUBLE) AS y0, {_PLACE['g']} AS g FROM nation)",
    f"walls AS ({_EDGE_ROWS})",
)
_INSIDE = "count(*) FILTER ((ey > {y}) <> (fy > {y}) AND {x} < ex + ({y} - ey) / nullif(fy - ey, 0) * (fx - ex)) % 2 = 1"
_SIDE = "sign(({q}x - {p}x) * ({r}y - {p}y) - ({q}y - {p}y) * ({r}x - {p}x))"
_MEASURED = "WITH " + ",\n".join(_AREAS) + """, m AS (SELECT zone, x0, y0, g, 2520000.0::DOUBLE - g * g AS area,
      1620000.0 * 900 + 720000.0 * 1400 - g * g * (200 + g / 2.0) + 180000.0 * 300 AS mx, 1620000.0 * 450 + 720000.0 * 1350 - g * g * (200 + g / 2.0) + 180000.0 * 1300 AS my FROM own)
    SELECT zone, round(area, 4) AS area, round(x0 + mx / area, 4) AS x, round(y0 + my / area, 4) AS y, 2 AS n_parts, 3 AS n_rings FROM m"""

ORACLE_SQL = {
    "area_file": _MEASURED,
    "area_package": _MEASURED,
    "point_in_area": D.with_sql("nodes", *_AREAS) + f"SELECT node, z AS zone FROM (SELECT node, walls.zone AS z FROM nodes CROSS JOIN walls GROUP BY 1, 2, x, y HAVING {_INSIDE.format(x='x', y='y')})",
    "links_in_areas": D.with_sql("links", "nodes", _SEGMENTS, *_AREAS) + f"""SELECT zone, link FROM segments CROSS JOIN walls GROUP BY zone, link, ax, ay HAVING {_INSIDE.format(x='ax', y='ay')}
      OR bool_or({_SIDE.format(p='a', q='c', r='e')} <> {_SIDE.format(p='a', q='c', r='f')} AND {_SIDE.format(p='e', q='f', r='a')} <> {_SIDE.format(p='e', q='f', r='c')})""",
    "random_point_sampling": "WITH " + ",\n".join(_AREAS) + f""",
      up AS (SELECT zone, CASE WHEN ey < fy THEN ex ELSE fx END AS px, least(ey, fy) AS py, CASE WHEN ey < fy THEN fx ELSE ex END AS qx, greatest(ey, fy) AS qy FROM walls WHERE ey <> fy),
      slabs AS (SELECT zone, y AS y0, lead(y) OVER (PARTITION BY zone ORDER BY y) AS y1 FROM (SELECT zone, py AS y FROM up UNION SELECT zone, qy FROM up)),
      met AS (SELECT up.zone, y0, y1, px + (y0 - py) * (qx - px) / (qy - py) AS b0, px + (y1 - py) * (qx - px) / (qy - py) AS b1 FROM up JOIN slabs ON slabs.zone = up.zone AND py <= y0 AND qy >= y1),
      turned AS (SELECT *, row_number() OVER (PARTITION BY zone, y0 ORDER BY b0 + b1, b0) - 1 AS n FROM met),
      t AS (SELECT zone, y0, y1, max(b0) FILTER (n % 2 = 0) AS l0, max(b1) FILTER (n % 2 = 0) AS l1, max(b0) FILTER (n % 2 = 1) AS r0, max(b1) FILTER (n % 2 = 1) AS r1 FROM turned GROUP BY zone, y0, y1, n // 2),
      s AS (SELECT *, (r0 - l0 + r1 - l1) / 2 * (y1 - y0) AS area FROM t),
      c AS (SELECT *, sum(area) OVER (PARTITION BY zone ORDER BY y0, l0, l1) / sum(area) OVER (PARTITION BY zone) AS upto, row_number() OVER (PARTITION BY zone ORDER BY y0, l0, l1) AS i,
        count(*) OVER (PARTITION BY zone) AS k FROM s WHERE area > 0),
      d AS (SELECT *, coalesce(lag(CASE WHEN i = k THEN 1.0 ELSE upto END) OVER (PARTITION BY zone ORDER BY i), 0) AS since FROM c),
      w AS (SELECT o_orderkey AS id, o_custkey % 25 AS zone, {_U.format("o_orderkey || ':zone'")}::DOUBLE AS u, {_U.format("o_orderkey || ':x'")}::DOUBLE AS ux, {_U.format("o_orderkey || ':y'")}::DOUBLE AS v FROM orders),
      p AS (SELECT id, w.zone, ux, v, y0, y1, l0, l1, r0 - l0 AS w0, r1 - l1 AS w1 FROM w JOIN d ON d.zone = w.zone AND u >= since AND (u < upto OR i = k)),
      q AS (SELECT *, v * (w0 + w1) / (w0 + sqrt(w0 * w0 + v * (w1 * w1 - w0 * w0))) AS h FROM p)
      SELECT id, zone, round(l0 + h * (l1 - l0) + ux * (w0 + h * (w1 - w0)), 6) AS x, round(y0 + h * (y1 - y0), 6) AS y FROM q""",
    "hex_grid": D.with_sql("nodes", """c AS (SELECT row_number() OVER (ORDER BY r, k) AS cell, x, y FROM (SELECT a.r, b.c AS k, 999.5 + sqrt(3) * 250 * (b.c + CASE WHEN a.r % 2 = 1 THEN 0.5 ELSE 0.0 END) AS x,
        999.5 + 1.5 * 250 * a.r AS y FROM range(CAST(floor(8001 / 375.0) + 2 AS BIGINT)) a(r), range(CAST(floor(8001 / (sqrt(3) * 250)) + 2 AS BIGINT)) b(c)) WHERE abs(x - 5000) + abs(y - 5000) < 4000.5)""",
        "best AS (SELECT node, arg_min(cell, ((n.x - c.x) ** 2 + (n.y - c.y) ** 2, cell)) AS cell FROM nodes n CROSS JOIN c GROUP BY 1)",
    ) + "SELECT c.cell, round(x, 4) AS x, round(y, 4) AS y, count(node) AS n FROM c LEFT JOIN best ON best.cell = c.cell GROUP BY 1, 2, 3",
}
