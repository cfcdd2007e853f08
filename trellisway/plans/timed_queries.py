"""Queries over congested link times and the paths that they make quickest; and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import network as N
from ..operators import timed as T
from . import derived as D


def stays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of vehicles: an order enters the link between its consecutive suppliers every five minutes and stays as its quantity says."""
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity")
    steps = D.table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("vehicle"), F.col("l_suppkey").alias("a"), F.lead("l_suppkey").over(order).alias("b"),
        (F.expr("cast((l_orderkey * 61) % 80000 as double)") + 300 * F.row_number().over(order)).alias("t"), (F.col("l_quantity") * 3).alias("stay"),
    ).filter("b is not null and a <> b")
    both = F.explode(F.array(F.struct(F.col("t").alias("time"), F.lit("enter").alias("kind")), F.struct((F.col("t") + F.col("stay")).alias("time"), F.lit("leave").alias("kind"))))
    return steps.select("vehicle", F.expr("a * 1000003 + b").alias("link"), both.alias("e")).select("vehicle", "link", "e.time", "e.kind")


def _links(spark, sf_dir):
    return D.links(spark, sf_dir).select("a", "b", (F.col("length") / 2).alias("time"), F.col("length").alias("dist"))


def _times(spark, sf_dir):
    return N.congested_times(stays(spark, sf_dir)).select(F.expr("link div 1000003").alias("a"), F.expr("link % 1000003").alias("b"), "bin", "time")


def q_congested(spark, sf_dir):
    """Mean time on every link by the quarter of an hour in which it is entered."""
    return N.congested_times(stays(spark, sf_dir))


def q_timed(spark, sf_dir):
    """Arrival of every trip, which leaves at the full hour of its start, over congested links."""
    trips = D.trips(spark, sf_dir).select("trip", "origin", "target", F.expr("cast(start div 3600 * 3600 as double)").alias("departure"))
    found = T.timed_paths(_links(spark, sf_dir), _times(spark, sf_dir), trips)
    return trips.join(found, ["origin", "target", "departure"]).select("trip", "departure", F.round("arrival", 6).alias("arrival"))


def q_timed_by_joins(spark, sf_dir):
    """The same where the graph is not sent: every trip leaves at noon or midnight, whichever comes before its start."""
    trips = D.trips(spark, sf_dir).select("trip", "origin", "target", F.expr("cast(start div 43200 * 43200 as double)").alias("departure"))
    found = T.timed_paths(_links(spark, sf_dir), _times(spark, sf_dir), trips, max_links=0)
    return trips.join(found, ["origin", "target", "departure"]).select("trip", "departure", F.round("arrival", 6).alias("arrival"))


QUERIES = {"congested_times": q_congested, "timed_paths": q_timed, "timed_paths_by_joins": q_timed_by_joins}

_STAYS = """stays AS (SELECT a, b, CAST(floor(t / 900) AS BIGINT) AS bin, 3 * q AS stay FROM (SELECT l_suppkey AS a, lead(l_suppkey) OVER o AS b,
    CAST((l_orderkey * 61) % 80000 AS DOUBLE) + 300 * row_number() OVER o AS t, l_quantity AS q FROM lineitem
    WINDOW o AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity)) WHERE b IS NOT NULL AND a <> b)"""


def _timed_sql(hours: int) -> str:
    return "WITH RECURSIVE " + ",\n".join([
        D.SQL["links"], D.SQL["trips"], _STAYS, "e AS (SELECT a, b, length / 2 AS free FROM links)",
        """seen AS (SELECT a, b, bin, avg(stay) AS time FROM stays GROUP BY 1, 2, 3)""",
        """cells AS (SELECT e.a, e.b, e.free, k.bin, coalesce(seen.time, e.free) AS tau FROM e JOIN (SELECT DISTINCT a, b FROM seen) USING (a, b) CROSS JOIN range(96) AS k(bin)
          LEFT JOIN seen ON seen.a = e.a AND seen.b = e.b AND seen.bin = k.bin)""",
        """p AS (SELECT a, b, bin, tau, least(86400 + free, coalesce(min(bin * 900 + tau) OVER (PARTITION BY a, b ORDER BY bin ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), 86400 + free)) AS later
          FROM cells)""",
        f"own AS (SELECT trip, origin, target, CAST(start // {3600 * hours} * {3600 * hours} AS DOUBLE) AS departure FROM trips)",
        """tree(origin, departure, node, arrival) USING KEY (origin, departure, node) AS (
          SELECT DISTINCT origin, departure, origin, departure FROM own
          UNION
          SELECT g.origin, g.departure, g.b, min(g.arrival) FROM (SELECT tree.origin, tree.departure, e.b, CASE WHEN p.tau IS NULL THEN tree.arrival + e.free ELSE least(tree.arrival + p.tau, p.later) END AS arrival
            FROM tree JOIN e ON e.a = tree.node LEFT JOIN p ON p.a = e.a AND p.b = e.b AND p.bin = CAST(floor(tree.arrival / 900) AS BIGINT)) g
            LEFT JOIN recurring.tree AS old ON old.origin = g.origin AND old.departure = g.departure AND old.node = g.b
            WHERE old.arrival IS NULL OR g.arrival < old.arrival GROUP BY 1, 2, 3)""",
    ]) + "\nSELECT trip, departure, round(arrival, 6) AS arrival FROM own JOIN tree USING (origin, departure) WHERE node = target"


ORACLE_SQL = {
    "congested_times": "WITH " + _STAYS + " SELECT a * 1000003 + b AS link, bin, avg(stay) AS time, count(*) AS n FROM stays GROUP BY 1, 2",
    "timed_paths": _timed_sql(1),
    "timed_paths_by_joins": _timed_sql(12),
}
