"""A transport network, trips, places, events and choices derived from the driver's tables.

The derivations are plain arithmetic on keys; the SQL fragments of :data:`SQL` state the same for the oracle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.access import sent_if_small

#: Lines of orders that a task takes where there are more of them than the cluster's cores take at once.
LINES_PER_TASK = 300_000

#: Attribute columns of a link from ``h``, in SQL that Spark and DuckDB read alike.
LINK_ATTRIBUTES = {
    "limit_mph": "CAST(20 + 10 * (h % 5) AS DOUBLE)",
    "aadt_fwd": "CAST((h * 37) % 6000 AS DOUBLE)",
    "aadt": "CAST((h * 37) % 12000 AS DOUBLE)",
    "lanes": "CAST(1 + h % 3 AS DOUBLE)",
    "capacity": "CAST(500 * (1 + h % 4) AS DOUBLE)",
    "width": "CAST(3 + h % 9 AS DOUBLE)",
    "freespeed": "(20 + 10 * (h % 5)) * 0.44704",
    "junction": "CASE WHEN h % 23 = 0 THEN 'roundabout' ELSE 'none' END",
    "cycleosm": "CASE h % 6 WHEN 0 THEN 'offroad' WHEN 1 THEN 'kerbed' WHEN 2 THEN 'protected' WHEN 3 THEN 'painted' WHEN 4 THEN 'integrated' END",
    "cycleway": "CASE h % 4 WHEN 0 THEN 'track' WHEN 1 THEN 'lane' WHEN 2 THEN 'share_busway' ELSE 'no' END",
    "surface": "CASE h % 9 WHEN 0 THEN 'asphalt' WHEN 1 THEN 'gravel' WHEN 2 THEN 'sett' WHEN 3 THEN 'null' WHEN 4 THEN 'sand' WHEN 5 THEN 'compacted' "
    "WHEN 6 THEN 'moss' WHEN 7 THEN 'grass' END",
    "road": "CASE h % 5 WHEN 0 THEN 'primary' WHEN 1 THEN 'secondary' WHEN 2 THEN 'residential' WHEN 3 THEN 'cycleway' END",
    "speed85_kph": "CASE WHEN h % 7 = 0 THEN NULL ELSE CAST(30 + h % 60 AS DOUBLE) END",
    "crossing": "CASE b % 4 WHEN 0 THEN 'Car signal' WHEN 1 THEN 'crossing point' WHEN 2 THEN 'toucan' END",
    "vgvi": "(h % 100) / 100.0",
    "shannon": "(h % 20) / 10.0",
    "pois": "CAST(h % 5 AS DOUBLE)",
    "neg_pois": "CAST(h % 3 AS DOUBLE)",
    "crime": "CAST(h % 7 AS DOUBLE)",
    "hgv_pois": "CAST(h % 2 AS DOUBLE)",
    "lights": "CAST(h % 8 AS DOUBLE)",
    "allows_car": "h % 10 <> 0",
    "allows_bike": "h % 11 <> 0",
    "dismount": "h % 13 = 0",
    "crosses": "h % 4 <> 0",
    "cross_width": "CAST(2 * (h % 10) AS DOUBLE)",
    "cross_lanes": "CAST(h % 5 AS DOUBLE)",
    "cross_aadt": "CASE WHEN h % 9 = 0 THEN NULL ELSE CAST((h * 53) % 15000 AS DOUBLE) END",
    "cross_limit_mph": "CAST(20 + 10 * ((h + 1) % 6) AS DOUBLE)",
    "cross_speed85_kph": "CASE WHEN h % 5 = 0 THEN NULL ELSE CAST(40 + h % 50 AS DOUBLE) END",
    "osm_id": "CASE WHEN h % 6 = 0 THEN -1 ELSE h % 17 END",
    "road_name": "CASE WHEN h % 4 = 0 THEN '' ELSE 'road ' || CAST(h % 19 AS VARCHAR(20)) END",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tasks(spark: SparkSession, sf_dir: str) -> int | None:
    """Tasks that rows derived from order lines are dealt over, so that one's share stays as it is when the lines grow; None leaves it to Spark."""
    n = -(-table(spark, sf_dir, "lineitem").count() // LINES_PER_TASK)
    return n if n > spark.sparkContext.defaultParallelism else None


def dealt(rows: DataFrame, n: int | None, *keys: str) -> DataFrame:
    """Rows by keys over ``n`` tasks, or as they are."""
    return rows if n is None else rows.repartition(n, *keys)


def links(spark: SparkSession, sf_dir: str, key: str = "l_suppkey") -> DataFrame:
    """Links ``(a, b, length)`` between keys of consecutive lines of an order; of parallel ones the shortest counts.

    They are dealt by ``a``, so that parallel links meet and a node's links stand together after one shuffle. Many lines are dealt over more
    tasks (:func:`tasks`), since Spark would join small partitions to a few large ones.
    """
    n = tasks(spark, sf_dir)
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity")
    steps = dealt(table(spark, sf_dir, "lineitem"), n, "l_orderkey").select(
        F.col(key).alias("a"), F.lead(key).over(order).alias("b"), (F.col("l_quantity") * 10 + F.round(F.col("l_discount") * 100)).alias("w")
    ).filter("b is not null and a <> b")
    return (steps.repartition("a") if n is None else steps.repartition(n, "a")).groupBy("a", "b").agg(F.min("w").alias("length"))


def full_links(spark: SparkSession, sf_dir: str, own: DataFrame | None = None) -> DataFrame:
    """Links with every attribute, and the heights of both ends; ``own`` are the :func:`links` where they are there already.

    The heights are sent if they are few, so that links are not shuffled for them.
    """
    base = (links(spark, sf_dir) if own is None else own).withColumn("h", F.expr("a * 31 + b * 17"))
    base = base.withColumns({name: F.expr(sql) for name, sql in LINK_ATTRIBUTES.items()})
    z = sent_if_small(nodes(spark, sf_dir).select("node", "z"))
    return (
        base.join(z.withColumnsRenamed({"node": "a", "z": "z_from"}), "a", "left").join(z.withColumnsRenamed({"node": "b", "z": "z_to"}), "b", "left")
    )


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").alias("node"), F.expr("cast((s_suppkey * 7919) % 10007 as double)").alias("x"),
        F.expr("cast((s_suppkey * 104729) % 10009 as double)").alias("y"), (F.col("s_acctbal") / 100).alias("z"), F.col("s_nationkey").alias("zone"),
    )


def trips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A trip per order, from the supplier of its first line to that of its last."""
    place = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity")
    ends = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(
        F.min_by("l_suppkey", place).alias("origin"), F.max_by("l_suppkey", place).alias("target")
    )
    orders = table(spark, sf_dir, "orders")
    return orders.join(ends, orders["o_orderkey"] == ends["l_orderkey"]).select(
        F.col("o_orderkey").alias("trip"), "origin", "target", F.col("o_orderpriority").alias("mode"), F.col("o_orderstatus").alias("purpose"),
        F.expr("(o_orderkey * 61) % 86400").alias("start"),
    )


def locations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Destinations: a customer with two access points; the set is the market segment."""
    n = table(spark, sf_dir, "supplier").agg(F.count("*").alias("n"))  # one row
    own = table(spark, sf_dir, "customer").join(F.broadcast(n))
    points = F.array(F.expr("c_custkey % n"), F.expr("(c_custkey * 7) % n"))
    return own.select(
        F.col("c_mktsegment").alias("set"), F.col("c_custkey").alias("id"), F.greatest("c_acctbal", F.lit(0.0)).alias("weight"),
        F.explode(F.array_distinct(points)).alias("node"),
    )


def link_events(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Entries ``(vehicle, link, time)`` and vehicles ``(vehicle, type)``; the type follows the event's type."""
    own = table(spark, sf_dir, "events").select(
        "event_id", "event_type", F.expr("user_id % 50").alias("link"), F.expr("cast(hour(ts) * 3600 + minute(ts) * 60 + second(ts) as bigint)").alias("time")
    )
    kind = F.when(F.col("event_type").isin("view", "click"), "car").when(F.col("event_type") == "purchase", "truck").otherwise("other")
    return own.select(F.col("event_id").alias("vehicle"), "link", "time"), own.select(F.col("event_id").alias("vehicle"), kind.alias("type"))


SQL = {
    "links": """links AS (SELECT a, b, min(w) AS length FROM (
      SELECT l_suppkey AS a, lead(l_suppkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity) AS b,
        l_quantity * 10 + round(l_discount * 100) AS w FROM lineitem) WHERE b IS NOT NULL AND a <> b GROUP BY 1, 2)""",
    "nodes": """nodes AS (SELECT s_suppkey AS node, CAST((s_suppkey * 7919) % 10007 AS DOUBLE) AS x, CAST((s_suppkey * 104729) % 10009 AS DOUBLE) AS y,
      s_acctbal / 100 AS z, s_nationkey AS zone FROM supplier)""",
    "full": "full_links AS (SELECT l.*, za.z AS z_from, zb.z AS z_to, "
    + ", ".join(f"{sql} AS {name}" for name, sql in LINK_ATTRIBUTES.items())
    + " FROM (SELECT *, a * 31 + b * 17 AS h FROM links) l LEFT JOIN nodes za ON za.node = l.a LEFT JOIN nodes zb ON zb.node = l.b)",
    "trips": """ends AS (SELECT DISTINCT l_orderkey,
      first_value(l_suppkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity) AS origin,
      first_value(l_suppkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber DESC, l_partkey DESC, l_suppkey DESC, l_extendedprice DESC, l_quantity DESC) AS target
      FROM lineitem),
    trips AS (SELECT o_orderkey AS trip, origin, target, o_orderpriority AS mode, o_orderstatus AS purpose, (o_orderkey * 61) % 86400 AS start
      FROM orders JOIN ends ON l_orderkey = o_orderkey)""",
    "locations": """points AS (SELECT c_mktsegment AS set, c_custkey AS id, greatest(c_acctbal, 0.0) AS weight, c_custkey % n AS p, (c_custkey * 7) % n AS q
      FROM customer, (SELECT count(*) AS n FROM supplier)),
    locations AS (SELECT set, id, weight, p AS node FROM points UNION SELECT set, id, weight, q FROM points)""",
    "tree": """tree(origin, node, cost) USING KEY (origin, node) AS (
      SELECT DISTINCT node, node, CAST(0 AS DOUBLE) FROM seeds
      UNION
      SELECT tree.origin, e.b, min(tree.cost + e.w) FROM tree JOIN e ON e.a = tree.node
        LEFT JOIN recurring.tree AS old ON old.origin = tree.origin AND old.node = e.b
        WHERE old.cost IS NULL OR tree.cost + e.w < old.cost GROUP BY 1, 2)""",
    "events": """ev AS (SELECT event_id AS vehicle, user_id % 50 AS link,
      CAST(hour(ts) * 3600 + minute(ts) * 60 + second(ts) AS BIGINT) AS time,
      CASE WHEN event_type IN ('view', 'click') THEN 'car' WHEN event_type = 'purchase' THEN 'truck' ELSE 'other' END AS type FROM events)""",
}


def with_sql(*names: str, recursive: bool = False) -> str:
    """WITH clause of the named fragments; names with a space are fragments of their own."""
    return f"WITH {'RECURSIVE ' if recursive else ''}" + ",\n".join(SQL.get(n, n) for n in names) + "\n"
