"""Queries over public-transport journeys; and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import spatial as S
from ..operators.journeys import JourneyParams, journey_attributes, journey_skim, journeys
from ..operators.transit import leg_summary
from . import derived as D

PARAMS = JourneyParams(rides=3, wait=1800.0, change=60.0, longest=7200.0, change_cost=300.0)

#: Metres that are walked to and from stops, and between stops; a metre takes 0.8 seconds, and seconds are whole.
ACCESS, CHANGE = 800.0, 500.0


def calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every order is a vehicle that calls at the suppliers of its lines, five minutes apart; odd orders are buses."""
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity")
    own = D.table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("vehicle"), F.col("l_suppkey").alias("stop"), F.row_number().over(order).alias("seq"), F.lag("l_quantity").over(order).alias("q")
    )
    departure = F.expr("cast((vehicle * 61) % 80000 as double)") + 300 * F.col("seq")
    arrival = F.when(F.col("q").isNull(), departure).otherwise(departure - 240 + 2 * F.col("q"))
    kind = F.when(F.col("vehicle") % 2 == 1, "bus").otherwise("rail")
    return own.select("vehicle", "seq", "stop", arrival.alias("arrival"), departure.alias("departure"), kind.alias("mode"), (F.col("seq") * 1000.0).alias("metres"))


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A trip of every customer: ``(trip, departure, o, d)`` between two suppliers' places."""
    n = F.broadcast(D.nodes(spark, sf_dir).agg(F.count("*").alias("n")))  # one row
    return D.table(spark, sf_dir, "customer").join(n).select(
        F.col("c_custkey").alias("trip"), F.expr("cast((c_custkey * 793) % 86400 as double)").alias("departure"), F.expr("c_custkey % n").alias("o"), F.expr("(c_custkey * 7 + 3) % n").alias("d")
    )


def _seconds(c: str = "distance"):
    return F.ceil(F.col(c) * 0.8).cast("double")


def best_legs(spark: SparkSession, sf_dir: str) -> DataFrame:
    places = D.nodes(spark, sf_dir).select("node", "x", "y")
    near = S.within(places.select(F.col("node").alias("point"), "x", "y"), places, ACCESS)
    ways = near.select("point", F.col("node").alias("stop"), _seconds().alias("seconds"), F.col("distance").alias("metres"))
    asked = requests(spark, sf_dir)
    reach = lambda end: asked.select("trip", F.col(end).alias("point")).join(ways, "point").drop("point")
    walks = ways.filter((F.col("point") != F.col("stop")) & (F.col("metres") <= CHANGE)).select(F.col("point").alias("u"), F.col("stop").alias("v"), "seconds", "metres")
    direct = asked.select("trip", F.col("o").alias("point"), F.col("d").alias("stop")).join(ways, ["point", "stop"]).select("trip", "seconds", "metres")
    return journeys(calls(spark, sf_dir), asked, reach("o"), reach("d"), walks, direct, PARAMS)


def q_journeys(spark, sf_dir):
    """Departure, arrival, changes and times of every customer's best journey."""
    legs = best_legs(spark, sf_dir).checkpoint()
    sums = leg_summary(legs).select("trip", "seconds", "wait", "changes")
    ends = legs.groupBy("trip").agg(F.min("start").alias("departure"), F.max("end").alias("arrival"))
    return ends.join(sums, "trip").select("trip", "departure", "arrival", (F.col("seconds") + F.col("wait")).alias("total"), F.col("changes").cast("long").alias("changes"))


def q_journey_legs(spark, sf_dir):
    """The legs themselves, which ties leave open in SQL."""
    return best_legs(spark, sf_dir)


def q_journey_attributes(spark, sf_dir):
    return journey_attributes(best_legs(spark, sf_dir))


def q_journey_skim(spark, sf_dir):
    """Mean times between nations, and the share of buses."""
    zone = D.nodes(spark, sf_dir).select("node", "zone")
    asked = requests(spark, sf_dir).join(zone.withColumnsRenamed({"node": "o", "zone": "zo"}), "o").join(zone.withColumnsRenamed({"node": "d", "zone": "zd"}), "d")
    out = journey_skim(best_legs(spark, sf_dir), asked.select("trip", F.col("zo").alias("o"), F.col("zd").alias("d")), "bus")
    return out.select("o", "d", "n", F.round("seconds", 6).alias("seconds"), F.round("changes", 6).alias("changes"))


QUERIES = {"pt_journeys": q_journeys, "pt_journey_legs": q_journey_legs, "pt_journey_attributes": q_journey_attributes, "pt_journey_skim": q_journey_skim}


def _round_sql(k: int, spots: str) -> str:
    """Arrivals with k vehicles from ``(trip, leave, stop, ready, until)``; the first vehicle's departure may set when one leaves."""
    leave = "least(c.dep - s.walk, s.latest)" if k == 1 else "s.leave"
    return f"""b{k} AS (SELECT s.trip, {leave} AS leave, c.vehicle, min(c.seq) AS seq FROM {spots} s JOIN c ON c.stop = s.stop AND c.dep BETWEEN s.ready AND s.until GROUP BY 1, 2, 3),
v{k} AS (SELECT b.trip, b.leave, c.stop, min(c.arr) AS arr FROM b{k} b JOIN c ON c.vehicle = b.vehicle AND c.seq > b.seq AND c.arr - b.leave <= 7200 GROUP BY 1, 2, 3)"""


def _spots_sql(k: int) -> str:
    return f"""r{k} AS (SELECT trip, leave, stop, min(ready) AS ready, min(ready) + 1800 AS until FROM (SELECT trip, leave, stop, arr + 60 AS ready FROM v{k}
  UNION ALL SELECT trip, leave, w.v, arr + seconds + 60 FROM v{k} JOIN w ON w.u = v{k}.stop) GROUP BY 1, 2, 3)"""


_JOURNEYS = D.with_sql(
    "nodes",
    """c AS (SELECT vehicle, seq, stop, mode, dep, CASE WHEN q IS NULL THEN dep ELSE dep - 240 + 2 * q END AS arr FROM (SELECT l_orderkey AS vehicle, l_suppkey AS stop,
      row_number() OVER o AS seq, lag(l_quantity) OVER o AS q, CAST((l_orderkey * 61) % 80000 AS DOUBLE) + 300 * row_number() OVER o AS dep, l_orderkey % 2 AS mode FROM lineitem
      WINDOW o AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity)))""",
    """q AS (SELECT c_custkey AS trip, CAST((c_custkey * 793) % 86400 AS DOUBLE) AS wish, c_custkey % n AS o, (c_custkey * 7 + 3) % n AS d FROM customer, (SELECT count(*) AS n FROM supplier))""",
    """near AS (SELECT p.node AS u, n.node AS v, sqrt((p.x - n.x) * (p.x - n.x) + (p.y - n.y) * (p.y - n.y)) AS metres FROM nodes p CROSS JOIN nodes n)""",
    "w AS (SELECT u, v, ceil(metres * 0.8::DOUBLE) AS seconds FROM near WHERE u <> v AND metres <= 500)",
    """s AS (SELECT trip, wish, least(wish + 900, 86399) AS latest, v AS stop, ceil(metres * 0.8::DOUBLE) AS walk, greatest(wish - 900, 0) + ceil(metres * 0.8::DOUBLE) AS ready,
      least(wish + 900, 86399) + ceil(metres * 0.8::DOUBLE) + 1800 AS until FROM q JOIN near ON u = o AND metres <= 800)""",
    _round_sql(1, "s"), _spots_sql(1), _round_sql(2, "r1"), _spots_sql(2), _round_sql(3, "r2"),
    "x AS (SELECT trip, v AS stop, ceil(metres * 0.8::DOUBLE) AS walk FROM q JOIN near ON u = d AND metres <= 800)",
    """f AS (SELECT trip, 1 AS k, leave, arr + walk AS there FROM v1 JOIN x USING (trip, stop) UNION ALL SELECT trip, 2, leave, arr + walk FROM v2 JOIN x USING (trip, stop)
      UNION ALL SELECT trip, 3, leave, arr + walk FROM v3 JOIN x USING (trip, stop)
      UNION ALL SELECT trip, 0, wish, wish + ceil(metres * 0.8::DOUBLE) FROM q JOIN near ON u = o AND v = d AND metres <= 800)""",
    """best AS (SELECT trip, k, leave, there FROM (SELECT f.*, row_number() OVER (PARTITION BY f.trip ORDER BY there - leave + 300 * greatest(k - 1, 0), k, abs(leave - wish), leave, there) AS r
      FROM f JOIN q USING (trip)) WHERE r = 1)""",
)

ORACLE_SQL = {
    "pt_journeys": _JOURNEYS + "SELECT trip, leave AS departure, there AS arrival, there - leave AS total, CAST(greatest(k - 1, 0) AS BIGINT) AS changes FROM best",
    "pt_journey_skim": _JOURNEYS + """SELECT a.s_nationkey AS o, b.s_nationkey AS d, count(*) AS n, round(avg(there - leave), 6) AS seconds, round(avg(greatest(k - 1, 0)), 6) AS changes
FROM best JOIN q USING (trip) JOIN supplier a ON a.s_suppkey = q.o JOIN supplier b ON b.s_suppkey = q.d GROUP BY 1, 2""",
}
