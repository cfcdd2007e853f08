"""Queries over demand synthesis, mode choice and streamed volumes; and their SQL."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import choice as M
from ..operators import demand as Q
from ..sources.shared import new_folder
from ..streaming import volumes as V
from . import derived as D

# Three periods and five classes of the orders' flows.
_PERIOD = "CASE o_orderstatus WHEN 'F' THEN 'AM' WHEN 'O' THEN 'IP' ELSE 'PM' END"
_FLOWS_OF = [f"{_PERIOD} AS period", "concat('uc', substr(o_orderpriority, 1, 1)) AS uc", "o_custkey % 25 AS o", "(o_custkey * 7) % 25 AS d"]


def flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = D.table(spark, sf_dir, "orders").selectExpr(*_FLOWS_OF)
    return own.groupBy("period", "uc", "o", "d").agg((F.count("*") * 0.37).alias("trips"))


def q_factors(spark, sf_dir):
    out = Q.period_factors(flows(spark, sf_dir))
    return out.select("period", "uc", "o", "d", F.round("daily", 6).alias("daily"), "external_only")


def q_expand(spark, sf_dir):
    out = Q.expand(flows(spark, sf_dir), "trips", "period", "uc", "o", "d", scale=0.8)
    return out.select("period", "uc", "o", "d", F.col("n").cast("bigint").alias("n"))


def minutes(spark, sf_dir):
    return D.table(spark, sf_dir, "events").groupBy(F.expr("hour(ts) * 60 + minute(ts)").alias("minute")).agg(F.count("*").cast("double").alias("weight"))


def q_density(spark, sf_dir):
    out = Q.cumulative_density(minutes(spark, sf_dir))
    return out.select("minute", F.round("low", 9).alias("low"), F.round("high", 9).alias("high"))


def q_times(spark, sf_dir):
    trips = D.table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("trip"), F.expr("CASE o_orderstatus WHEN 'F' THEN 'AM' WHEN 'O' THEN 'IP' ELSE 'OP' END").alias("period")
    )
    return Q.sample_times(trips, minutes(spark, sf_dir), "trip").select("trip", "period", "seconds")


def q_departures(spark, sf_dir):
    n = D.nodes(spark, sf_dir)
    t = D.trips(spark, sf_dir).join(n.select(F.col("node").alias("origin"), F.col("x").alias("ox")), "origin").join(n.select(F.col("node").alias("target"), "x"), "target")
    t = t.withColumns({"free": F.abs(F.col("x") - F.col("ox")), "origin_inside": F.col("ox") < 5000, "target_inside": F.col("x") < 5000})
    return Q.gate(t).select("trip", Q.departure("start", "free").alias("departure"), "kind")


SPEC = M.Specification(
    utilities={
        "urgent": [("b_price", "0.5 * price")],
        "high": [("asc_high", "1"), ("b_price", "price")],
        "medium": [("asc_medium", "1"), ("b_day", "day")],
        "none": [("asc_none", "1"), ("b_cust", "cust")],
        "low": [("asc_low", "1"), ("b_day", "-day"), ("b_cust", "0.3 * cust")],
    },
    available={"none": "keep"},
)

#: A point at which probabilities, likelihood and gradient are stated in SQL.
POINT = {"b_price": 0.2, "asc_high": -0.1, "asc_medium": 0.3, "b_day": -0.4, "asc_none": 0.05, "b_cust": 0.6, "asc_low": -0.25}


def choices(spark, sf_dir):
    return D.table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id"), (F.substring("o_orderpriority", 1, 1).cast("int") - 1).alias("choice"), (F.col("o_totalprice") / 100000).alias("price"),
        (F.day("o_orderdate") / 31).alias("day"), ((F.col("o_custkey") % 10) / 10).alias("cust"),
        (F.col("o_custkey") % 7 != 0).alias("k"),
    ).withColumn("keep", F.col("k") | (F.col("choice") == 3)).drop("k")


def _beta() -> np.ndarray:
    return np.array([POINT[c] for c in SPEC.coefficients()])


def q_probabilities(spark, sf_dir):
    out = M.probabilities(choices(spark, sf_dir), SPEC, POINT)
    return out.select("id", *(F.round(F.get("p", i), 9).alias(f"p_{a}") for i, a in enumerate(SPEC.utilities)))


def q_loglik(spark, sf_dir):
    f, _ = M.likelihood(choices(spark, sf_dir), SPEC, _beta())
    return spark.createDataFrame([(round(-f, 4),)], "loglik double")


def q_gradient(spark, sf_dir):
    _, g = M.likelihood(choices(spark, sf_dir), SPEC, _beta())
    return spark.createDataFrame([(c, round(float(x), 4)) for c, x in zip(SPEC.coefficients(), g, strict=True)], "coefficient string, gradient double")


def q_estimate(spark, sf_dir):
    found = M.estimate(choices(spark, sf_dir), SPEC)
    rows = [(n, round(b, 5), s, t, p, mark) for n, b, s, t, p, mark in found.rows]
    return spark.createDataFrame(rows, "coefficient string, value double, std_err double, t double, p double, stars string")


_PERSONAS = {"dear": "o_totalprice > 150000", "early": "day(o_orderdate) <= 10", "even": "o_custkey % 2 = 0"}


def q_personas(spark, sf_dir):
    found = M.personas(D.table(spark, sf_dir, "orders"), _PERSONAS)
    weighed = M.persona_weights(found, _PERSONAS, {"dear": 0.5, "early": -0.75, "even": 0.25})
    return weighed.select("persona", F.concat_ws("", F.transform("valid", lambda v: v.cast("int").cast("string"))).alias("valid"), "n", "weight")


def q_stream(spark, sf_dir):
    """Hourly volumes by a stream over the events' files."""
    schema = D.table(spark, sf_dir, "events").schema
    raw = V.entries(spark, f"{sf_dir}/events*.parquet", schema)
    kind = F.when(F.col("event_type").isin("view", "click"), "car").when(F.col("event_type") == "purchase", "truck").otherwise("other")
    result = V.hourly(raw.select(F.col("ts").cast("timestamp").alias("ts"), F.expr("user_id % 50").alias("link"), kind.alias("type")), late="45 days")
    return V.run_once(result, new_folder(spark, "volumes"), new_folder(spark, "volume-state"), ["link", "hour"]).withColumn("hour", F.col("hour").cast("timestamp_ntz"))


QUERIES = {
    "period_factors": q_factors,
    "od_expand": q_expand,
    "time_density_cumulative": q_density,
    "sampled_times": q_times,
    "departure_adjust": q_departures,
    "mnl_probabilities": q_probabilities,
    "mnl_loglik": q_loglik,
    "mnl_gradient": q_gradient,
    "mnl_estimate": q_estimate,
    "personas": q_personas,
    "stream_hourly_volumes": q_stream,
}

_U = "CAST('0x' || substr(md5({}), 1, 8) AS BIGINT) / 4294967296.0"
_FLOWS = f"flows AS (SELECT period, uc, o, d, count(*) * CAST(0.37 AS DOUBLE) AS trips FROM (SELECT {", ".join(_FLOWS_OF)} FROM orders) GROUP BY ALL)"
_MINUTES = "minutes AS (SELECT CAST(hour(ts) * 60 + minute(ts) AS INTEGER) AS minute, CAST(count(*) AS DOUBLE) AS weight FROM events GROUP BY 1)"
_CHOICES = """choices AS (SELECT o_orderkey AS id, CAST(substr(o_orderpriority, 1, 1) AS INTEGER) - 1 AS choice, o_totalprice / 100000 AS price,
  day(o_orderdate) / 31 AS day, (o_custkey % 10) / 10 AS cust, o_custkey % 7 <> 0 OR o_orderpriority LIKE '4%' AS keep FROM orders),
u AS (SELECT *, 0.2 * (0.5 * price) AS u0, -0.1 + 0.2 * price AS u1, 0.3 - 0.4 * day AS u2, CASE WHEN keep THEN 0.05 + 0.6 * cust END AS u3,
  -0.25 + 0.4 * day + 0.6 * (0.3 * cust) AS u4 FROM choices),
e AS (SELECT *, exp(u0) AS e0, exp(u1) AS e1, exp(u2) AS e2, coalesce(exp(u3), 0.0) AS e3, exp(u4) AS e4 FROM u),
p AS (SELECT *, e0 / t AS p0, e1 / t AS p1, e2 / t AS p2, e3 / t AS p3, e4 / t AS p4 FROM (SELECT *, e0 + e1 + e2 + e3 + e4 AS t FROM e))
"""
_G = {
    "b_price": "(p0 - (choice = 0)::INT) * 0.5 * price + (p1 - (choice = 1)::INT) * price",
    "asc_high": "p1 - (choice = 1)::INT",
    "asc_medium": "p2 - (choice = 2)::INT",
    "b_day": "(p2 - (choice = 2)::INT) * day - (p4 - (choice = 4)::INT) * day",
    "asc_none": "p3 - (choice = 3)::INT",
    "b_cust": "(p3 - (choice = 3)::INT) * cust + (p4 - (choice = 4)::INT) * 0.3 * cust",
    "asc_low": "p4 - (choice = 4)::INT",
}

ORACLE_SQL = {
    "period_factors": f"""WITH {_FLOWS} SELECT period, uc, o, d, CAST(round(trips * CASE period WHEN 'AM' THEN 2.58 WHEN 'IP' THEN 9.159 ELSE 2.75 END
  / CASE WHEN uc = 'uc5' THEN 2.5 ELSE 1.0 END, 6) AS DOUBLE) AS daily, uc IN ('uc1', 'uc3') AS external_only FROM flows""",
    "od_expand": f"""WITH {_FLOWS}, k AS (SELECT *, concat_ws(':', period, uc, o, d) AS key FROM flows),
  made AS (SELECT *, unnest(range(1, CAST(floor(trips) + CASE WHEN {_U.format("key || ':rest'")} < trips - floor(trips) THEN 1 ELSE 0 END AS BIGINT) + 1)) AS n FROM k)
SELECT period, uc, o, d, n FROM made WHERE {_U.format("key || ':' || n || ':keep'")} < 0.8""",
    "time_density_cumulative": f"""WITH {_MINUTES}, c AS (SELECT minute, sum(weight) OVER (ORDER BY minute) / sum(weight) OVER () AS high FROM minutes)
SELECT minute, round(coalesce(lag(high) OVER (ORDER BY minute), 0), 9) AS low, round(high, 9) AS high FROM c""",
    "sampled_times": f"""WITH {_MINUTES}, hours(period, a, b) AS (VALUES ('AM', 7, 10), ('IP', 10, 16), ('PM', 16, 19), ('OP', 19, 7)),
  own AS (SELECT period, minute, weight, (minute - a * 60 + 1440) % 1440 AS place FROM minutes, hours
    WHERE CASE WHEN a > b THEN minute // 60 >= a OR minute // 60 < b ELSE minute // 60 >= a AND minute // 60 < b END),
  dense AS (SELECT period, minute, sum(weight) OVER (PARTITION BY period ORDER BY place) / sum(weight) OVER (PARTITION BY period) AS high FROM own),
  trips AS (SELECT o_orderkey AS trip, CASE o_orderstatus WHEN 'F' THEN 'AM' WHEN 'O' THEN 'IP' ELSE 'OP' END AS period, {_U.format("o_orderkey || ':minute'")} AS u FROM orders)
SELECT trip, t.period, CAST(minute * 60 + floor({_U.format("trip || ':second'")} * 60) AS BIGINT) AS seconds FROM trips t ASOF JOIN dense d ON d.period = t.period AND t.u < d.high""",
    "departure_adjust": D.with_sql("nodes", "trips") + """, t AS (SELECT trip, start, abs(d.x - o.x) AS free, o.x < 5000 AS oi, d.x < 5000 AS di FROM trips
  JOIN nodes o ON o.node = origin JOIN nodes d ON d.node = target)
SELECT trip, CASE WHEN start - free / 2 < 0 THEN start - free / 2 + 86400 ELSE start - free / 2 END AS departure,
  CASE WHEN oi AND di THEN 'internal' WHEN di THEN 'entry' WHEN oi THEN 'exit' ELSE 'through' END AS kind FROM t""",
    "mnl_probabilities": f"WITH {_CHOICES}SELECT id, " + ", ".join(f"round(p{i}, 9) AS p_{a}" for i, a in enumerate(SPEC.utilities)) + " FROM p",
    "mnl_loglik": f"WITH {_CHOICES}SELECT round(sum(ln(CASE choice WHEN 0 THEN p0 WHEN 1 THEN p1 WHEN 2 THEN p2 WHEN 3 THEN p3 ELSE p4 END)), 4) AS loglik FROM p",
    "mnl_gradient": f"WITH {_CHOICES}" + " UNION ALL ".join(f"SELECT '{c}' AS coefficient, round(sum({x}), 4) AS gradient FROM p" for c, x in _G.items()),
    "personas": """WITH v AS (SELECT o_totalprice > 150000 AS a, day(o_orderdate) <= 10 AS b, o_custkey % 2 = 0 AS c FROM orders),
  g AS (SELECT a, b, c, count(*) AS n FROM v GROUP BY 1, 2, 3)
SELECT CAST(dense_rank() OVER (ORDER BY a, b, c) - 1 AS INTEGER) AS persona, concat(a::INT, b::INT, c::INT) AS valid, n,
  CAST(greatest(0.0, 0.5 * a::INT - 0.75 * b::INT + 0.25 * c::INT) AS DOUBLE) AS weight FROM g""",
    "stream_hourly_volumes": """SELECT user_id % 50 AS link, date_trunc('hour', ts) AS hour, count(*) FILTER (event_type IN ('view', 'click')) AS car,
  count(*) FILTER (event_type = 'purchase') AS truck FROM events WHERE event_type IN ('view', 'click', 'purchase') GROUP BY 1, 2""",
}
