"""Compositions on a small network."""

import random

from pyspark.sql import functions as F

from trellisway.functions.decay import Decay
from trellisway.operators import choice as M
from trellisway.operators import paths as P
from trellisway.plans import jobs as J

SQUARE = "array<struct<x:double,y:double>>"


def ladder(spark, n=12):
    """A ring road with chords; attributes follow from the ends."""
    draw = random.Random(3)
    rows = [(i, (i + 1) % n, 10.0 + i % 3, 10.0, i % 2 * 1.0, i % 5 / 5) for i in range(n)] + [((i + 1) % n, i, 11.0, 10.0, 0.5, 0.1) for i in range(n)]
    rows += [(i, (i + 5) % n, 40.0 + draw.randrange(5), 30.0, 0.0, 1.0) for i in range(n)]
    return spark.createDataFrame(rows, "a long, b long, time double, dist double, green double, jct double").withColumn("cost", F.col("time"))


def trips(spark, n=12):
    return spark.createDataFrame([(f"t{i}{j}", i, j) for i in range(n) for j in (3, 8)] + [("lost", 1, None)], "trip_id string, origin_node long, target_node long")


def test_routes(spark):
    links = ladder(spark)
    rows = J.route_trips(trips(spark), {"fast": links, "short": links.withColumn("cost", F.col("dist"))}, {"green": F.col("green")}).collect()
    by = {(r.trip_id, r.route): r for r in rows}
    assert len(by) == 48 and by["t38", "fast"].cost <= by["t38", "short"].time and by["t33", "fast"].green is None
    assert all(by[k, "short"].dist <= by[k, "fast"].dist for k, _ in by)


def test_samples_agree_with_single_runs(spark):
    links, own = ladder(spark), trips(spark)
    drawn, counts = J.sample_routes(own, links, {"green": (0.0, 2.0), "jct": (0.0, 30.0)}, 6)
    weights = {r.draw: list(r.weights) for r in drawn.collect()}
    assert all(0 <= g < 2 and 0 <= j < 30 for g, j in weights.values())
    pairs = own.select(F.col("origin_node").alias("origin"), F.col("target_node").alias("target")).dropna()
    seen = {}
    for g, j in weights.values():
        for r in P.paths(links.withColumn("cost", F.col("time") * (1 + g * F.col("green") + j * F.col("jct"))), pairs).collect():
            seen.setdefault((r.origin, r.target), set()).add(tuple(r.nodes))
    got = {r.trip_id: (r.routes, r.paths) for r in counts.collect()}
    assert got == {f"t{o}{t}": (6, len(v)) for (o, t), v in seen.items()}


def test_access_and_corridors(spark):
    links = ladder(spark)
    places = spark.createDataFrame([("food", 1, 2, 4.0), ("food", 1, 6, 4.0), ("park", 2, 9, 1.0)], "set string, id long, node long, weight double")
    origins = spark.range(12).select(F.col("id").alias("origin"))
    decay = Decay("exponential", beta=0.05)
    found = {(r.origin, r.set): r for r in J.accessibility(links, origins, places, decay, {"food": 0.5}).collect()}
    assert len(found) == 24 and found[2, "food"].accessibility == 2.0 and found[2, "food"].normalised_accessibility == 1.0
    people = origins.select(F.col("origin").alias("node"), F.lit(10.0).alias("population"))
    picked = J.intervention(links, origins, people, places, decay, 2).collect()
    assert sorted((r.set, r.iteration) for r in picked) == [("food", 0), ("food", 1), ("park", 0), ("park", 1)]
    assert J.corridor_table(trips(spark), links).filter("detour < 0 or detour >= 0.25").count() == 0


def test_demand(spark):
    flows = spark.createDataFrame([(1, 2, 5), (2, 1, 3), (1, 1, 2)], "o long, d long, trips int")
    nodes = spark.createDataFrame([(1, i) for i in range(6)] + [(2, i) for i in range(6, 12)], "zone long, node long")
    volume = J.census_volumes(flows, nodes, ladder(spark))
    assert volume.count() > 0 and volume.agg(F.sum("trips")).first()[0] >= 8
    square = lambda x: [(x, 0.0), (x + 9.0, 0.0), (x + 9.0, 9.0), (x, 9.0)]
    zones = spark.createDataFrame([(1, square(0.0)), (2, square(100.0))], f"zone long, ring {SQUARE}")
    minutes = spark.range(1440).select(F.col("id").cast("int").alias("minute"), F.lit(1.0).alias("weight"))
    rows = spark.createDataFrame([("AM", "uc2", 1, 2, 4.0), ("PM", "uc5", 2, 2, 1.0)], "period string, uc string, o long, d long, trips double")
    made = J.plans(rows, zones, minutes).collect()
    assert len({r.origin_x for r in made if r.period == "AM"}) == 1 and 10 <= sum(r.period == "AM" for r in made) <= 11
    for r in made:
        low, high = {"AM": (7, 10), "PM": (16, 19)}[r.period]
        assert low * 3600 <= r.seconds < high * 3600 and r.start <= r.seconds
        assert (r.origin_x < 10) == (r.o == 1) and (r.target_x > 99) == (r.d == 2)


def test_network(spark):
    rows = [(1, 1, 2, 10.0, ["car", "walk"], False, 4.0, 2.0, 600.0, "primary", 7, "main", 30.0, 100.0), (2, 2, 3, 10.0, ["car", "bike"], True, 4.0, 1.0, 600.0, None, 8, "", 20.0, 50.0),
            (3, 3, 1, 9.0, ["car", "walk", "bike"], False, 4.0, 9.0, 600.0, None, 9, "x", 20.0, 10.0), (4, 2, 9, 5.0, ["walk"], False, 2.0, 1.0, 0.0, None, -1, "", 20.0, 0.0)]
    kinds = "edge_id long, a long, b long, length double, modes array<string>, one_way boolean, width double, lanes double, capacity double, road string, osm_id long, name string, limit_mph double, aadt_fwd double"
    found = {r.link_id: r for r in J.build_network(spark.createDataFrame(rows, kinds)).collect()}
    assert set(found) == {f"{e}{w}" for e in (1, 2, 3, 4) for w in ("out", "rtn")}
    assert "car" not in found["2rtn"].modes and found["1out"].aadt == 200.0 and found["3out"].lanes == 8.0
    assert found["2rtn"].crosses and not found["1out"].crosses and not found["1out"].disconnected_car


def test_estimate_or_predict(spark, tmp_path):
    spec = M.Specification({"a": [("b", "x")], "c": [("asc", "1")]})
    data = spark.createDataFrame([(i, i % 7 / 3.0, int(i % 3 == 0)) for i in range(60)], "id long, x double, choice int")
    one = J.estimate_or_predict(data, spec, f"{tmp_path}/r.csv", ["a", "c"], "id")
    two = J.estimate_or_predict(data, spec, f"{tmp_path}/r.csv", ["a", "c"], "id")
    assert one.columns == ["id", "p_a", "p_c"] and sorted(one.collect()) == sorted(two.collect())
