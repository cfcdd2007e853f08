"""Searches are spread over all tasks, and a block's labels are those of its origins' connected parts."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from trellisway.operators import access as A
from trellisway.operators import paths as P
from trellisway.operators import spatial as S
from trellisway.operators import transit as T


@pytest.fixture(scope="module")
def links(spark):
    """Forty rings of five nodes, each with a short cut."""
    rows = [(10 * p + i, 10 * p + (i + k) % 5, float(1 + (i * k) % 3)) for p in range(40) for i in range(5) for k in (1, 2)]
    return spark.createDataFrame(rows, "a long, b long, cost double").checkpoint()


@pytest.mark.parametrize("search", [
    lambda links, origins: P.tree(links, origins), lambda links, origins: P.two_way_tree(links, origins),
    lambda links, origins: P.paths(links, origins.withColumn("target", F.col("origin") + 1)),
])
def test_origins_are_spread_over_the_tasks(spark, links, search):
    """Distinct origins stand dealt by themselves over as many partitions, which Spark would join to one."""
    kept = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", spark.sparkContext.defaultParallelism)
    try:
        found = search(links, links.selectExpr("a AS origin").distinct())
        assert len(found.select(F.spark_partition_id().alias("p")).distinct().collect()) > 1
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", kept)


def test_labels_of_connected_parts_only(links):
    graph = P.send(P._links(links))
    found = graph.search([[(p, 0.0, 0.0, 0.0)] for p in range(0, 200, 5)])
    assert len(found.cost) == 200 == len(np.unique(found.node)) and graph.blocks() == P.LABELS // 5
    whole = graph.trees([[(p, 0.0, 0.0, 0.0)] for p in range(0, 200, 5)])
    assert np.isfinite(whole.cost).sum() == 200 and np.array_equal(whole.cost[np.isfinite(whole.cost)], found.cost)
    nodes = graph.nodes[found.way(found.base[3] + 4)].tolist()
    assert nodes == graph.path(whole.parent[3], 15 + 4) and nodes[0] == 30 and nodes[-1] == 34


def test_skim_counts_a_node_in_each_of_its_zones(spark, links):
    zones = spark.createDataFrame([(0, 1), (1, 1), (1, 2), (3, 2), (4, None), (77, 3)], "node long, zone long")
    found = {(r.o, r.d): r.value for r in A.skim(links, zones).collect() if r.o is not None and r.d is not None}
    cost = {(r.origin, r.node): r.cost for r in P.tree(links, zones.select(F.col("node").alias("origin")).distinct()).collect()}
    own = {1: [0, 1], 2: [1, 3], 3: [77]}
    for (o, d), value in found.items():
        costs = [cost.get((a, b), float("inf")) for a in own[o] for b in own[d]]
        assert value == pytest.approx(sum(costs) / len(costs))
    assert len(found) == 9


def test_arrivals_by_parts_and_by_slices(spark, monkeypatch):
    """Parts of the network are scanned by themselves, in one or more blocks of origins, with the rows that slices of time give, and nothing is written between."""
    rows = [(10 * p + i, 10 * p + (i + 1 + (i * t) % 3) % 6, 60.0 * t, 60.0 * t + 30.0 * (i + 1)) for p in range(7) for i in range(6) for t in range(0, 90, 7)]
    hops = spark.createDataFrame([r for r in rows if r[0] != r[1]], "u long, v long, dep double, arr double")
    starts = spark.createDataFrame([(10 * p + i, d) for p in range(8) for i in range(7) for d in (0.0, 1500.0, 9000.0)], "origin long, departure double")
    want = sorted(T.earliest_arrivals(hops, starts, 4000.0, max_connections=90).collect())
    monkeypatch.setattr(type(hops), "checkpoint", lambda self, *args: pytest.fail("state was written"))
    for cells in (T.SCAN_CELLS, 50):
        monkeypatch.setattr(T, "SCAN_CELLS", cells)
        assert sorted(T.earliest_arrivals(hops, starts, 4000.0).collect()) == want
    assert len(want) > 300
    monkeypatch.undo()
    monkeypatch.setattr(T, "SCAN_CELLS", 1)  # too large, so by slices
    assert sorted(T.earliest_arrivals(hops, starts, 4000.0).collect()) == want


def test_nearest_links_meet_few_points(spark):
    """Links are listed under the cells that they cross and are not shuffled on their way to the points; far points take wider cells."""
    draw = random.Random(4)
    at = lambda: float(draw.randint(0, 400)) / 4
    lines = [(i, at(), at(), at(), at()) for i in range(60)] + [(60, 7.0, 7.0, 7.0, 7.0), (61, 0.0, 0.0, 100.0, 0.0), (62, 0.0, 0.0, 100.0, 0.0)]
    spots = [(i, at(), at()) for i in range(80)] + [(80, 50.0, -0.25), (81, 900.0, 40.0), (82, None, 3.0)]
    links, points = spark.createDataFrame(lines, "link long, ax double, ay double, bx double, by double"), spark.createDataFrame(spots, "point long, x double, y double")
    found = {r.point: (r.best, r.distance) for r in S.nearest_link(points, links, 8.0).collect()}
    assert found.keys() == set(range(82)) and found[80] == (61, 0.25)
    for p, x, y in spots[:-1]:
        def away(line):
            _, ax, ay, bx, by = line
            n = (bx - ax) ** 2 + (by - ay) ** 2
            t = min(1.0, max(0.0, ((x - ax) * (bx - ax) + (y - ay) * (by - ay)) / n)) if n else 0.0
            return ((x - ax - t * (bx - ax)) ** 2 + (y - ay - t * (by - ay)) ** 2) ** 0.5
        assert found[p][1] == pytest.approx(min(map(away, lines)))
    seen = []
    crossed, cells = S._crossed, S._cells
    try:
        S._cells = lambda *args: seen.append(str(args[0])) or cells(*args)
        S._crossed = lambda *args: seen.append("crossed") or crossed(*args)
        S.nearest_link(points, links, 8.0)
    finally:
        S._crossed, S._cells = crossed, cells
    assert "crossed" in seen and not any("ax" in c for c in seen)
    assert S.nearest_link(points, links.limit(0), 8.0).count() == 0
