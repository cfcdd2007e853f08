"""Queries over more lines than the cores take at once, and links that run along the sides of zones."""

import duckdb
import pytest
from pyspark.sql import functions as F

from tests.test_oracle import TABLES, plain
from trellisway.operators import access as A
from trellisway.operators import choice as M
from trellisway.operators import network as N
from trellisway.plans import demand_queries as Q
from trellisway.plans import derived as D
from trellisway.plans.catalogue import ORACLE_SQL, QUERIES
from trellisway.sources import sinks as K


def agree(spark, folder, name, tables=TABLES):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for table in tables:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{folder}/{table}.parquet{'' if tables is TABLES else '/*.parquet'}')")
    found = QUERIES[name](spark, str(folder))
    columns = sorted(found.columns)
    cursor = con.execute(ORACLE_SQL[name])
    names = [d[0] for d in cursor.description]
    want = sorted(tuple(plain(r[names.index(c)]) for c in columns) for r in cursor.fetchall())
    assert sorted(tuple(plain(r[c]) for c in columns) for r in found.collect()) == want
    return want


def test_links_along_sides_of_zones(spark, tmp_path):
    at = lambda step, size, where: next(k for k in range(1, size + 1) if (k * step) % size == where)
    a, c, low = at(7919, 10007, 2002), at(104729, 10009, 4004), at(7919, 10007, 0)
    pairs = [(a, a + 10007), (a + 3 * 10007, a + 10007), (c, c + 10009), (c + 20018, c), (low, low + 10007), (a, c), (5, 5 + 10007), (7, 7 + 10009)]
    keys = sorted({k for p in pairs for k in p})
    spark.createDataFrame([(k, 1.0, 1) for k in keys], "s_suppkey long, s_acctbal double, s_nationkey long").write.parquet(f"{tmp_path}/supplier.parquet")
    lines = [(o, k, k, i, 1.0, 1.0, 0.0) for o, p in enumerate(pairs) for i, k in enumerate(p)]
    names = "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double"
    spark.createDataFrame(lines, names).write.parquet(f"{tmp_path}/lineitem.parquet")
    assert len(agree(spark, tmp_path, "links_in_zones", ["supplier", "lineitem"])) > 8


def test_lines_are_dealt_over_more_tasks(spark, sf_dir, monkeypatch):
    assert D.tasks(spark, sf_dir) is None
    monkeypatch.setattr(D, "LINES_PER_TASK", 400)
    n = D.tasks(spark, sf_dir)
    assert n > spark.sparkContext.defaultParallelism
    links = D.full_links(spark, sf_dir)
    sizes = [r["count"] for r in links.groupBy(F.spark_partition_id()).count().collect()]
    assert links.rdd.getNumPartitions() == n and max(sizes) <= 4 * 400


@pytest.mark.parametrize("name", ["links_in_zones", "links_in_areas", "junction_nodes", "crossing_attributes", "composite_cost_v3", "trip_table", "links_per_zone", "route_overlap", "disconnected_links"])
def test_same_rows_over_more_tasks(spark, sf_dir, monkeypatch, name):
    monkeypatch.setattr(D, "LINES_PER_TASK", 400)
    agree(spark, sf_dir, name)


def test_disconnected_links_stay_as_they_are(spark):
    """Links are marked by their ends: those with an equal id are neither joined with each other nor doubled."""
    rows = [("x", 1, 2, ["car", "walk"]), ("x", 2, 1, ["car", "walk"]), ("y", 2, 3, ["car", "truck", "walk"]), ("z", 3, 1, ["walk"])]
    links = spark.createDataFrame(rows, "link_id string, a long, b long, modes array<string>")
    found = sorted((r.link_id, r.a, r.b, r.modes, r.disconnected_car) for r in N.mark_disconnected(links, "car").collect())
    assert found == [("x", 1, 2, ["car", "walk"], False), ("x", 2, 1, ["car", "walk"], False), ("y", 2, 3, ["walk"], True), ("z", 3, 1, ["walk"], False)]


def test_overlap_deals_trips_only(spark):
    lists = "trip long, links array<long>"
    new, old = spark.createDataFrame([(1, [1, 2, 3]), (2, [1]), (4, [])], lists), spark.createDataFrame([(1, [2, 3, 4]), (3, [2])], lists)
    times = spark.createDataFrame([(k, float(k)) for k in range(1, 5)], "link long, time double")
    found = A.overlap(new, old, times)
    assert sorted((r.trip, r.detour, r.overlap) for r in found.collect()) == [(1, 6 / 9, 5 / 9), (2, None, None), (3, 0.0, 0.0)]
    assert "hashpartitioning(trip" in (plan := found._jdf.queryExecution().toString()) and "link#" not in "".join(p.split(")")[0] for p in plan.split("hashpartitioning(")[1:])


def test_estimation_over_blocks(spark, sf_dir):
    """Blocks give the sums of the rows, and are dealt over all tasks though the table is one file."""
    spec = Q.SPEC
    data = Q.choices(spark, sf_dir).withColumn("cust", F.when((F.col("id") % 11 == 0) & F.col("choice").isin(0, 1, 2), None).otherwise(F.col("cust")))
    blocks = M.packed(data.repartition(40), spec)
    points = [Q._beta(), Q._beta() * 0, Q._beta() * 900]
    for (f, g), (want, slope) in zip(M.evaluated(blocks, spec, points), M.likelihoods(data, spec, points), strict=True):
        assert f == pytest.approx(want, rel=1e-12) and g == pytest.approx(slope, rel=1e-9, abs=1e-7)
    held = blocks.mapPartitions(lambda part: [sum(len(choice) for *_, choice in part)]).collect()
    assert blocks.getNumPartitions() >= spark.sparkContext.defaultParallelism and sum(held) == data.count() and sum(n > 0 for n in held) > 4
    blocks.unpersist()
    with pytest.raises(Exception, match="none of the alternatives"):
        M.evaluated(M.packed(data.withColumn("choice", F.lit(5)), spec), spec, points[:1])


def test_links_per_zone_derives_links_once(spark, sf_dir, monkeypatch):
    made, derive, append, plans = [], D.links, K.append_samples, []
    monkeypatch.setattr(D, "links", lambda *args: (made.append(args), derive(*args))[1])
    monkeypatch.setattr(K, "append_samples", lambda rows, path: (plans.append(rows._jdf.queryExecution().optimizedPlan().toString()), append(rows, path))[1])
    agree(spark, sf_dir, "links_per_zone")
    assert len(made) == 1 and len(plans) == 2 and all(p.count("InMemoryRelation") == 1 for p in plans)
