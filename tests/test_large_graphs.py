"""Graphs beyond what is sent whole: only links that a cheapest path can take, and trees that are larger than Spark takes them for."""

import random

import pytest

from trellisway.functions.decay import Decay
from trellisway.operators import access as A
from trellisway.operators import paths as P
from trellisway.operators.corridor import corridors
from trellisway.plans.path_queries import graph
from trellisway.sources import sinks, tables


@pytest.fixture(scope="module")
def links(spark):
    """Two dense parts of 30 nodes with a node that only a dear link reaches, and many equal costs."""
    draw = random.Random(5)
    rows = [(p + a, p + b, float(draw.randint(1, 60))) for p in (0, 100) for a in range(30) for b in range(30) if a != b]
    return spark.createDataFrame([*rows, (3, 50, 900.0), (50, 4, 700.0)], "a long, b long, cost double").checkpoint()


@pytest.fixture(scope="module")
def origins(links):
    return links.selectExpr("a AS origin").distinct()


def test_dominated_links_are_not_sent(links, origins, monkeypatch):
    want = sorted(P.tree(links, origins).select("origin", "node", "cost").collect())
    monkeypatch.setattr(P, "WHOLE_LINKS", 0)
    graph = P.send(P._links(links), max_links=1000)
    assert graph is not None and len(graph.cost) < 1000 < links.count()
    assert sorted(P.tree(links, origins, max_links=1000).select("origin", "node", "cost").collect()) == want
    assert sorted(P.tree_by_joins(P._links(links), origins.selectExpr("origin", "array(struct(origin AS node, 0D AS cost, 0D AS time, 0D AS dist)) AS seeds")).select("origin", "node", "cost").collect()) == want


def test_links_are_shuffled_once_on_their_way_to_the_tasks(spark, sf_dir):
    cut = P.undominated(P._links(graph(spark, sf_dir)), 1_000_000, 100)
    assert cut._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 2  # by order, by first node


def test_ways_into_nodes_cut_what_ways_out_of_nodes_leave(links, origins, monkeypatch):
    want = sorted(P.tree(links, origins).select("origin", "node", "cost").collect())
    cut, ends = P.undominated, []
    monkeypatch.setattr(P, "WHOLE_LINKS", 0)
    monkeypatch.setattr(P, "undominated", lambda *args, **kw: ends.append(kw["end"]) or cut(*args, near=2, **kw))
    assert sorted(P.tree(links, origins, max_links=1000).select("origin", "node", "cost").collect()) == want
    assert ends == ["a", "b"]


def test_corridors_keep_links_within_the_limit(spark, links, monkeypatch):
    pairs = spark.createDataFrame([(a, b) for a in (0, 7, 104) for b in (3, 50, 111, 29)], "origin long, target long")
    want = sorted(corridors(links, pairs, 1.4).collect())
    monkeypatch.setattr(P, "WHOLE_LINKS", 0)
    assert sorted(corridors(links, pairs, 1.4, max_links=1200).collect()) == want and want


def test_trees_are_not_broadcast(links, origins):
    nodes = origins.selectExpr("origin AS node", "origin * 2 AS x")
    plan = P.tree(links, origins).filter("cost > 0").join(nodes, "node")._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan


@pytest.mark.parametrize("points", [A.MAX_BROADCAST_POINTS, 0])
def test_places_at_the_origin_can_be_left_out(spark, links, origins, points):
    places = spark.createDataFrame([("x", i, n, 1.0 + i) for i, ns in enumerate([(0, 5), (104, 7), (50,), (3,)]) for n in ns], "set string, id long, node long, weight double")
    found = A.accessibility(links, origins, places, Decay("power", a=1.0, cut_dist=800.0), points, away=True)
    tree = {(r.origin, r.node): r.cost for r in P.tree(links, origins).collect()}
    for r in found.collect():
        want = 0.0
        for i, ns in enumerate([(0, 5), (104, 7), (50,), (3,)]):
            costs = [tree[r.origin, n] for n in ns if 0 < tree.get((r.origin, n), 0) <= 800]
            want += (1.0 + i) / min(costs) if costs else 0.0
        assert r.accessibility == pytest.approx(want)


def test_few_draws_are_searched_over_their_own_links(spark, links, origins, monkeypatch):
    own = links.selectExpr("a", "b", "cost AS time", "cost AS dist", "cast(a % 3 as double) AS green")
    pairs = origins.selectExpr("origin", "(origin + 7) % 30 AS target")
    draws = spark.createDataFrame([(0, [0.0]), (1, [0.5])], "draw long, weights array<double>")
    ask = lambda: {(r.draw, r.origin, r.target): r.cost for r in P.sampled_paths(own, pairs, draws, ["green"]).collect()}
    want, sent = ask(), []
    monkeypatch.setattr(P, "WHOLE_LINKS", 0)
    send = P.send
    monkeypatch.setattr(P, "send", lambda *args, **kw: sent.append(send(*args, **kw)) or sent[-1])
    assert ask() == want
    assert len(sent) == 2 and all(len(g.cost) < 1000 for g in sent)


def test_xml_files_hold_a_bounded_number_of_elements(spark, tmp_path):
    nodes = spark.range(25, numPartitions=1).selectExpr("cast(id as string) AS node", "cast(id as double) AS x", "0D AS y")
    links = spark.range(25, numPartitions=1).selectExpr(
        "concat('l', id) AS link_id", "cast(id as string) AS a", "'0' AS b", "1D AS length", "1D AS freespeed", "1D AS capacity", "1D AS lanes", "array('walk') AS modes", "map('k', 'v') AS attributes",
    )
    sinks.write_network_xml(nodes, links, str(tmp_path / "net"), rows_per_file=10)
    assert all(len(list((tmp_path / "net" / part).glob("part-*"))) == 3 for part in ("nodes", "links"))
    n, found = tables.read_network(spark, str(tmp_path / "net"))
    assert n.count() == 25 and sorted(r.link_id for r in found.collect()) == sorted(f"l{i}" for i in range(25))


def test_volumes_of_paths_shuffle_no_single_steps(spark, links, origins):
    trips = origins.selectExpr("origin", "explode(array((origin + 7) % 30, (origin + 7) % 30, 104)) AS target")
    found = P.paths(links, trips)
    assert sorted(A.path_volumes(found, trips).collect()) == sorted(A.link_volumes(P.path_links(found), trips).collect())
    plan = A.path_volumes(found, trips)._jdf.queryExecution().executedPlan().toString()
    assert plan.index("partial_sum") < plan.index("Generate") < plan.index("Join")  # from the sums down to the join
