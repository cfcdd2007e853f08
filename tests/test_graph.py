"""Trees, paths and corridors on small graphs whose answers are known or enumerated."""

import itertools
import random

import numpy as np
import pytest

from trellisway.functions.decay import Decay
from trellisway.operators import paths as P
from trellisway.operators.access import accessibility, detour_sweep, skim
from trellisway.operators.corridor import corridors
from trellisway.operators.network import crossing_attributes
from trellisway.operators import transit
from trellisway.operators.transit import connections, earliest_arrivals, leg_summary

TINY = [(1, 2, 100.0), (2, 3, 100.0), (1, 3, 250.0), (3, 1, 80.0), (3, 4, 50.0)]


def graph(spark, rows=TINY):
    return spark.createDataFrame(rows, "a long, b long, cost double")


def by_node(df, origin):
    return {r.node: r.cost for r in df.filter(f"origin = {origin}").collect()}


def test_trees(spark):
    links, origins = graph(spark), spark.createDataFrame([(1,), (4,), (9,)], "origin long")
    there = P.tree(links, origins)
    assert by_node(there, 1) == {1: 0, 2: 100, 3: 200, 4: 250}
    assert by_node(there, 4) == {4: 0}
    assert by_node(there, 9) == {9: 0}
    back = P.tree(links, origins, reverse=True)
    assert by_node(back, 1) == {1: 0, 2: 180, 3: 80}
    assert by_node(back, 4) == {4: 0, 3: 50, 2: 150, 1: 250}
    assert by_node(P.two_way_tree(links, origins), 1) == {1: 0, 2: 140, 3: 140}
    assert by_node(P.tree(links, origins, limit=150.0), 1) == {1: 0, 2: 100}


def random_links(seed, n=14, m=45):
    draw = random.Random(seed)
    return [(draw.randrange(n), draw.randrange(n), float(draw.randrange(1, 30))) for _ in range(m)]


def bellman_ford(rows, origin, n=14):
    best = {origin: 0.0}
    for _ in range(n):
        for a, b, c in rows:
            if a in best and best[a] + c < best.get(b, np.inf):
                best[b] = best[a] + c
    return best


def test_kernel_and_joins_agree_with_bellman_ford(spark):
    rows = random_links(1)
    links, origins = graph(spark, rows), spark.createDataFrame([(i,) for i in range(14)], "origin long")
    sent, joined = P.tree(links, origins).collect(), P.tree(links, origins, max_links=0).collect()
    want = {(o, n): c for o in range(14) for n, c in bellman_ford(rows, o).items()}
    assert {(r.origin, r.node): r.cost for r in sent} == want
    assert {(r.origin, r.node): r.cost for r in joined} == want


def test_paths_add_up(spark):
    rows = random_links(2)
    cheapest = {}
    for a, b, c in rows:
        cheapest[a, b] = min(c, cheapest.get((a, b), np.inf))
    pairs = spark.createDataFrame(list(itertools.product(range(14), repeat=2)), "origin long, target long")
    for r in P.paths(graph(spark, rows), pairs).collect():
        assert r.nodes[0] == r.origin and r.nodes[-1] == r.target
        assert r.cost == sum(cheapest[e] for e in zip(r.nodes, r.nodes[1:])) == bellman_ford(rows, r.origin)[r.target]


def test_corridor_by_enumeration(spark):
    """Links of a ladder; a long way round is out, parallel ways of nearly one length are in."""
    rows = [(1, 2, 10.0), (2, 3, 10.0), (1, 4, 11.0), (4, 3, 10.0), (1, 5, 30.0), (5, 3, 30.0), (3, 6, 10.0)]
    pairs = spark.createDataFrame([(1, 6), (6, 1), (2, 2), (None, 3)], "origin long, target long")
    found = {(r.a, r.b): round(r.detour, 6) for r in corridors(graph(spark, rows), pairs, 1.25).collect()}
    assert found == {(1, 2): 0.0, (2, 3): 0.0, (1, 4): 0.05, (4, 3): 0.05, (3, 6): 0.0}


def test_corridors_by_ellipses_are_the_same(spark):
    draw = random.Random(21)
    rows = {(draw.randrange(25), draw.randrange(25)): 1 + draw.random() for _ in range(110)}
    links = spark.createDataFrame([(a, b, c) for (a, b), c in rows.items() if a != b], "a long, b long, cost double")
    pairs = spark.createDataFrame([(draw.randrange(26), draw.randrange(26)) for _ in range(40)] + [(None, 3)], "origin long, target long")
    one, two = (sorted((*r[:4], round(r.detour, 9)) for r in corridors(links, pairs, 1.4, **kw).collect()) for kw in ({}, {"max_links": 0}))
    assert one == two and len(one) > 100


def test_corridor_looks_at_every_part(spark):
    """The whole way is 9 % longer, but one part of it is 50 % longer than the shortest between its ends."""
    rows = [(1, 2, 50.0), (2, 3, 10.0), (2, 4, 10.0), (4, 3, 5.0), (3, 5, 10.0)]
    pairs = spark.createDataFrame([(1, 5)], "origin long, target long")
    found = {(r.a, r.b) for r in corridors(graph(spark, rows), pairs, 1.25).collect()}
    assert found == {(1, 2), (2, 3), (3, 5)}


def test_timetable(spark):
    times = [(1, 1, 10, 0.0, 100.0), (1, 2, 11, 200.0, 210.0), (1, 3, 12, 300.0, 300.0), (2, 1, 11, 0.0, 205.0), (2, 2, 13, 250.0, 250.0), (3, 1, 11, 0.0, 190.0), (3, 2, 14, 220.0, 220.0)]
    hops = connections(spark.createDataFrame(times, "trip long, seq int, stop long, arrival double, departure double"))
    origins = spark.createDataFrame([(10, 50.0), (10, 150.0), (99, 0.0)], "origin long, departure double")
    found = {(r.departure, r.stop): r.arrival for r in earliest_arrivals(hops, origins).collect()}
    assert found == {(50.0, 10): 50.0, (50.0, 11): 200.0, (50.0, 12): 300.0, (50.0, 13): 250.0, (150.0, 10): 150.0}


@pytest.mark.parametrize("most", [40, 9])
def test_slices_of_a_timetable_hand_on_their_arrivals(spark, most):
    draw = random.Random(8)
    rows = [(draw.randrange(9), draw.randrange(9), float(t), float(t + draw.randrange(0, 900))) for t in (draw.randrange(0, 7200) for _ in range(150))]
    hops = spark.createDataFrame([r for r in rows if r[0] != r[1]], "u long, v long, dep double, arr double")
    origins = spark.createDataFrame([(o, d) for o in range(10) for d in (0.0, 3000.0)], "origin long, departure double")
    whole, cut = (sorted(earliest_arrivals(hops, origins, 6000.0, max_connections=n).collect()) for n in (10_000, most))
    assert whole == cut and len(whole) > 100
    with pytest.raises(ValueError, match="minute"):
        earliest_arrivals(hops, origins, max_connections=1)


def test_legs(spark):
    rows = [(1, 0, "walk", 60.0, 80.0, 0.0), (1, 1, "bus", 300.0, 2000.0, 120.0), (1, 2, "train", 600.0, 9000.0, 30.0), (1, 3, "walk", 50.0, 70.0, 0.0), (2, 0, "walk", 500.0, 600.0, 0.0)]
    legs = spark.createDataFrame(rows, "trip long, seq int, mode string, seconds double, metres double, wait double")
    one, two = leg_summary(legs).orderBy("trip").collect()
    assert (one.seconds, one.access_seconds, one.egress_seconds, one.changes, one.modes) == (1010.0, 60.0, 50.0, 1, "walk-bus-train-walk")
    assert (two.access_seconds, two.egress_metres, two.changes, two.modes) == (0.0, 0.0, 0, "walk")


def test_detour_sweep_by_paths(spark):
    draw = random.Random(3)
    rows = {(a, b): (float(draw.randrange(1, 30)), draw.random(), draw.random()) for a, b, _ in random_links(4) if a != b}
    links = spark.createDataFrame([(a, b, *v) for (a, b), v in rows.items()], "a long, b long, time double, x double, y double")
    settings = spark.createDataFrame([(0, [0.0, 0.0]), (1, [2.0, 0.5]), (2, [0.0, 5.0])], "setting long, weights array<double>")
    origins = spark.createDataFrame([(i,) for i in range(14)], "origin long")
    want = {}
    for setting, (wx, wy) in ((0, (0.0, 0.0)), (1, (2.0, 0.5)), (2, (0.0, 5.0))):
        for origin in range(14):
            best, fast = {origin: (0.0, 0.0)}, bellman_ford([(a, b, v[0]) for (a, b), v in rows.items()], origin)
            for _ in range(14):
                for (a, b), (t, x, y) in rows.items():
                    if a in best and best[a][0] + t * (1 + wx * x + wy * y) < best.get(b, (np.inf,))[0]:
                        best[b] = (best[a][0] + t * (1 + wx * x + wy * y), best[a][1] + t)
            for node, (_, time) in best.items():
                if node != origin:
                    cell = min(int((time / fast[node] - 1) * 100 + 1e-9), 499)
                    want[setting, cell] = want.get((setting, cell), 0) + 1
    found = detour_sweep(links, origins, settings, ["x", "y"]).collect()
    assert {(r.setting, r.bin): r.n for r in found} == want


def test_fused_accessibility_and_joins_agree(spark):
    draw = random.Random(6)
    links, origins = graph(spark, random_links(5)), spark.createDataFrame([(i,) for i in [*range(14), 77]], "origin long")
    places = spark.createDataFrame([(f"s{i % 3}", i, float(i % 4), draw.randrange(16)) for i in range(30) for _ in range(1 + i % 2)], "set string, id long, weight double, node long")
    for decay in (Decay("exponential", beta=0.1), Decay("cumulative", cut_dist=25.0), Decay("gaussian", v=300.0, cut_time=30.0), Decay("cumulative_gaussian", a=5.0, v=90.0)):
        one = {(r.origin, r.set): r.accessibility for r in accessibility(links, origins, places, decay).collect()}
        two = {(r.origin, r.set): r.accessibility for r in accessibility(links, origins, places, decay, max_points=0).collect()}
        assert one.keys() == two.keys() and len(one) == 45
        assert all(abs(v - two[k]) < 1e-9 for k, v in one.items())


def test_skim_of_graphs_sent_and_joined(spark, monkeypatch):
    links = graph(spark, random_links(7))
    zones = spark.createDataFrame([(i, i % 3) for i in range(14)] + [(50, 1)], "node long, zone int")
    sent = sorted(map(tuple, skim(links, zones).collect()))
    monkeypatch.setattr(P, "MAX_BROADCAST_LINKS", 0)
    assert sorted(map(tuple, skim(links, zones).collect())) == sent and len(sent) == 9


def test_paths_by_joins_agree(spark):
    links = graph(spark, random_links(8))
    pairs = spark.createDataFrame(list(itertools.product(range(14), repeat=2)), "origin long, target long")
    one, two = ({(r.origin, r.target): r.cost for r in P.paths(links, pairs, max_links=m).collect()} for m in (None, 0))
    assert one == two


def test_many_origins_in_one_block():
    draw = np.random.default_rng(9)
    a, b, w = draw.integers(0, 60, 400), draw.integers(0, 60, 400), draw.random(400) * 100
    g = P.Csr.of({"a": a, "b": b, "cost": w, "time": w * 2, "dist": w * 3}, False)
    found = g.trees([[(i, 0.0, 0.0, 0.0)] for i in range(len(g.nodes))])
    rows = list(zip(a.tolist(), b.tolist(), w.tolist()))
    for i, node in enumerate(g.nodes.tolist()):
        want = bellman_ford(rows, node, 60)
        got = dict(zip(g.nodes[np.isfinite(found.cost[i])].tolist(), found.cost[i][np.isfinite(found.cost[i])].tolist()))
        assert got.keys() == want.keys() and all(abs(got[n] - c) < 1e-9 for n, c in want.items())
        assert np.allclose(found.time[i], np.where(np.isfinite(found.cost[i]), found.cost[i] * 2, 0)) and np.allclose(found.dist[i] * 2, found.time[i] * 3)
        assert all(g.path(found.parent[i], int(k))[0] == node for k in np.flatnonzero(np.isfinite(found.cost[i])))


def test_crossings_against_pairs(spark):
    draw = random.Random(12)
    rows = [
        (f"l{i}", i // 2, draw.randrange(6), draw.randrange(4), draw.choice([-1, 1, 2, 3, None]), draw.choice([None, "", "a", "b", "c"]), draw.random() < 0.7,
         float(draw.randrange(9)), float(draw.randrange(4)), draw.choice([None, 100.0 * draw.randrange(9)]), draw.choice([20.0, 30.0, 40.0, 50.0, 60.0, None]))
        for i in range(160)
    ]
    names = "link_id string, edge_id long, a long, b long, osm_id int, name string, allows_car boolean, width double, lanes double, aadt_fwd double, limit_mph double"
    found = {r.link_id: r for r in crossing_attributes(spark.createDataFrame(rows, names)).collect()}
    edges = {}
    for r in rows:
        for n in r[2:4]:
            edges.setdefault(n, set()).add(r[1])
    for r in rows:
        met = [o for o in rows if len(edges[r[3]]) > 2 and o[3] == r[3] and o[6] and None not in (r[4], o[4]) and r[4] != o[4] and not (r[5] and r[5] == o[5])]
        got, speeds = found[r[0]], [o[10] for o in met if o[10] is not None]
        assert got.crosses == bool(met)
        assert (got.cross_width, got.cross_lanes, got.cross_aadt) == tuple(sum(o[k] or 0.0 for o in met) for k in (7, 8, 9))
        assert got.cross_speed == (max(speeds) if speeds else None)


def test_sweep_by_joins_is_the_same(spark):
    draw = random.Random(3)
    rows = [(draw.randrange(12), draw.randrange(12), float(draw.randrange(1, 90)), draw.randrange(1 << 16) / 65536, draw.randrange(1 << 16) / 65536) for _ in range(60)]
    links = spark.createDataFrame([r for r in {r[:2]: r for r in rows}.values() if r[0] != r[1]], "a long, b long, time double, green double, stress double")
    origins = spark.range(13).select("id").withColumnRenamed("id", "origin")
    settings = spark.createDataFrame([(0, [0.0, 0.0]), (1, [2.0, 0.5]), (2, [0.0, 5.0])], "setting long, weights array<double>")
    one, two = (sorted(detour_sweep(links, origins, settings, ["green", "stress"], **kw).collect()) for kw in ({}, {"max_links": 0}))
    assert one == two and len(one) > 5


def test_only_vehicles_that_can_be_met_are_sent(spark, monkeypatch):
    rows = [(p + a, p + (a + 1) % 5, 100.0 * k, 100.0 * k + 50) for k in range(20) for p in (0, 10) for a in range(5)]
    hops = spark.createDataFrame(rows, "u long, v long, dep double, arr double")
    origins = spark.createDataFrame([(3, 1000.0), (12, 1400.0), (99, 0.0 + 1000)], "origin long, departure double")
    sent, cut = [], transit._slices
    monkeypatch.setattr(transit, "_slices", lambda df, most: sent.append(df) or cut(df, most))
    found = {(r.origin, r.stop): r.arrival for r in earliest_arrivals(hops, origins, max_connections=60).collect()}
    assert found == {(3, (3 + i) % 5): 1000.0 + (100 * i - 50 if i else 0) for i in range(5)} | {(12, 10 + (2 + i) % 5): 1400.0 + (100 * i - 50 if i else 0) for i in range(5)}
    assert sent[0].count() == 100 and not sent[0].is_cached  # of 200, those from the first departure on
