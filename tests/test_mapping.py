"""Stops mapped to roads against all combinations of candidate links."""

import heapq
import itertools
import math
import random

import pytest

from trellisway.operators.demand import gated_plans
from trellisway.operators.mapping import MappingParams, candidate_links, map_routes, patterns, route_links


def town(seed, side=4):
    """A grid whose streets run one way or both, and a street apart that nothing leads to."""
    draw, at, links = random.Random(seed), {}, []
    for i in range(side * side):
        at[i] = (100.0 * (i % side), 100.0 * (i // side))
    for i in range(side * side):
        for j in (i + 1, i + side):
            if j < side * side and (j != i + 1 or j % side):
                for a, b in ((i, j), (j, i)):
                    if draw.random() < 0.8:
                        links.append((a, b))
    at[90], at[91] = (900.0, 0.0), (1000.0, 0.0)
    links.append((90, 91))
    return [(k, a, b, math.dist(at[a], at[b]) * (1 + k % 3), *at[a], *at[b]) for k, (a, b) in enumerate(links)]


def distance(x, y, ax, ay, bx, by):
    t = max(0.0, min(1.0, ((x - ax) * (bx - ax) + (y - ay) * (by - ay)) / ((bx - ax) ** 2 + (by - ay) ** 2)))
    return math.sqrt((x - ax - t * (bx - ax)) ** 2 + (y - ay - t * (by - ay)) ** 2)


def ways(links, origin):
    best, heap = {origin: 0.0}, [(0.0, origin)]
    while heap:
        c, at = heapq.heappop(heap)
        for _, a, b, length, *_ in links:
            if a == at and c + length < best.get(b, math.inf):
                best[b] = c + length
                heapq.heappush(heap, (c + length, b))
    return best


@pytest.mark.parametrize("seed", range(2))
def test_against_all_combinations(spark, seed):
    p, draw, links = MappingParams(reach=60.0, links=3, off=3.0, lost=4.0), random.Random(seed + 50), town(seed)
    stops = [(i, draw.uniform(-20, 320), draw.uniform(-20, 320)) for i in range(9)] + [(20, 950.0, 5.0), (21, 600.0, 300.0), (22, None, 1.0)]
    routes = [[0, 1, 2, 3], [4, 5], [6, 7, 8, 0, 4], [2, 20, 5], [1, 21, 3], [3], [1, 22, 2], [5, 5, 6]]
    rows = [(r, k + 1, s) for r, own in enumerate(routes) for k, s in enumerate(own)]
    frame = spark.createDataFrame
    link_frame = frame(links, "link long, a long, b long, length double, ax double, ay double, bx double, by double")
    stop_frame = frame(stops, "stop long, x double, y double")
    at = {s: (x, y) for s, x, y in stops}
    wanted = {}
    for s, x, y in stops[:-1]:
        own = sorted((distance(x, y, *k[4:]), k[0]) for k in links)
        wanted[s] = [o for o in own if o[0] <= p.reach][: p.links] or own[:1]
    found = {}
    for r in candidate_links(stop_frame, link_frame, p).collect():
        found.setdefault(r.stop, set()).add(r.link)
    assert found == {s: {k for _, k in own} for s, own in wanted.items()}
    mapped = map_routes(frame(rows, "route long, seq long, stop long"), stop_frame, link_frame, p).checkpoint()
    got = {}
    for r in mapped.orderBy("route", "seq").collect():
        got.setdefault(r.route, []).append(r)
    trees = {n: ways(links, n) for n in {k[2] for k in links}}

    def cost(own, chosen):
        total = 0.0
        for k, (s, link) in enumerate(zip(own, chosen)):
            total += p.off * dict((b, a) for a, b in wanted[s])[link]
            if k and chosen[k - 1] != link:
                way = trees[links[chosen[k - 1]][2]].get(links[link][1])
                total += p.lost * math.dist(at[own[k - 1]], at[s]) if way is None else way + links[link][3]
        return total

    assert set(got) == set(range(8)) - {6}
    for r, own in enumerate(routes):
        if r != 6:
            least = min(cost(own, c) for c in itertools.product(*([k for _, k in wanted[s]] for s in own)))
            assert [x.stop for x in got[r]] == own and abs(got[r][0].total - least) < 1e-6
            assert abs(cost(own, [x.link for x in got[r]]) - least) < 1e-6
    passed = {}
    for r in route_links(mapped, link_frame).orderBy("route", "hop", "place").collect():
        passed.setdefault((r.route, r.hop), []).append(r)
    streets = {(a, b) for _, a, b, *_ in links}
    for r, own in got.items():
        for one, two in zip(own, own[1:]):
            if one.link == two.link:
                assert (r, one.seq) not in passed
                continue
            steps = passed[r, one.seq]
            assert steps[0].a == links[one.link][2] and (steps[-1].a, steps[-1].b) == tuple(links[two.link][1:3])
            assert all(x.b == y.a for x, y in zip(steps, steps[1:])) and all(s.made or (s.a, s.b) in streets for s in steps)
            assert any(s.made for s in steps) == (links[two.link][1] not in trees[links[one.link][2]])


def test_patterns(spark):
    calls = [(7, 1, 5), (7, 3, 6), (2, 10, 5), (2, 20, 6), (3, 1, 6), (3, 2, 5), (4, 1, 5)]
    named, routes = patterns(spark.createDataFrame(calls, "vehicle long, seq long, stop long"))
    assert {tuple(r) for r in named.collect()} == {(7, 2), (2, 2), (3, 3), (4, 4)}
    assert {tuple(r) for r in routes.collect()} == {(2, 1, 5), (2, 2, 6), (3, 1, 6), (3, 2, 5), (4, 1, 5)}


def test_gates(spark):
    inside = lambda x, y: (x >= 0) & (x <= 100)
    links = [  # two streets inside, one in, one out
        (1, 1, 2, 40.0, 10.0, 0.0, 50.0, 0.0, True, False, False), (2, 2, 3, 60.0, 50.0, 0.0, 90.0, 0.0, True, False, False),
        (3, 0, 1, 20.0, -50.0, 0.0, 10.0, 0.0, False, True, False), (4, 3, 9, 30.0, 90.0, 0.0, 150.0, 0.0, False, False, True),
        (5, 50, 51, 1.0, 40.0, 80.0, 60.0, 80.0, True, False, False),
    ]
    frame = spark.createDataFrame
    link_frame = frame(links, "link long, a long, b long, time double, ax double, ay double, bx double, by double, internal boolean, entry boolean, exit boolean")
    trips = [(1, 1000.0, 20.0, 5.0, 80.0, -5.0), (2, 30.0, -90.0, 3.0, 170.0, 3.0), (3, 1000.0, 80.0, 1.0, 20.0, 1.0), (4, 1000.0, 20.0, 5.0, -70.0, 0.0), (5, 1000.0, None, 5.0, 20.0, 1.0), (6, 1000.0, 50.0, 80.0, 20.0, 5.0)]
    found = gated_plans(frame(trips, "id long, seconds double, ox double, oy double, dx double, dy double"), link_frame, inside, 30.0)
    assert {r.id: (r.origin_link, r.target_link, r.start) for r in found.collect()} == {
        1: (1, 2, 950.0), 2: (3, 4, 86_355.0), 3: (2, 1, 1000.0), 4: (1, 4, 935.0), 5: (None, 1, None), 6: (5, 1, None),
    }
    none = gated_plans(frame(trips[:1], "id long, seconds double, ox double, oy double, dx double, dy double"), link_frame.filter("not internal"), inside, 30.0).first()
    assert (none.origin_link, none.start) == (None, None)
