"""Estimation whose routes follow the coefficients, against plain searches."""

import heapq
import math
import random

import numpy as np
import pytest

from trellisway.operators import choice as M

ATTRIBUTES = [M.StreetAttribute("green"), M.StreetAttribute("stress"), M.StreetAttribute("stress_old", "stress", "age > 60")]


def grid(seed, side=5):
    """Both ways of a grid, with a time and two attributes."""
    draw, links = random.Random(seed), []
    for i in range(side * side):
        for j in (i + 1, i + side):
            if j < side * side and (j != i + 1 or j % side):
                for a, b in ((i, j), (j, i)):
                    links.append((a, b, 60.0 * draw.randrange(2, 9), 100.0, draw.random(), draw.random()))
    return links


def search(links, weights, origin):
    """Minutes, green and stress minutes of the cheapest path to every node."""
    out, best, heap = {}, {origin: 0.0}, [(0.0, origin, (0.0, 0.0, 0.0))]
    by = {}
    for a, b, time, _, green, stress in links:
        by.setdefault(a, []).append((b, time, green, stress))
    while heap:
        cost, at, sums = heapq.heappop(heap)
        if at in out:
            continue
        out[at] = sums
        for b, time, green, stress in by.get(at, []):
            c = cost + time * (1 + weights[0] * green + weights[1] * stress)
            if c < best.get(b, math.inf):
                best[b] = c
                heapq.heappush(heap, (c, b, (sums[0] + time / 60, sums[1] + time * green / 60, sums[2] + time * stress / 60)))
    return out


def people(seed, n, links, truth, nodes=25):
    """Trips whose riders choose between the bicycle and staying by the utilities at the true coefficients."""
    draw, rows, trees = random.Random(seed), [], {}
    for i in range(n):
        o, d, age = draw.randrange(nodes), draw.randrange(nodes), draw.randrange(20, 90)
        weights = (truth["green"], truth["stress"] + (truth["stress_old"] if age > 60 else 0.0))
        if (weights, o) not in trees:
            trees[weights, o] = search(links, weights, o)
        tree = trees[weights, o]
        if d in tree and d != o:
            time, green, stress = tree[d]
            u = truth["asc"] + truth["b"] * (time + weights[0] * green + weights[1] * stress)
            p = 1 / (1 + math.exp(-u))
            rows.append((i, o, d, age, int(draw.random() >= p)))
    return rows


SPEC = M.Specification({
    "bike": [("asc", "1"), ("b", "bike_time"), ("c_green", "bike_green"), ("c_stress", "bike_stress"), ("c_old", "bike_stress_old")], "stay": [("none", "0")],
}, fixed={"none": 0.0})
NAMES = {"green": "c_green", "stress": "c_stress", "stress_old": "c_old"}


def tables(spark, rows, links):
    data = spark.createDataFrame([(i, age, choice) for i, _, _, age, choice in rows], "id long, age int, choice int")
    trips = spark.createDataFrame([r[:3] for r in rows], "id long, origin long, target long")
    return data, M.Routing(
        spark.createDataFrame(links, "a long, b long, time double, dist double, green double, stress double"), trips, ATTRIBUTES, NAMES, "b", "bike_time", "bike_",
    )


def test_paths_follow_the_coefficients(spark):
    links = grid(1) + [(90, 91, 60.0, 1.0, 0.0, 0.0)]
    rows = people(2, 60, grid(1), {"asc": 0.0, "b": -0.1, "green": 1.0, "stress": 0.5, "stress_old": 1.0})
    rows += [(900, 3, 90, 30, 1), (901, 4, 4, 70, 0)]  # no path; both ends at one node
    data, routing = tables(spark, rows, links)
    routes = M.Routes(routing, data)
    for values in ({"b": -0.2, "c_green": -0.4, "c_stress": 0.2, "c_old": -0.8}, {"b": -0.2, "c_green": -0.4, "c_stress": -0.2, "c_old": 0.6}):
        g = {a: values[c] / values["b"] for a, c in NAMES.items()}
        found = {r.id: r for r in routes.columns(data, values).collect()}
        assert len(found) == len(rows)
        for i, o, d, age, _ in rows:
            weights = max(0.0, g["green"]), max(0.0, g["stress"] + (g["stress_old"] if age > 60 else 0.0))
            want = search(links, weights, o).get(d)
            got = found[i]
            assert (got.bike_time is None) == (want is None)
            if want:
                assert np.allclose([got.bike_time, got.bike_green, got.bike_stress], want) and got.bike_stress_old == (got.bike_stress if age > 60 else 0.0)
    assert routes.searches == 4
    routes.at({"b": -0.4, "c_green": -0.8, "c_stress": 0.4, "c_old": -1.6})  # the same weights
    assert routes.searches == 4
    routes.at({"b": -0.4, "c_green": -0.8, "c_stress": 0.1, "c_old": -1.6})  # a negative weight counts as 0, so only the old look anew
    assert routes.searches == 5


def test_estimate_finds_the_truth(spark):
    truth = {"asc": 1.5, "b": -0.12, "green": 0.8, "stress": 1.2, "stress_old": 0.0}
    links = grid(3)
    rows = people(4, 3000, links, truth)
    data, routing = tables(spark, rows, links)
    spec = M.Specification(SPEC.utilities, fixed={"none": 0.0, "c_old": 0.0})
    found = M.estimate(data.coalesce(2), spec, {"asc": 0.5, "b": -0.05}, max_rounds=12, routings=[routing], tolerance=1e-5)
    values = {r[0]: r for r in found.rows}
    want = {"asc": truth["asc"], "b": truth["b"], "c_green": truth["b"] * truth["green"], "c_stress": truth["b"] * truth["stress"]}
    for name, v in want.items():
        assert abs(values[name][1] - v) < 4 * values[name][2], (name, values[name], v)
    at_truth, _ = M.likelihood(M.routed(data, [M.Routes(routing, data)], {**want, "c_old": 0.0, "none": 0.0}), spec, np.array([want[n] for n in spec.coefficients()]))
    assert -found.final <= at_truth + 0.5 and found.final > found.at_zero


@pytest.mark.parametrize("dist", [True, False])
def test_short_trips(spark, dist):
    rows = [(1, 0.0, 0.0, 30.0, 40.0, 100.0, 7, 7, 1, 1), (2, 0.0, 0.0, 1.0, 0.0, None, 7, 8, 1, 2), (3, 0.0, 0.0, 900.0, 0.0, 5000.0, 9, 9, 5, 5), (4, 0.0, 0.0, 1.0, 1.0, 50.0, 8, 8, None, None)]
    trips = spark.createDataFrame(rows, "id long, ox double, oy double, dx double, dy double, dist double, origin_link long, target_link long, origin_zone long, target_zone long")
    trips = trips if dist else trips.drop("dist")
    links = spark.createDataFrame([(7, 100.0, 0.5), (8, 50.0, 0.2), (9, 20.0, 1.0), (6, 300.0, 0.1)], "link long, length double, green double")
    zone_links = spark.createDataFrame([(1, 6), (1, 7)], "zone long, link long")
    reference = M.short_trip_links(trips, zone_links)
    found = {r.id: (r.time, r.green) for r in M.short_trips(trips, reference, links, ["green"], "walk").collect()}
    around = {1: [(300.0, 0.1), (100.0, 0.5)], 2: [(100.0, 0.5), (50.0, 0.2)], 3: [(20.0, 1.0)], 4: [(50.0, 0.2)]}
    for r in rows:
        total = sum(x[0] for x in around[r[0]])
        length = r[5] if dist and r[5] is not None else 1.2 * math.hypot(r[3] - r[1], r[4] - r[2])
        minutes = min(max(length, 10.0), total) / 1.38 / 60
        assert np.allclose(found[r[0]], (minutes, sum(a * b for a, b in around[r[0]]) * minutes / total))
