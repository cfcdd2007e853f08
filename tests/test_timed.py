"""Least-time paths over congested links against a plain search."""

import heapq
import math
import random

import pytest

from trellisway.operators.network import congested_times
from trellisway.operators.timed import profiles, timed_paths


def network(seed, n=30):
    draw = random.Random(seed)
    links = {(draw.randrange(n), draw.randrange(n)): (20.0 * draw.randrange(1, 30), 100.0 * draw.randrange(1, 9)) for _ in range(4 * n)}
    links = {k: v for k, v in links.items() if k[0] != k[1]}
    times = {(a, b, draw.randrange(10)): 30.0 * draw.randrange(1, 60) for a, b in draw.sample(sorted(links), len(links) // 2) for _ in range(3)}
    return links, times


def leave(links, times, a, b, t, size, bins):
    """When one leaves who enters at t, by looking at every later bin."""
    free = links[a, b][0]
    if not any((a, b) == k[:2] for k in times) or t >= size * bins:
        return t + free
    at = int(t // size)
    later = [k * size + times.get((a, b, k), free) for k in range(at + 1, bins)] + [bins * size + free]
    return min(t + times.get((a, b, at), free), *later)


def search(links, times, origin, start, size, bins):
    best, heap, done = {origin: start}, [(start, origin)], set()
    while heap:
        t, at = heapq.heappop(heap)
        if at in done:
            continue
        done.add(at)
        for a, b in links:
            if a == at and (x := leave(links, times, a, b, t, size, bins)) < best.get(b, math.inf):
                best[b] = x
                heapq.heappush(heap, (x, b))
    return best


@pytest.mark.parametrize("limits", [{}, {"max_links": 0}, {"max_times": 0}])
def test_against_search(spark, limits):
    links, times = network(7)
    frame, draw = spark.createDataFrame, random.Random(1)
    requests = [(draw.randrange(30), draw.randrange(30), 100.0 * draw.randrange(40)) for _ in range(60)] + [(3, 3, 50.0), (3, 999, 1.0), (999, 3, 1.0), (None, 3, 1.0), (3, 4, None)]
    found = timed_paths(
        frame([(a, b, *v) for (a, b), v in links.items()], "a long, b long, time double, dist double"), frame([(*k, v) for k, v in times.items()], "a long, b long, bin long, time double"),
        frame(requests + requests[:5], "origin long, target long, departure double"), 300.0, 10, **limits,
    ).collect()
    got = {(r.origin, r.target, r.departure): r for r in found}
    assert len(got) == len(found)
    for o, d, start in set(requests):
        want = search(links, times, o, start, 300.0, 10).get(d) if o is not None and start is not None else None
        r = got.get((o, d, start))
        assert (r is None) == (want is None)
        if r:
            assert r.arrival == want and r.nodes[0] == o and r.nodes[-1] == d
            t = start
            for a, b in zip(r.nodes, r.nodes[1:]):
                t = leave(links, times, a, b, t, 300.0, 10)
            assert t == r.arrival and r.dist == sum(links[k][1] for k in zip(r.nodes, r.nodes[1:]))


def test_first_in_first_out(spark):
    links = spark.createDataFrame([(1, 2, 100.0)], "a long, b long, time double")
    times = spark.createDataFrame([(1, 2, 0, 900.0), (1, 2, 1, 50.0)], "a long, b long, bin long, time double")
    rows = {r.bin: (r.tau, r.later) for r in profiles(links, times, 300.0, 3).collect()}
    assert rows == {0: (900.0, 350.0), 1: (50.0, 700.0), 2: (100.0, 1000.0)}


def test_times_of_events_route_trips(spark):
    events = [("v", "1", 0.0, "enter"), ("v", "1", 500.0, "leave"), ("w", "1", 100.0, "enter"), ("w", "1", 400.0, "leave"), ("x", "2", 5.0, "enter")]
    times = congested_times(spark.createDataFrame(events, "vehicle string, link string, time double, kind string"), 300)
    assert [tuple(r) for r in times.collect()] == [("1", 0, 400.0, 2)]
    ends = spark.createDataFrame([("1", 1, 2)], "link string, a long, b long")
    links = spark.createDataFrame([(1, 2, 100.0), (1, 3, 150.0), (3, 2, 60.0)], "a long, b long, time double")
    requests = spark.createDataFrame([(1, 2, 0.0), (1, 2, 600.0)], "origin long, target long, departure double")
    found = timed_paths(links, times.join(ends, "link"), requests, 300.0, 4).collect()
    assert {(r.departure, r.arrival, tuple(r.nodes)) for r in found} == {(0.0, 210.0, (1, 3, 2)), (600.0, 700.0, (1, 2))}
