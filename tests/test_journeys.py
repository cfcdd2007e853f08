"""Journeys by rounds against all journeys of a small feed."""

import random

import pytest

from trellisway.operators.journeys import JourneyParams, journey_attributes, journey_skim, journeys
from trellisway.operators.transit import leg_summary


def feed(seed):
    draw = random.Random(seed)
    calls = []
    for vehicle in range(26):
        at = draw.randrange(27_000, 32_000)
        for seq, stop in enumerate(draw.sample(range(9), draw.randrange(2, 6))):
            calls.append((vehicle, seq, stop, float(at), float(at + 10 * draw.randrange(3)), "bus" if vehicle % 3 else "rail", 1000.0 * seq))
            at += 100 * draw.randrange(1, 8)
    walks = [(u, v, 60.0 * draw.randrange(1, 9), 80.0) for u in range(9) for v in range(9) if u != v and draw.random() < 0.15]
    requests = [(t, 28_000.0 + 100 * draw.randrange(30)) for t in range(12)] + [(50, 200.0), (51, 86_300.0), (52, None)]
    access = [(t, s, 60.0 * draw.randrange(0, 6), 10.0) for t, _ in requests for s in draw.sample(range(9), 2)]
    egress = [(t, s, 60.0 * draw.randrange(0, 6), 20.0) for t, _ in requests for s in draw.sample(range(9), 2)]
    direct = [(t, 3000.0 + 100 * t, 4000.0) for t in (0, 3, 5, 51)]
    return calls, requests, access, egress, walks, direct


def best_of(trip, wish, calls, access, egress, walks, direct, p):
    """(cost, vehicles, off, leave, arrival) of the best journey, by trying every vehicle at every stop."""
    first, last = max(wish - p.slack, 0.0), min(wish + p.slack, 86_399.0)
    by_vehicle = {}
    for c in calls:
        by_vehicle.setdefault(c[0], []).append(c)
    found = []

    def board(stop, ready, leave, rides):
        for own in by_vehicle.values():
            for i, c in enumerate(own):
                if c[2] == stop and ready <= c[4] <= ready + p.wait:
                    for later in own[i + 1 :]:
                        if later[3] - leave <= p.longest:
                            arrive(later[2], later[3], leave, rides + 1)

    def arrive(stop, time, leave, rides):
        for t, s, seconds, _ in egress:
            if (t, s) == (trip, stop):
                there = time + seconds
                found.append((there - leave + p.change_cost * (rides - 1), rides, abs(leave - wish), leave, there))
        if rides < p.rides:
            board(stop, time + p.change, leave, rides)
            for u, v, seconds, _ in walks:
                if u == stop:
                    board(v, time + seconds + p.change, leave, rides)

    for t, s, seconds, _ in access:
        if t == trip:
            leaves = {c[4] - seconds for c in calls if c[2] == s and first <= c[4] - seconds <= last} | {last}
            for leave in leaves:
                board(s, leave + seconds, leave, 0)
    found += [(seconds, 0, 0.0, wish, wish + seconds) for t, seconds, _ in direct if t == trip]
    return min(found, default=None)


PARAMS = [JourneyParams(rides=3), JourneyParams(slack=300.0, rides=2, wait=900.0, change=120.0, change_cost=400.0), JourneyParams(rides=4, wait=1500.0, longest=3000.0)]


@pytest.mark.parametrize("seed", range(2))
@pytest.mark.parametrize("p", PARAMS)
def test_against_all_journeys(spark, seed, p):
    calls, requests, access, egress, walks, direct = feed(seed)
    frame = spark.createDataFrame
    way = "trip long, stop long, seconds double, metres double"
    legs = journeys(
        frame(calls, "vehicle long, seq long, stop long, arrival double, departure double, mode string, metres double"), frame(requests, "trip long, departure double"),
        frame(access, way), frame(egress, way), frame(walks, "u long, v long, seconds double, metres double"), frame(direct, "trip long, seconds double, metres double"), p,
    ).checkpoint()
    rows = {}
    for r in legs.orderBy("trip", "seq").collect():
        rows.setdefault(r.trip, []).append(r)
    called = {(c[0], c[2]): c for c in calls}
    reached = 0
    for trip, wish in requests:
        want = best_of(trip, wish, calls, access, egress, walks, direct, p) if wish is not None else None
        own = rows.get(trip, [])
        if want is None:
            assert not own
            continue
        reached += 1
        rides = [r for r in own if r.mode != "walk"]
        leave, there = own[0].start, own[-1].end
        assert (there - leave + p.change_cost * max(len(rides) - 1, 0), len(rides), abs(leave - wish), leave, there) == want
        assert own[0].mode == own[-1].mode == "walk"
        for a, b in zip(own, own[1:]):  # the legs hang together
            assert a.to_stop == b.from_stop and a.end + b.wait == b.start and b.wait >= 0
        for r in rides:
            assert (r.start, r.end) == (called[r.vehicle, r.from_stop][4], called[r.vehicle, r.to_stop][3])
            assert r.mode == called[r.vehicle, r.from_stop][5] and r.metres == called[r.vehicle, r.to_stop][6] - called[r.vehicle, r.from_stop][6]
        if rides:
            assert (trip, own[0].to_stop, own[0].seconds) in {a[:3] for a in access} and (trip, own[-1].from_stop, own[-1].seconds) in {e[:3] for e in egress}
            assert all((r.from_stop, r.to_stop, r.seconds) in {w[:3] for w in walks} for r in own[1:-1] if r.mode == "walk")
    assert reached >= 4
    for r in leg_summary(legs).collect():
        assert r.seconds + r.wait == rows[r.trip][-1].end - rows[r.trip][0].start
        assert r.changes == max(sum(x.mode != "walk" for x in rows[r.trip]) - 1, 0)
    for r in journey_attributes(legs).collect():
        own = rows[r.trip]
        assert r.rides == sum(x.mode != "walk" for x in own) and r.ride_modes == "_".join(x.mode for x in own if x.mode != "walk")
        assert r.walk_distances == "_".join(f"{x.metres:.1f}" for x in own if x.mode == "walk")
        assert r.access_metres == (own[0].metres if len(own) > 1 else None) and r.walk_metres == sum(x.metres for x in own if x.mode == "walk")
    ends = frame([(t, t % 2, 7) for t, _ in requests], "trip long, o long, d long")
    for r in journey_skim(legs, ends, "rail").collect():
        own = [rows[t] for t in rows if t % 2 == r.o]
        assert r.n == len(own) and abs(r.seconds - sum(x[-1].end - x[0].start for x in own) / len(own)) < 1e-9


def test_no_calls(spark):
    frame, way = spark.createDataFrame, "trip long, stop long, seconds double, metres double"
    calls = frame([], "vehicle long, seq long, stop long, arrival double, departure double")
    requests = frame([(1, 5.0)], "trip long, departure double")
    assert journeys(calls, requests, frame([], way), frame([], way)).count() == 0
    walked = journeys(calls, requests, frame([], way), frame([], way), direct=frame([(1, 90.0, 100.0)], "trip long, seconds double, metres double")).collect()
    assert [(r.seq, r.mode, r.start, r.end) for r in walked] == [(1, "walk", 5.0, 95.0)]
