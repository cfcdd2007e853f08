"""Polygons and nearest features against plain geometry."""

import math
import random

import pytest
from pyspark.sql import functions as F

from trellisway.operators import spatial as S

HOOK = [(0.0, 0.0), (10.0, 0.0), (10.0, 10.0), (6.0, 10.0), (6.0, 4.0), (0.0, 4.0)]


def ring_frame(spark, rings):
    return spark.createDataFrame([(i, [{"x": x, "y": y} for x, y in r]) for i, r in rings], "zone long, ring array<struct<x:double,y:double>>")


def inside(ring, x, y):
    hit = False
    for (ax, ay), (bx, by) in zip(ring, ring[1:] + ring[:1]):
        if (ay > y) != (by > y) and x < ax + (y - ay) / (by - ay) * (bx - ax):
            hit = not hit
    return hit


def points(spark, n, seed=1, low=-2.0, high=12.0):
    draw = random.Random(seed)
    rows = [(i, draw.uniform(low, high), draw.uniform(low, high)) for i in range(n)]
    return rows, spark.createDataFrame([*rows, (n, None, 1.0)], "point long, x double, y double")


def test_contains_area_centroid(spark):
    rows, df = points(spark, 300)
    got = {r.point for r in S.inside_boundary(df, HOOK).collect()}
    assert got == {i for i, x, y in rows if inside(HOOK, x, y)}
    r = ring_frame(spark, [(1, HOOK), (2, [(0.0, 0.0), (1.0, 1.0)]), (3, [*HOOK, HOOK[0]])]).select("zone", S.area("ring").alias("a"), S.centroid("ring").alias("c")).orderBy("zone").collect()
    assert r[0].a == r[2].a == 64.0 and r[1].c is None
    assert abs(r[0].c.x - (40 * 5 + 24 * 8) / 64) < 1e-9 and abs(r[0].c.y - (40 * 2 + 24 * 7) / 64) < 1e-9


def test_zones_take_the_least_of_overlaps(spark):
    zones = ring_frame(spark, [(7, HOOK), (3, [(5.0, 1.0), (12.0, 1.0), (12.0, 6.0), (5.0, 6.0)]), (9, [])])
    rows, df = points(spark, 300)
    got = {r.point: r.zone for r in S.assign_zones(df, zones, 1.5, keep_outside=True).collect()}
    for i, x, y in rows:
        want = 3 if 5 <= x < 12 and 1 <= y < 6 else 7 if inside(HOOK, x, y) else None
        assert got[i] == want
    assert got[300] is None
    with pytest.raises(Exception, match="no geometry"):
        S.assign_zones(df, spark.createDataFrame([(1, None)], zones.schema), 1.0).collect()


@pytest.mark.parametrize("cell", [0.3, 40.0])
def test_nearest(spark, cell):
    rows, df = points(spark, 150, 2, -30.0, 30.0)
    draw = random.Random(5)
    nodes = [(i, float(draw.randrange(10)), float(draw.randrange(10))) for i in range(25)]
    found = {r.point: (r.best, r.distance) for r in S.nearest_node(df, spark.createDataFrame(nodes, "node long, x double, y double"), cell).collect()}
    assert set(found) == {i for i, _, _ in rows}
    for i, x, y in rows:
        best = min((math.hypot(x - a, y - b), n) for n, a, b in nodes)
        assert abs(found[i][1] - best[0]) < 1e-9
    links = [(k, *nodes[k][1:], *nodes[k + 1][1:]) for k in range(24)]
    near = S.nearest_link(df, spark.createDataFrame(links, "link long, ax double, ay double, bx double, by double"), max(cell, 1.0)).collect()

    def far(x, y, ax, ay, bx, by):
        d = (bx - ax) ** 2 + (by - ay) ** 2
        t = max(0.0, min(1.0, ((x - ax) * (bx - ax) + (y - ay) * (by - ay)) / d)) if d else 0.0
        return math.hypot(x - ax - t * (bx - ax), y - ay - t * (by - ay))

    at = {i: (x, y) for i, x, y in rows}
    assert len(near) == len(rows)
    for r in near:
        assert abs(r.distance - min(far(*at[r.point], *k[1:]) for k in links)) < 1e-9


def test_links_and_zones(spark):
    zones = ring_frame(spark, [(1, HOOK)])
    links = spark.createDataFrame(
        [(1, 1.0, 6.0, 5.0, 9.0), (2, 1.0, 6.0, 8.0, 8.0), (3, 2.0, 1.0, 3.0, 2.0), (4, -5.0, -5.0, 20.0, 20.0), (5, 11.0, 0.0, 11.0, 9.0)], "link long, ax double, ay double, bx double, by double"
    )
    assert {r.link for r in S.links_in_zones(links, zones, 2.0).collect()} == {2, 3, 4}


def test_random_points_are_inside_and_repeat(spark):
    zones = ring_frame(spark, [(1, HOOK)])
    wanted = spark.range(200).select("id", F.lit(1).alias("zone"))
    one, two = (sorted(S.random_points(wanted.repartition(n), zones).collect()) for n in (1, 5))
    assert one == two and all(inside(HOOK, r.x, r.y) for r in one)


def test_hexagons_and_nesting(spark):
    cells = S.hex_grid(spark, HOOK, 0.4).orderBy("cell").collect()
    assert [c.cell for c in cells] == list(range(1, len(cells) + 1))
    assert all(inside(HOOK, c.x, c.y) for c in cells)
    assert abs(len(cells) * 1.5 * math.sqrt(3) * 0.16 - 64) < 6
    S.check_nested([(1.0, 1.0), (2.0, 1.0), (2.0, 2.0)], HOOK)
    with pytest.raises(ValueError):
        S.check_nested([(1.0, 1.0), (2.0, 8.0)], HOOK)
    assert [r.r for r in spark.createDataFrame([("grid_250m",), ("other",)], "d string").select(S.grid_radius("d").alias("r")).collect()] == [250.0, 0.0]


#: A hook with a hole, and an island that lies apart.
PARTS = [[HOOK, [(1.0, 1.0), (4.0, 1.0), (4.0, 3.0), (1.0, 3.0)]], [[(1.0, 6.0), (4.0, 6.0), (1.0, 9.0)]]]


def parts_frame(spark, zones):
    rows = [(i, [[[{"x": x, "y": y} for x, y in r] for r in part] for part in parts]) for i, parts in zones]
    return spark.createDataFrame(rows, "zone long, parts array<array<array<struct<x:double,y:double>>>>")


def in_parts(x, y):
    return any(inside(part[0], x, y) and not any(inside(h, x, y) for h in part[1:]) for part in PARTS)


def test_parts_and_holes(spark):
    zones = parts_frame(spark, [(4, PARTS), (5, [])])
    rows, df = points(spark, 500)
    assert {r.point for r in S.assign_zones(df, zones, 1.5).collect()} == {i for i, x, y in rows if in_parts(x, y)} == {r.point for r in S.inside_boundary(df, PARTS).collect()}
    turned = parts_frame(spark, [(4, [[r[::-1] for r in part] for part in PARTS])])  # the way round does not matter
    for own in (zones, turned):
        r = own.filter("zone = 4").select(S.parts_area("parts").alias("a"), S.parts_centroid("parts").alias("c")).first()
        assert abs(r.a - (64 - 6 + 4.5)) < 1e-9
        assert abs(r.c.x - (40 * 5 + 24 * 8 - 6 * 2.5 + 4.5 * 2) / 62.5) < 1e-9 and abs(r.c.y - (40 * 2 + 24 * 7 - 6 * 2 + 4.5 * 7) / 62.5) < 1e-9
    links = [(1, 2.0, 1.5, 3.0, 2.5), (2, 2.0, 2.0, 5.0, 2.0), (3, 0.5, 7.0, 1.5, 7.0), (4, 4.5, 8.0, 5.5, 8.0), (5, 1.2, 6.1, 1.3, 6.2), (6, -1.0, -3.0, -1.0, 20.0), (7, 5.0, -3.0, 5.0, 20.0)]
    for cell in (0.7, 30.0):
        found = S.links_in_zones(spark.createDataFrame(links, "link long, ax double, ay double, bx double, by double"), zones, cell)
        assert {r.link for r in found.collect()} == {2, 3, 5, 7}


def test_cells_along_a_segment(spark):
    draw = random.Random(9)
    rows = [tuple(draw.choice([draw.uniform(-5, 5), float(draw.randrange(-5, 5))]) for _ in range(4)) for _ in range(300)] + [(1.0, 1.0, 1.0, 4.0), (2.0, 2.0, 2.0, 2.0)]
    df = spark.createDataFrame(rows, "ax double, ay double, bx double, by double")
    for r in df.select("*", S._crossed(*(F.col(c) for c in df.columns), 0.5).alias("cells")).collect():
        cells = [(c.cx, c.cy) for c in r.cells]
        assert len(cells) == len(set(cells)) <= 4 * (abs(r.bx - r.ax) + abs(r.by - r.ay)) / 0.5 + 12
        for k in range(101):
            t = k / 100
            assert (math.floor((r.ax + t * (r.bx - r.ax)) / 0.5), math.floor((r.ay + t * (r.by - r.ay)) / 0.5)) in cells or 0 < t < 1


def test_points_are_uniform_over_parts(spark):
    sliver = [[[(0.0, 0.0), (1e-9, 0.0), (10.0, 10.0)]]]
    zones = parts_frame(spark, [(1, PARTS), (2, sliver), (3, [[[(0.0, 0.0), (1.0, 1.0)]]])])
    wanted = spark.range(24_000).select("id", (F.when(F.col("id") < 20_000, 1).when(F.col("id") < 22_000, 2).otherwise(3)).alias("zone"))
    one, two = (sorted(S.random_points(wanted.repartition(n), zones).collect()) for n in (1, 5))
    assert one == two and [r.id for r in one] == list(range(22_000))
    assert all(abs(r.x - r.y) < 1e-6 and 0 <= r.x <= 10 for r in one if r.zone == 2)
    own = [(r.x, r.y) for r in one if r.zone == 1]
    assert all(in_parts(x, y) for x, y in own)
    seen = {}
    for x, y in own:
        seen[int(x), int(y)] = seen.get((int(x), int(y)), 0) + 1
    whole = [(i, j) for i in range(10) for j in range(10) if all(in_parts(i + a, j + b) for a in (0.001, 0.999) for b in (0.001, 0.999)) and not (i + j == 9 and i < 4)]
    mean = 20_000 / 62.5
    chi = sum((seen.get(c, 0) - mean) ** 2 / mean for c in whole)
    assert len(whole) > 50 and abs(chi - len(whole)) < 4 * math.sqrt(2 * len(whole))
