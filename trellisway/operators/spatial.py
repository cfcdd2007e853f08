"""Polygons, nearest features, grids and zone assignment, as column expressions and cell joins.

A polygon is an ``array<struct<x:double,y:double>>`` of its ring's corners, closed or not, or a column ``parts`` of several polygons
with holes: a list of polygons, each a list of rings, the outer one first. Points and features meet through equi-joins on the cells
of a square grid, so nothing is compared with everything.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: A feature that covers more cells than this of a grid is a sign that the cells are too small for it.
MAX_CELLS = 1_000_000

#: Cells of points that are sent to every task to meet the cells of links.
MAX_SENT_SPOTS = 1_000_000


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _length(dx: Column, dy: Column) -> Column:
    """Equal sums of squares give equal lengths, so that ties are ties; hypot() does not promise that."""
    return F.sqrt(dx * dx + dy * dy)


def _next(ring: Column, i: Column) -> Column:
    return F.element_at(ring, (i + 1) % F.size(ring) + 1)


def _crossings(ring: Column, x: Column, y: Column) -> Column:
    """How many edges of a ring lie to the right of a point."""

    def crosses(p: Column, i: Column) -> Column:
        q = _next(ring, i)
        spans = (p["y"] > y) != (q["y"] > y)
        at = p["x"] + (y - p["y"]) / F.nullif(q["y"] - p["y"], F.lit(0.0)) * (q["x"] - p["x"])
        return F.when(spans & (x < at), 1).otherwise(0)

    return F.aggregate(F.transform(ring, crosses), F.lit(0), lambda a, b: a + b)


def contains(ring: str | Column, x: str | Column, y: str | Column) -> Column:
    """Whether a point is inside a polygon, by the parity of edges to its right. NULL for null arguments.

    An edge counts from its lower end up to but without its upper end, so of two polygons that share an edge one has its
    points.
    """
    ring, x, y = _col(ring), _col(x), _col(y)
    return F.when(x.isNotNull() & y.isNotNull(), _crossings(ring, x, y) % 2 == 1)


def contains_rings(rings: str | Column, x: str | Column, y: str | Column) -> Column:
    """The same for all rings of a feature: a point in a hole, or outside of every part, has an even number of edges to its right."""
    rings, x, y = _col(rings), _col(x), _col(y)
    count = F.aggregate(F.transform(rings, lambda r: _crossings(r, x, y)), F.lit(0), lambda a, b: a + b)
    return F.when(x.isNotNull() & y.isNotNull(), count % 2 == 1)


def _with_rings(zones: DataFrame) -> DataFrame:
    """``(zone, rings)`` of zones with ``parts`` or a ``ring``; a null geometry is an error, an empty one goes."""
    rings = F.flatten("parts") if "parts" in zones.columns else F.when(F.col("ring").isNotNull(), F.array("ring"))
    bad = F.raise_error(F.lit("a zone has no geometry")).cast("array<array<struct<x:double,y:double>>>")
    own = zones.select("zone", F.filter(F.when(rings.isNull(), bad).otherwise(rings), lambda r: F.size(r) > 0).alias("rings"))
    return own.filter(F.size("rings") > 0)


def edges_of(zones: DataFrame) -> DataFrame:
    """``(zone, ax, ay, bx, by)``, the edges of all rings; those of no length are left out."""
    ring = _with_rings(zones).select("zone", F.explode("rings").alias("r"))
    corner = ring.select("zone", "r", F.posexplode("r").alias("i", "p")).select("zone", "p", _next(F.col("r"), F.col("i")).alias("q"))
    return corner.select("zone", F.col("p.x").alias("ax"), F.col("p.y").alias("ay"), F.col("q.x").alias("bx"), F.col("q.y").alias("by")).filter("ax <> bx or ay <> by")


def area(ring: str | Column) -> Column:
    """Signed area of a polygon, positive for rings against the clock."""
    ring = _col(ring)
    cross = F.transform(ring, lambda p, i: p["x"] * _next(ring, i)["y"] - _next(ring, i)["x"] * p["y"])
    return F.aggregate(cross, F.lit(0.0), lambda a, b: a + b) / 2


def centroid(ring: str | Column) -> Column:
    """Centre of mass ``struct<x, y>``; NULL for a polygon without area."""
    ring = _col(ring)

    def part(axis: str) -> Column:
        def term(p, i):
            q = _next(ring, i)
            return (p[axis] + q[axis]) * (p["x"] * q["y"] - q["x"] * p["y"])

        return F.aggregate(F.transform(ring, term), F.lit(0.0), lambda a, b: a + b) / F.nullif(6 * area(ring), F.lit(0.0))

    return F.when(area(ring) != 0, F.struct(part("x").alias("x"), part("y").alias("y")))


def _signed(parts: Column, of) -> Column:
    """Sum over rings of ``of(ring)``, with the sign that makes outer rings count and holes count against them."""

    def polygon(rings: Column) -> Column:
        own = F.transform(rings, lambda r, i: F.when(i == 0, 1.0).otherwise(-1.0) * F.signum(area(r)) * of(r))
        return F.aggregate(own, F.lit(0.0), lambda a, b: a + b)

    return F.aggregate(F.transform(parts, polygon), F.lit(0.0), lambda a, b: a + b)


def parts_area(parts: str | Column) -> Column:
    """Area of several polygons without that of their holes."""
    return _signed(_col(parts), area)


def parts_centroid(parts: str | Column) -> Column:
    """Centre of mass of several polygons with holes ``struct<x, y>``; NULL without area."""
    parts, whole = _col(parts), parts_area(parts)
    mass = lambda axis: _signed(parts, lambda r: F.coalesce(centroid(r)[axis] * area(r), F.lit(0.0)))
    return F.when(whole != 0, F.struct((mass("x") / F.nullif(whole, F.lit(0.0))).alias("x"), (mass("y") / F.nullif(whole, F.lit(0.0))).alias("y")))


def bounds(ring: str | Column) -> Column:
    """``struct<x0, y0, x1, y1>`` around a polygon."""
    ring = _col(ring)
    xs, ys = F.transform(ring, lambda p: p["x"]), F.transform(ring, lambda p: p["y"])
    return F.struct(F.array_min(xs).alias("x0"), F.array_min(ys).alias("y0"), F.array_max(xs).alias("x1"), F.array_max(ys).alias("y1"))


def _zone_centre(zones: DataFrame) -> Column:
    return parts_centroid("parts") if "parts" in zones.columns else centroid("ring")


def _cells(x0: Column, y0: Column, x1: Column, y1: Column, size: float) -> Column:
    """All cells ``struct<cx, cy>`` that a box touches."""
    low = lambda c: F.floor(c / size)
    span = lambda a, b: F.sequence(low(a), low(b))
    fits = (low(x1) - low(x0) + 1) * (low(y1) - low(y0) + 1) <= MAX_CELLS
    found = F.flatten(F.transform(span(x0, x1), lambda i: F.transform(span(y0, y1), lambda j: F.struct(i.alias("cx"), j.alias("cy")))))
    return F.when(fits, found).otherwise(F.raise_error("a feature covers too many cells; choose larger ones").cast("array<struct<cx:bigint,cy:bigint>>"))


def _crossed(ax: Column, ay: Column, bx: Column, by: Column, size: float) -> Column:
    """The cells ``struct<cx, cy>`` that a straight segment passes, column by column; as many as it is long, not as its bounds are large."""
    low = lambda c: F.floor(c / size)
    x0, x1, slack = F.least(ax, bx), F.greatest(ax, bx), 1e-9 * size

    def column(i: Column) -> Column:
        at = lambda x: F.when(ax == bx, ay).otherwise(ay + (x - ax) * (by - ay) / F.nullif(bx - ax, F.lit(0.0)))
        left, right = at(F.greatest(x0, i * size)), at(F.least(x1, (i + 1) * size))
        bottom = F.when(ax == bx, F.least(ay, by)).otherwise(F.least(left, right)) - slack
        top = F.when(ax == bx, F.greatest(ay, by)).otherwise(F.greatest(left, right)) + slack
        return F.transform(F.sequence(low(bottom), low(top)), lambda j: F.struct(i.alias("cx"), j.alias("cy")))

    fits = low(x1) - low(x0) + low(F.greatest(ay, by)) - low(F.least(ay, by)) <= MAX_CELLS
    found = F.flatten(F.transform(F.sequence(low(x0 - slack), low(x1 + slack)), column))
    return F.when(fits, found).otherwise(F.raise_error("a segment crosses too many cells; choose larger ones").cast("array<struct<cx:bigint,cy:bigint>>"))


def _cell_of(x: str = "x", y: str = "y", size: float = 1.0) -> tuple[Column, Column]:
    return F.floor(F.col(x) / size).alias("cx"), F.floor(F.col(y) / size).alias("cy")


def assign_zones(points: DataFrame, zones: DataFrame, cell: float, keep_outside: bool = False) -> DataFrame:
    """Adds ``zone`` to points ``(x, y, ...)``, the least zone ``(zone, ring)`` or ``(zone, parts)`` that contains each.

    Points outside of all zones go unless ``keep_outside``. Each zone is listed under the cells of its bounds, and a point
    looks into its own cell only. Points without coordinates are outside. An empty geometry contains nothing; a null one is
    an error.
    """
    own = _with_rings(zones)
    b = bounds(F.flatten("rings"))
    listed = own.select("zone", "rings", F.explode(_cells(b["x0"], b["y0"], b["x1"], b["y1"], cell)).alias("c")).select("zone", "rings", "c.*")
    spots = points.select(F.col("x").alias("_x"), F.col("y").alias("_y")).dropna().distinct()  # points of one place share the answer
    hits = (
        spots.select("_x", "_y", F.floor(F.col("_x") / cell).alias("cx"), F.floor(F.col("_y") / cell).alias("cy")).join(listed, ["cx", "cy"])
        .filter(contains_rings("rings", "_x", "_y")).groupBy("_x", "_y").agg(F.min("zone").alias("zone"))
    )
    met = (F.col("x") == F.col("_x")) & (F.col("y") == F.col("_y"))
    return points.drop("zone").join(hits, met, "left" if keep_outside else "inner").drop("_x", "_y")


def inside_boundary(points: DataFrame, ring: list) -> DataFrame:
    """Points ``(x, y, ...)`` inside one region, first by its bounds and then by its edges, all in the scan's stage.

    ring: corners ``(x, y)`` of one polygon, or parts: a list of polygons, each a list of rings.
    """
    rings = [r for part in ring for r in part] if isinstance(ring[0][0], (list, tuple)) and not isinstance(ring[0][0][0], (int, float)) else [ring]
    xs, ys = zip(*(p for r in rings for p in r), strict=True)
    corners = F.array(*(F.array(*(F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in r)) for r in rings))
    box = F.col("x").between(min(xs), max(xs)) & F.col("y").between(min(ys), max(ys))
    return points.filter(box).filter(contains_rings(corners, "x", "y"))


def check_nested(inner: list[tuple[float, float]], outer: list[tuple[float, float]]) -> None:
    """P10: fails unless every corner of the region lies inside the network's boundary."""
    for x, y in inner:
        hits = 0
        for (ax, ay), (bx, by) in zip(outer, outer[1:] + outer[:1], strict=True):
            if (ay > y) != (by > y) and x < ax + (y - ay) / (by - ay) * (bx - ax):
                hits += 1
        if hits % 2 == 0:
            raise ValueError(f"corner ({x}, {y}) of the region is outside of the network's boundary")


def segment_distance(x: Column, y: Column, ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    """Distance of a point from a straight segment."""
    dx, dy = bx - ax, by - ay
    t = F.coalesce(((x - ax) * dx + (y - ay) * dy) / F.nullif(dx * dx + dy * dy, F.lit(0.0)), F.lit(0.0))
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), t))
    return _length(x - ax - t * dx, y - ay - t * dy)


def _nearest(points: DataFrame, listed, distance: Column, best: Column, size: float, reach: float) -> DataFrame:
    """Rounds over grids whose cells double: a feature no farther than a cell's size is exact, the other points go on."""
    left, found = points.filter("x is not null and y is not null"), None
    while True:
        around = F.transform(
            F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1))),
            lambda d: F.struct((F.floor(F.col("x") / size) + d["i"]).alias("cx"), (F.floor(F.col("y") / size) + d["j"]).alias("cy")),
        )
        near = left.withColumn("_c", F.explode(around)).select(*left.columns, "_c.cx", "_c.cy").join(listed(size), ["cx", "cy"])
        hits = near.groupBy(*points.columns).agg(F.min(F.struct(distance.alias("distance"), best.alias("best"))).alias("m"))
        last = size > reach
        hits = (hits if last else hits.filter(F.col("m.distance") <= size)).select(*points.columns, "m.best", "m.distance").checkpoint()
        found = hits if found is None else found.unionByName(hits)
        left = left.join(hits.select("point"), "point", "left_anti").checkpoint()
        if last or left.isEmpty():
            return found
        size *= 2


def _extent(*frames: DataFrame) -> float:
    both = None
    for df in frames:
        own = df.agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"))
        both = own if both is None else both.unionByName(own)
    r = both.agg(F.min("x0"), F.max("x1"), F.min("y0"), F.max("y1")).first()
    return 0.0 if r[0] is None else max(r[1] - r[0], r[3] - r[2], 1e-9)


def nearest_node(points: DataFrame, nodes: DataFrame, cell: float) -> DataFrame:
    """``(point, x, y, best, distance)``, the exact nearest of ``nodes (node, x, y)``; ties go to the least node.

    points: ``(point, x, y)`` with distinct ids; those without coordinates have no row. ``cell`` should hold a few nodes.
    """
    points = points.select("point", "x", "y")

    def listed(size):
        return nodes.select("node", F.col("x").alias("nx"), F.col("y").alias("ny"), *_cell_of(size=size))

    return _nearest(points, listed, _length(F.col("x") - F.col("nx"), F.col("y") - F.col("ny")), F.col("node"), cell, _extent(points, nodes))


def nearest_link(points: DataFrame, links: DataFrame, cell: float) -> DataFrame:
    """``(point, x, y, best, distance)``, the exact nearest of straight ``links (link, ax, ay, bx, by)``; ties go to the least link.

    No link's nearest is farther than the nearest end of a link, which is found first among the few different ends. Links are listed under the
    cells that they cross, points under those within that reach, and a pair beyond it is dropped as soon as they meet. Few points are sent, so links are
    not shuffled. Cells double until they are as wide as the reach.
    """
    ends = links.select(F.col("ax").alias("x"), F.col("ay").alias("y")).unionByName(links.select(F.col("bx").alias("x"), F.col("by").alias("y"))).dropna().distinct()
    ends = ends.withColumn("node", F.struct("x", "y")).checkpoint()
    left = nearest_node(points, ends, cell).select("point", "x", "y", (F.col("distance") * (1 + 1e-9) + 1e-9).alias("_most")).checkpoint()  # sums are rounded
    segment, found, size = [F.col(c) for c in ("ax", "ay", "bx", "by")], None, cell
    far = segment_distance(F.col("x"), F.col("y"), *segment)
    widest = left.agg(F.max("_most").alias("m")).first()["m"] or 0.0
    while True:
        own = left.filter((F.col("_most") <= size) & (F.col("_most") > (0.0 if size == cell else size / 2)))
        box = [F.col(c) + s * F.col("_most") for s in (-1, 1) for c in ("x", "y")]
        spots = own.withColumn("_c", F.explode(_cells(*box, size))).select("point", "x", "y", "_most", "_c.cx", "_c.cy").checkpoint()
        spots = F.broadcast(spots) if spots.count() <= MAX_SENT_SPOTS else spots
        listed = links.select("link", *segment, F.explode(_crossed(*segment, size)).alias("_c")).select("link", *segment, "_c.cx", "_c.cy")
        near = listed.join(spots, ["cx", "cy"]).select("point", "x", "y", "_most", "link", far.alias("distance")).filter(F.col("distance") <= F.col("_most"))
        hits = near.groupBy("point", "x", "y").agg(F.min(F.struct("distance", F.col("link").alias("best"))).alias("m")).select("point", "x", "y", "m.best", "m.distance")
        found = hits if found is None else found.unionByName(hits)
        if size >= widest:
            return found.checkpoint()
        size *= 2


def within(points: DataFrame, nodes: DataFrame, reach: float) -> DataFrame:
    """``(point, node, distance)`` of all ``nodes (node, x, y)`` within ``reach`` of ``points (point, x, y)``, in a straight line.

    Cells are as wide as the reach, so a point looks into nine. Features without coordinates have no row.
    """
    around = F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1))))
    own = points.select("point", "x", "y").dropna().withColumn("_d", around)
    own = own.select("point", "x", "y", (F.floor(F.col("x") / reach) + F.col("_d.i")).alias("cx"), (F.floor(F.col("y") / reach) + F.col("_d.j")).alias("cy"))
    listed = nodes.select("node", F.col("x").alias("nx"), F.col("y").alias("ny"), *_cell_of(size=reach)).dropna()
    dx, dy = F.col("x") - F.col("nx"), F.col("y") - F.col("ny")
    met = own.join(listed, ["cx", "cy"]).withColumn("distance", F.sqrt(dx * dx + dy * dy))
    return met.filter(F.col("distance") <= reach).select("point", "node", "distance")


def zone_nodes(nodes: DataFrame, zones: DataFrame, cell: float) -> DataFrame:
    """``(zone, node)`` of the nodes in each zone; a zone without nodes gets the one nearest to its centroid."""
    inside = assign_zones(nodes, zones, cell).select("zone", "node")
    empty = zones.join(inside.select("zone").distinct(), "zone", "left_anti")
    centres = empty.select(F.col("zone").alias("point"), _zone_centre(zones).alias("c")).select("point", "c.x", "c.y")
    return inside.unionByName(nearest_node(centres, nodes, cell).select(F.col("point").alias("zone"), F.col("best").alias("node")))


def segments_cross(ax, ay, bx, by, cx, cy, dx, dy) -> Column:
    """Whether two closed segments have a point in common, by the sides their ends lie on."""
    side = lambda px, py, qx, qy, rx, ry: F.signum((qx - px) * (ry - py) - (qy - py) * (rx - px))
    on = lambda px, py, qx, qy, rx, ry: rx.between(F.least(px, qx), F.greatest(px, qx)) & ry.between(F.least(py, qy), F.greatest(py, qy))
    s1, s2 = side(ax, ay, bx, by, cx, cy), side(ax, ay, bx, by, dx, dy)
    s3, s4 = side(cx, cy, dx, dy, ax, ay), side(cx, cy, dx, dy, bx, by)
    touch = ((s1 == 0) & on(ax, ay, bx, by, cx, cy)) | ((s2 == 0) & on(ax, ay, bx, by, dx, dy))
    touch = touch | ((s3 == 0) & on(cx, cy, dx, dy, ax, ay)) | ((s4 == 0) & on(cx, cy, dx, dy, bx, by))
    return ((s1 != s2) & (s3 != s4)) | touch


def links_in_zones(links: DataFrame, zones: DataFrame, cell: float, tasks: int | None = None, unless: Column | None = None) -> DataFrame:
    """``(zone, link)`` of straight links ``(link, ax, ay, bx, by)`` that touch a zone ``(zone, ring or parts)``, within it or across its edge.

    A link touches a zone if it starts there or meets an edge. Links, zones and edges are listed under the cells that they cross, so a long
    link meets the few edges along its way. ``unless`` leaves out pairs by ``zone`` and the link's ends. Links are dealt over ``tasks``, where
    each one's zones then meet without another shuffle, or as Spark does.
    """
    ends = [F.col(c) for c in ("ax", "ay", "bx", "by")]
    rings = _with_rings(zones)
    b = bounds(F.flatten("rings"))
    no_edge = [F.lit(None).cast("double").alias(f"e_{c}") for c in ("ax", "ay", "bx", "by")]
    whole = rings.select("zone", "rings", *no_edge, F.explode(_cells(b["x0"], b["y0"], b["x1"], b["y1"], cell)).alias("c"))
    walls = edges_of(zones).select(
        "zone", F.lit(None).cast(rings.schema["rings"].dataType).alias("rings"), *(e.alias(f"e_{n}") for e, n in zip(ends, ("ax", "ay", "bx", "by"), strict=True)),
        F.explode(_crossed(*ends, cell)).alias("c"),
    )
    listed = whole.unionByName(walls).select("zone", "rings", "e_ax", "e_ay", "e_bx", "e_by", "c.*")
    own = links.select("link", *ends)
    own = own if tasks is None else own.repartition(tasks, "link")
    passed = own.select("link", *ends, F.explode(_crossed(*ends, cell)).alias("c")).select("link", *ends, "c.*")
    starts = (F.floor(F.col("ax") / cell) == F.col("cx")) & (F.floor(F.col("ay") / cell) == F.col("cy"))
    touches = F.when(F.col("rings").isNotNull(), starts & contains_rings("rings", "ax", "ay")).otherwise(segments_cross(*ends, *(F.col(f"e_{c}") for c in ("ax", "ay", "bx", "by"))))
    met = passed.join(listed, ["cx", "cy"]).filter(touches)
    return (met if unless is None else met.filter(~unless)).select("zone", "link").distinct()


def hex_grid(spark: SparkSession, ring: list[tuple[float, float]], side: float) -> DataFrame:
    """Hexagons ``(cell, x, y)`` of a side length whose centre lies in a polygon, numbered from 1 by row and column.

    Rows are 1.5 sides apart and every other row is shifted by half a hexagon's width.
    """
    xs, ys = zip(*ring, strict=True)
    width, step = math.sqrt(3) * side, 1.5 * side
    columns, rows = int((max(xs) - min(xs)) / width) + 2, int((max(ys) - min(ys)) / step) + 2
    cells = spark.range(columns * rows).select(F.floor(F.col("id") / columns).alias("r"), (F.col("id") % columns).alias("c"), "id")
    at = cells.select(
        "id", (F.lit(min(xs)) + width * (F.col("c") + F.when(F.col("r") % 2 == 1, 0.5).otherwise(0.0))).alias("x"),
        (F.lit(min(ys)) + step * F.col("r")).alias("y"),
    )
    inside = inside_boundary(at, ring)
    # Numbers need a total order: counts per block of ids give each block its first number.
    block = F.floor(F.col("id") / 10_000)
    sizes = inside.groupBy(block.alias("block")).agg(F.count("*").alias("n"))
    starts = sizes.select("block", (F.sum("n").over(Window.orderBy("block")) - F.col("n")).alias("start"))
    numbered = inside.withColumn("block", block).withColumn("i", F.row_number().over(Window.partitionBy("block").orderBy("id")))
    return numbered.join(starts, "block").select((F.col("start") + F.col("i")).alias("cell"), "x", "y")


def grid_radius(description: str | Column) -> Column:
    """Metres in a description of the form ``grid_<n>m``, else 0."""
    digits = F.regexp_extract(_col(description), r"^grid_([0-9]+)m$", 1)
    return F.coalesce(F.nullif(digits, F.lit("")).cast("double"), F.lit(0.0))


def uniform(*keys: str | Column) -> Column:
    """A number in [0, 1) from the MD5 of keys: a draw that is the same in every run, task and engine."""
    text = F.concat_ws(":", *(_col(k).cast("string") for k in keys))
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint") / F.lit(4294967296.0)


def trapezoids(zones: DataFrame) -> DataFrame:
    """Zones cut into trapezoids between the heights of their corners: ``(zone, y0, y1, l0, l1, r0, r1, area)``, left and right ends below and above.

    Of the edges that span a slab, ordered from left to right, each two in turn enclose a piece, whatever the holes and parts.
    """
    edges = edges_of(zones).filter("ay <> by")
    up = F.col("ay") < F.col("by")
    own = edges.select("zone", *(F.when(up, F.col(a)).otherwise(F.col(b)).alias(n) for a, b, n in (("ax", "bx", "px"), ("ay", "by", "py"), ("bx", "ax", "qx"), ("by", "ay", "qy"))))
    heights = own.select("zone", F.explode(F.array("py", "qy")).alias("y0")).distinct()
    slabs = heights.withColumn("y1", F.lead("y0").over(Window.partitionBy("zone").orderBy("y0"))).dropna()
    at = lambda y: F.col("px") + (F.col(y) - F.col("py")) * (F.col("qx") - F.col("px")) / (F.col("qy") - F.col("py"))
    met = own.join(slabs, "zone").filter("py <= y0 and qy >= y1").select("zone", "y0", "y1", at("y0").alias("x0"), at("y1").alias("x1"))
    turn = F.row_number().over(Window.partitionBy("zone", "y0").orderBy(F.col("x0") + F.col("x1"), "x0"))
    pair = met.withColumn("_n", turn - 1).withColumn("_k", F.floor(F.col("_n") / 2))
    side = lambda c, odd: F.max(F.when(F.col("_n") % 2 == odd, F.col(c)))
    both = pair.groupBy("zone", "y0", "y1", "_k").agg(side("x0", 0).alias("l0"), side("x1", 0).alias("l1"), side("x0", 1).alias("r0"), side("x1", 1).alias("r1"))
    size = (F.col("r0") - F.col("l0") + F.col("r1") - F.col("l1")) / 2 * (F.col("y1") - F.col("y0"))
    return both.withColumn("area", size).filter("area > 0").drop("_k")


def random_points(wanted: DataFrame, zones: DataFrame) -> DataFrame:
    """Adds ``x, y``, uniform over its zone ``(zone, ring or parts)``, to rows ``(id, zone, ...)``.

    The zone is cut into trapezoids; a number drawn for the row chooses one by area, and two more a point in it, so each row takes one draw,
    slivers and holes included. The numbers come from the row's id, so the same id gets the same point. Zones without area drop their rows.
    Trapezoids are listed under shares of the zone's area, so that a row meets those of its own share only.
    """
    cut = trapezoids(zones)
    upto = Window.partitionBy("zone").orderBy("y0", "l0", "l1")
    whole = Window.partitionBy("zone")
    own = cut.withColumns({"_to": F.sum("area").over(upto), "_all": F.sum("area").over(whole), "_n": F.count("*").over(whole), "_i": F.row_number().over(upto)})
    own = own.withColumns({"_to": F.when(F.col("_i") == F.col("_n"), 1.0).otherwise(F.col("_to") / F.col("_all"))})
    own = own.withColumn("_from", F.coalesce(F.lag("_to").over(upto), F.lit(0.0))).filter("_from < _to")
    last = F.least(F.floor(F.col("_to") * F.col("_n")), F.col("_n") - 1)
    listed = own.withColumn("_share", F.explode(F.sequence(F.least(F.floor(F.col("_from") * F.col("_n")), F.col("_n") - 1), last)))
    rows = wanted.withColumn("_u", uniform("id", F.lit("zone")))
    rows = rows.join(own.groupBy("zone").agg(F.max("_n").alias("_m")), "zone").withColumn("_share", F.least(F.floor(F.col("_u") * F.col("_m")), F.col("_m") - 1))
    names = ["_from", "_to", "y0", "y1", "l0", "l1", "r0", "r1"]
    met = rows.join(listed.select("zone", "_share", *(F.col(c).alias(f"_t{c}") for c in names)), ["zone", "_share"])
    met = met.filter((F.col("_u") >= F.col("_t_from")) & (F.col("_u") < F.col("_t_to")))
    w0, w1, v = F.col("_tr0") - F.col("_tl0"), F.col("_tr1") - F.col("_tl1"), uniform("id", F.lit("y"))
    root = w0 + F.sqrt(w0 * w0 + v * (w1 * w1 - w0 * w0))
    up = F.when(root > 0, v * (w0 + w1) / F.nullif(root, F.lit(0.0))).otherwise(0.0)
    placed = met.withColumn("_s", up)
    left = F.col("_tl0") + F.col("_s") * (F.col("_tl1") - F.col("_tl0"))
    wide = w0 + F.col("_s") * (w1 - w0)
    return placed.select(
        *wanted.columns, (left + uniform("id", F.lit("x")) * wide).alias("x"), (F.col("_ty0") + F.col("_s") * (F.col("_ty1") - F.col("_ty0"))).alias("y")
    )
