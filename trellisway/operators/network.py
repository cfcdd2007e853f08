"""Building and enriching directed networks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Labels of nodes that are sent to every task, where a round meets them with all links.
MAX_BROADCAST_LABELS = 2_000_000


def _sent(labels: DataFrame, n: int) -> DataFrame:
    return F.broadcast(labels) if n <= MAX_BROADCAST_LABELS else labels


def directed_links(edges: DataFrame) -> DataFrame:
    """§1.3: two directed links per undirected edge, by the rules of the network build.

    edges: edge_id, a, b, length, modes array<string>, one_way boolean, width, lanes, capacity, road. Self-loops and pure
    public-transport edges are left out. One-way edges lose cars and trucks on the way back; a way back without modes
    is left out. Where only walking was allowed cycling is added, dismounted. The width is halved where cars come
    both ways or not at all, and belongs to the way out otherwise. Lanes are at most 8 and 1 without cars.
    """
    pt = F.array(*map(F.lit, ("bus", "train", "tram")))
    kept = edges.filter((F.col("a") != F.col("b")) & (F.size(F.array_except("modes", pt)) > 0))
    walk, bike = F.array_contains("modes", "walk"), F.array_contains("modes", "bike")
    kept = kept.withColumn("dismount", walk & ~bike).withColumn(
        "modes", F.when(walk & ~bike, F.array_append("modes", "bike")).otherwise(F.col("modes"))
    )
    back = F.when(F.col("one_way"), F.array_except("modes", F.array(F.lit("car"), F.lit("truck")))).otherwise(F.col("modes"))
    car, car_back = F.array_contains("modes", "car"), F.array_contains(back, "car")
    split = car_back | (~car & (F.size(back) > 0))
    base = [F.col("edge_id"), F.col("length"), F.col("road")]
    ways = F.array(
        F.struct(F.lit("out").alias("way"), F.col("a"), F.col("b"), F.col("modes"), F.col("dismount"),
                 F.when(split, F.col("width") / 2).otherwise(F.col("width")).alias("width")),
        F.struct(F.lit("rtn").alias("way"), F.col("b").alias("a"), F.col("a").alias("b"), back.alias("modes"),
                 (F.col("dismount") | F.col("one_way")).alias("dismount"),
                 F.when(split, F.col("width") / 2).otherwise(F.lit(0.0)).alias("width")),
    )
    out = kept.select(*base, "lanes", "capacity", F.explode(ways).alias("w")).select(*base, "lanes", "capacity", "w.*").filter(F.size("modes") > 0)
    has_car = F.array_contains("modes", "car")
    return out.select(
        F.concat(F.col("edge_id").cast("string"), "way").alias("link_id"), *base, "a", "b", F.array_sort("modes").alias("modes"), "dismount", "width",
        F.when(has_car, F.least(F.col("lanes"), F.lit(8.0))).otherwise(F.lit(1.0)).alias("lanes"),
        F.when(has_car, F.col("capacity")).otherwise(F.lit(0.0)).alias("capacity"), has_car.alias("allows_car"),
    )


def for_mode(links: DataFrame, mode: str) -> DataFrame:
    """Links that allow a mode."""
    return links.filter(F.array_contains("modes", mode))


def nodes_of(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """The nodes at which a link of the network starts or ends."""
    ends = links.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    return nodes.join(ends, "node", "left_semi")


def junctions(links: DataFrame, tasks: int | None = None) -> DataFrame:
    """Nodes where more than two distinct edges meet: ``(node, n_edges)``. Ends are dealt over ``tasks``, or as Spark does."""
    ends = links.select(F.explode(F.array("a", "b")).alias("node"), "edge_id")
    ends = (ends if tasks is None else ends.repartition(tasks, "node")).distinct()
    return ends.groupBy("node").agg(F.count("*").alias("n_edges")).filter("n_edges > 2")


def same_road(osm: Column, other_osm: Column, name: Column, other_name: Column) -> Column:
    """Equal OSM ids (unknown ones are -1 and equal), or equal names that aren't empty."""
    return (osm == other_osm) | F.coalesce((F.length(name) > 0) & (name == other_name), F.lit(False))


def crossing_attributes(links: DataFrame, tasks: int | None = None) -> DataFrame:
    """What a link crosses at the junction it ends in: ``(link_id, cross_width, cross_lanes, cross_aadt, cross_speed, crosses)``.

    links: link_id, edge_id, b, osm_id, name, allows_car, width, lanes, aadt_fwd, limit_mph. Crossed are the other links
    that enter the same junction, allow cars and belong to another road by :func:`same_road`; an unknown (null) osm_id crosses nothing.

    What a link crosses depends on its junction, id and name only. Sums are those of the junction without those of the same id and of the same
    name, and with those of both back, so a junction of n links makes n rows and not their pairs. The top speed is that of the first of
    five candidates that is of another road: of an id and of a name the two fastest are enough, and they hide four at most.
    Links are dealt by their junction over ``tasks``, or as Spark does.
    """
    at = junctions(links.select("edge_id", F.col("a"), F.col("b")), tasks).select(F.col("node").alias("b"))
    links = links if tasks is None else links.repartition(tasks, "b")
    road = F.coalesce("name", F.lit("")).alias("road")
    ends = links.join(at, "b", "left_semi").filter("osm_id is not null").select("b", "osm_id", road, "allows_car", "width", "lanes", "aadt_fwd", "limit_mph")
    car = lambda c: F.sum(F.when(F.col("allows_car"), F.coalesce(c, F.lit(0.0))).otherwise(F.lit(0.0)))
    measures = {"cross_width": car("width"), "cross_lanes": car("lanes"), "cross_aadt": car("aadt_fwd"), "_n": F.count_if("allows_car")}
    groups = ends.groupBy("b", "osm_id", "road").agg(*(m.alias(n) for n, m in measures.items()), F.max(F.when(F.col("allows_car"), F.col("limit_mph"))).alias("_v"))

    def others(name: str) -> Column:
        whole, same_id, same_name = (F.sum(name).over(Window.partitionBy(*keys)) for keys in (["b"], ["b", "osm_id"], ["b", "road"]))
        return whole - same_id - F.when(F.col("road") != "", same_name - F.col(name)).otherwise(F.lit(0))

    turn = lambda *keys: F.row_number().over(Window.partitionBy(*keys).orderBy(F.col("_v").desc(), "osm_id", "road"))
    fast = groups.filter("_v is not null").withColumn("_r", turn("b", "osm_id")).filter("_r <= 2").withColumn("_r", turn("b", "road")).filter("_r <= 2").withColumn("_r", turn("b")).filter("_r <= 5")
    fast = fast.groupBy("b").agg(F.array_sort(F.collect_list(F.struct("_r", "_v", "osm_id", "road"))).alias("_fast"))
    met = groups.select("b", "osm_id", "road", *(others(n).alias(n) for n in measures)).filter("_n > 0").join(fast, "b", "left")
    other = F.filter("_fast", lambda f: (f["osm_id"] != F.col("osm_id")) & ((F.col("road") == "") | (f["road"] != F.col("road"))))
    found = met.withColumn("cross_speed", F.get(other, 0)["_v"]).drop("_fast", "_n")
    return links.select("link_id", "b", "osm_id", road).join(found, ["b", "osm_id", "road"], "left").select(
        "link_id", *(F.coalesce(c, F.lit(0.0)).alias(c) for c in ("cross_width", "cross_lanes", "cross_aadt")), "cross_speed",
        F.col("cross_width").isNotNull().alias("crosses"),
    )


def with_opposite_volume(links: DataFrame) -> DataFrame:
    """Adds ``aadt``, the volume both ways; of several links the opposite way the one with the least id counts."""
    back = links.groupBy(F.col("a").alias("b"), F.col("b").alias("a")).agg(F.min_by("aadt_fwd", "link_id").alias("aadt_back"))
    return links.join(back, ["a", "b"], "left").withColumn("aadt", F.col("aadt_fwd") + F.coalesce("aadt_back", F.lit(0))).drop("aadt_back")


def strong_component(links: DataFrame, max_rounds: int = 1000) -> DataFrame:
    """The nodes of the largest strongly connected component, the one with the least node among equals.

    Forward-backward colouring by joins: each round spreads the least node id along and against the links among the
    nodes still open until it is stable; nodes that the same colour reaches both ways are one component. The links are read once, and
    not shuffled where the labels of the open nodes are few enough to be sent.
    """
    ends = links.select("a", "b").distinct().checkpoint()
    edges = ends.filter("a <> b")
    open_ = ends.select(F.explode(F.array("a", "b")).alias("node")).distinct().checkpoint()
    best = None
    for turn in range(max_rounds):
        n = open_.count()
        if n == 0:
            break
        few = lambda df: _sent(df, n)  # noqa: E731, B023
        inner = edges  # all nodes are open at first
        if turn:
            inner = edges.join(few(open_.select(F.col("node").alias("a"))), "a", "left_semi").join(few(open_.select(F.col("node").alias("b"))), "b", "left_semi").checkpoint()
        colour = _spread(inner, open_.select("node", F.col("node").alias("colour")), "a", "b", n)
        roots = colour.filter("node = colour").select("node")
        same = inner.join(few(colour.select(F.col("node").alias("a"), F.col("colour").alias("ca"))), "a").join(
            few(colour.select(F.col("node").alias("b"), F.col("colour").alias("cb"))), "b"
        ).filter("ca = cb").select("a", "b")
        back = _reach(same, roots, "b", "a", n)
        found = colour.join(back, "node", "left_semi").checkpoint()
        sizes = found.groupBy("colour").agg(F.count("*").alias("n"))
        top = sizes.orderBy(F.desc("n"), "colour").limit(1).collect()[0]
        if best is None or (top["n"], -top["colour"]) > (best[0], -best[1]):
            best = (top["n"], top["colour"], found.filter(F.col("colour") == top["colour"]).select("node"))
        open_ = open_.join(found, "node", "left_anti").checkpoint()
        if best[0] >= open_.count():
            break
    else:
        raise RuntimeError(f"the largest component was not found in {max_rounds} rounds")
    return best[2] if best else open_


def _spread(edges: DataFrame, labels: DataFrame, tail: str, head: str, n: int) -> DataFrame:
    """Least label that reaches each of ``n`` nodes along the edges."""
    labels = labels.checkpoint()
    while True:
        sent = edges.join(_sent(labels.select(F.col("node").alias(tail), "colour"), n), tail).select(F.col(head).alias("node"), "colour")
        after = labels.unionByName(sent).groupBy("node").agg(F.min("colour").alias("colour")).checkpoint()
        changed = after.join(labels.withColumnRenamed("colour", "old"), "node").filter("colour <> old")
        labels = after
        if changed.isEmpty():
            return labels


def _reach(edges: DataFrame, start: DataFrame, tail: str, head: str, n: int) -> DataFrame:
    """Those of ``n`` nodes that are reached from the start along the edges."""
    seen = front = start.distinct().checkpoint()
    while not front.isEmpty():
        front = edges.join(_sent(front.select(F.col("node").alias(tail)), n), tail, "left_semi").select(F.col(head).alias("node")).distinct()
        front = front.join(seen, "node", "left_anti").checkpoint()
        seen = seen.unionByName(front).checkpoint()
    return seen


def mark_disconnected(links: DataFrame, mode: str) -> DataFrame:
    """Links of a mode outside the mode's largest strong component lose the mode and get ``disconnected_<mode>``."""
    core = strong_component(for_mode(links, mode))
    n = core.count()
    at = lambda c: _sent(core.select(F.col("node").alias(c), F.lit(True).alias(f"_in_{c}")), n)
    gone = F.array_contains("modes", mode) & (F.col("_in_a").isNull() | F.col("_in_b").isNull())
    lost = F.array(*map(F.lit, ("car", "truck") if mode == "car" else (mode,)))
    return links.join(at("a"), "a", "left").join(at("b"), "b", "left").withColumn(f"disconnected_{mode}", gone).withColumn(
        "modes", F.when(gone, F.array_except("modes", lost)).otherwise(F.col("modes"))
    ).select(*links.columns, f"disconnected_{mode}")


def upgrade_cycle_network(links: DataFrame, edge_ids: DataFrame) -> DataFrame:
    """the listed edges become off-road cycleways. Their crossings are rated by that class; no attribute of its own is set."""
    hit = links.join(edge_ids, "edge_id", "left_semi").select("link_id", F.lit(True).alias("_up"))
    up = F.col("_up").isNotNull()
    return links.join(hit, "link_id", "left").withColumn("cycleosm", F.when(up, "offroad").otherwise(F.col("cycleosm"))).drop("_up")


def connectors(links: DataFrame, nodes: DataFrame, pairs: DataFrame) -> DataFrame:
    """Links from the end of one link to the start of another, straight, with the best of both links' values."""
    one = links.select(F.col("link_id").alias("from_link"), F.col("b").alias("a"), *(F.col(c).alias(f"{c}_1") for c in ("freespeed", "capacity", "lanes")))
    two = links.select(F.col("link_id").alias("to_link"), F.col("a").alias("b"), *(F.col(c).alias(f"{c}_2") for c in ("freespeed", "capacity", "lanes")))
    at = lambda e: nodes.select(F.col("node").alias(e), F.col("x").alias(f"x{e}"), F.col("y").alias(f"y{e}"))
    met = pairs.join(one, "from_link").join(two, "to_link").join(at("a"), "a").join(at("b"), "b")
    return met.select(
        F.concat_ws("_", F.lit("connector"), "from_link", "to_link").alias("link_id"), F.lit(-1).alias("edge_id"), "a", "b",
        F.hypot(F.col("xb") - F.col("xa"), F.col("yb") - F.col("ya")).alias("length"),
        *(F.greatest(f"{c}_1", f"{c}_2").alias(c) for c in ("freespeed", "capacity", "lanes")),
    )


def volumes_daily(events: DataFrame, vehicles: DataFrame, scale: float = 1.0) -> DataFrame:
    """``(link, car, truck, pcu)`` counts of link entries, scaled by the whole part of 1/scale; other types are ignored."""
    k = int(1 / scale)
    seen = events.join(vehicles, "vehicle").filter(F.col("type").isin("car", "truck"))
    car, truck = F.count_if(F.col("type") == "car") * k, F.count_if(F.col("type") == "truck") * k
    return seen.groupBy("link").agg(car.alias("car"), truck.alias("truck"), (car + 6 * truck).alias("pcu"))


def hour_of(seconds: Column) -> Column:
    return F.pmod(F.floor(seconds / 3600), F.lit(24)).cast("int")


def volumes_hourly(events: DataFrame, vehicles: DataFrame, scale: float = 1.0) -> DataFrame:
    """``(link, hour, car, truck)``; a vehicle of another type is an error."""
    k = int(1 / scale)
    kind = F.when(F.col("type").isin("car", "truck"), F.col("type")).otherwise(F.raise_error(F.concat(F.lit("unknown vehicle type "), "type")).cast("string"))
    seen = events.join(vehicles, "vehicle").withColumn("type", kind)
    return seen.groupBy("link", hour_of(F.col("time")).alias("hour")).agg(
        (F.count_if(F.col("type") == "car") * k).alias("car"), (F.count_if(F.col("type") == "truck") * k).alias("truck")
    )


def volumes_dense(links: DataFrame, hourly: DataFrame) -> DataFrame:
    """A row per link and hour, 0 where nothing was counted. The 24 hours are a literal, not a join."""
    hours = links.select("link", F.explode(F.sequence(F.lit(0), F.lit(23))).alias("hour"))
    return hours.join(hourly, ["link", "hour"], "left").select("link", "hour", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("car", "truck")))


def congested_times(events: DataFrame, bin_seconds: int = 900) -> DataFrame:
    """mean time on a link per bin of entry, from pairs of a vehicle's entry and its next event.

    events: vehicle, link, time, kind ('enter' or 'leave').
    """
    own = Window.partitionBy("vehicle").orderBy("time", "kind")
    paired = events.select("vehicle", "link", "time", "kind", F.lead("time").over(own).alias("left"), F.lead("kind").over(own).alias("next"), F.lead("link").over(own).alias("nlink"))
    stays = paired.filter("kind = 'enter' and next = 'leave' and nlink = link")
    return stays.groupBy("link", F.floor(F.col("time") / bin_seconds).alias("bin")).agg(F.avg(F.col("left") - F.col("time")).alias("time"), F.count("*").alias("n"))
