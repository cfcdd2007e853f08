"""Stops of a timetable mapped to roads: candidate links by stop, shortest paths between them, and the best choice along each route."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import paths as P
from . import spatial as S


@dataclass(frozen=True)
class MappingParams:
    """``links`` candidates of a stop, the nearest within ``reach``, or the nearest link of all where there is none; a metre away from
    the stop counts ``off``, and a hop without a way ``lost`` times its straight line."""

    reach: float = 100.0
    links: int = 6
    off: float = 2.0
    lost: float = 10.0


def patterns(calls: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(vehicle, route)`` and ``(route, seq, stop)`` of ``calls (vehicle, seq, stop)``: vehicles with the same stops in the same order share a route.

    A route is named by the least of its vehicles, and its stops are numbered from 1.
    """
    listed = calls.select("vehicle", "seq", "stop").dropna().groupBy("vehicle").agg(F.array_sort(F.collect_list(F.struct("seq", "stop"))).alias("s"))
    listed = listed.select("vehicle", F.transform("s", lambda s: s["stop"]).alias("stops"))
    routes = listed.groupBy("stops").agg(F.min("vehicle").alias("route"))
    named = listed.join(routes, "stops").select("vehicle", "route")
    return named, routes.select("route", F.posexplode("stops").alias("i", "stop")).select("route", (F.col("i") + 1).cast("long").alias("seq"), "stop")


def candidate_links(stops: DataFrame, links: DataFrame, params: MappingParams = MappingParams()) -> DataFrame:
    """``(stop, link, a, b, length, away)``: the links that a stop ``(stop, x, y)`` may lie on, of straight ``links (link, a, b, length, ax, ay, bx, by)``.

    Links are listed under the cells they cross, as wide as the reach, and a stop looks into nine. Ties go to the lesser link.
    """
    ends = [F.col(c) for c in ("ax", "ay", "bx", "by")]
    listed = links.select("link", *ends, F.explode(S._crossed(*ends, params.reach)).alias("c")).select("link", *ends, "c.*")
    around = F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1))))
    own = stops.select("stop", "x", "y").dropna()
    spots = own.withColumn("_d", around).select("stop", "x", "y", (F.floor(F.col("x") / params.reach) + F.col("_d.i")).alias("cx"), (F.floor(F.col("y") / params.reach) + F.col("_d.j")).alias("cy"))
    near = spots.join(listed, ["cx", "cy"]).select("stop", "link", S.segment_distance(F.col("x"), F.col("y"), *ends).alias("away")).filter(F.col("away") <= params.reach).distinct()
    order = Window.partitionBy("stop").orderBy("away", "link")
    best = near.withColumn("_r", F.row_number().over(order)).filter(F.col("_r") <= params.links).drop("_r").checkpoint()
    lost = own.join(best.select("stop").distinct(), "stop", "left_anti").checkpoint()
    if not lost.isEmpty():
        far = S.nearest_link(lost.withColumnRenamed("stop", "point"), links, 4 * params.reach)
        best = best.unionByName(far.select(F.col("point").alias("stop"), F.col("best").alias("link"), F.col("distance").alias("away")))
    return best.join(links.select("link", "a", "b", "length"), "link").select("stop", "link", "a", "b", "length", "away")


def _viterbi(table: pa.Table) -> pa.Table:
    """The cheapest sequence of links of one route from its hops ``(seq, from_link, to_link, cost, start)``; ties go to the lesser links."""
    columns = {c: table.column(c).to_numpy(zero_copy_only=False) for c in ("seq", "from_link", "to_link", "cost", "start")}
    order = np.lexsort((columns["from_link"], columns["to_link"], columns["seq"]))
    seq, one, two, cost, start = (columns[c][order] for c in ("seq", "from_link", "to_link", "cost", "start"))
    best = {int(x): float(c) for x, c in zip(one[seq == seq[0]], start[seq == seq[0]], strict=True)}
    back: list[dict[int, int]] = []
    for s in np.unique(seq):
        at, step, here = np.flatnonzero(seq == s), {}, {}
        for i in at.tolist():
            total = best[int(one[i])] + cost[i]
            if int(two[i]) not in here or total < here[int(two[i])]:
                here[int(two[i])], step[int(two[i])] = float(total), int(one[i])
        best = here
        back.append(step)
    last = min(best, key=lambda x: (best[x], x))
    total, chosen = best[last], [last]
    for step in reversed(back):
        chosen.append(step[chosen[-1]])
    chosen.reverse()
    first = int(seq[0])
    kind = table.schema.field("route").type
    return pa.table({"route": pa.array([table.column("route")[0].as_py()] * len(chosen), kind), "seq": pa.array(range(first, first + len(chosen)), pa.int64()), "link": pa.array(chosen, pa.int64()), "total": pa.array([total] * len(chosen))})


def map_routes(routes: DataFrame, stops: DataFrame, links: DataFrame, params: MappingParams = MappingParams(), max_links: int | None = None) -> DataFrame:
    """The link of every stop of every route: ``(route, seq, stop, link, total)``, with the route's whole cost beside.

    routes: ``(route, seq, stop)``, numbered without gaps; links have whole numbers as names. A route costs the metres between its stops and links, ``off``
    each, and from stop to stop the way from the end of one link through the next, nothing if the link is the same. The ways of all hops come from one search
    over distinct pairs of nodes (:func:`paths.costs`); a route then is solved over its hops' candidates, which are bounded. A hop
    without a way costs ``lost`` straight lines. Routes of one stop take its nearest link; stops without coordinates, and routes with one, have no row.
    """
    found = candidate_links(stops, links, params).checkpoint()
    order = Window.partitionBy("route").orderBy("seq")
    whole = routes.join(stops.filter("x is null or y is null").select("stop"), "stop", "left_semi").select("route").distinct()
    own = routes.join(whole, "route", "left_anti").withColumn("next", F.lead("stop").over(order))
    hops = own.filter("next is not null").select(F.col("stop").alias("u"), F.col("next").alias("v")).distinct()
    side = lambda end, name: found.select(F.col("stop").alias(end), *(F.col(c).alias(f"{name}_{c}") for c in ("link", "a", "b", "length", "away")))
    pairs = hops.join(side("u", "from"), "u").join(side("v", "to"), "v")
    roads = links.select("a", "b", F.col("length").alias("cost"))
    ways = P.costs(roads, pairs.filter("from_link <> to_link").select(F.col("from_b").alias("origin"), F.col("to_a").alias("target")).distinct(), max_links=max_links)
    places = stops.select("stop", "x", "y")
    line = F.sqrt((F.col("ux") - F.col("vx")) * (F.col("ux") - F.col("vx")) + (F.col("uy") - F.col("vy")) * (F.col("uy") - F.col("vy")))
    priced = (
        pairs.join(ways.select(F.col("origin").alias("from_b"), F.col("target").alias("to_a"), F.col("cost").alias("way")), ["from_b", "to_a"], "left")
        .join(places.toDF("u", "ux", "uy"), "u").join(places.toDF("v", "vx", "vy"), "v")
    )
    stay = (F.col("from_b") == F.col("to_a")) & F.col("way").isNull()  # nodes that no link leaves are their own way
    driven = F.when(F.col("from_link") == F.col("to_link"), 0.0).otherwise(F.coalesce(F.when(stay, 0.0).otherwise(F.col("way")) + F.col("to_length"), params.lost * line))
    step = priced.select("u", "v", "from_link", "to_link", (driven + params.off * F.col("to_away")).alias("cost"), (params.off * F.col("from_away")).alias("start")).checkpoint()
    lattice = own.filter("next is not null").select("route", "seq", F.col("stop").alias("u"), F.col("next").alias("v")).join(step, ["u", "v"])
    kind = routes.schema["route"].dataType.simpleString()
    solved = lattice.select("route", "seq", "from_link", "to_link", "cost", "start").groupBy("route").applyInArrow(_viterbi, f"route {kind}, seq long, link long, total double")
    several = own.filter("next is not null").select("route").distinct()
    near = found.groupBy("stop").agg(F.min(F.struct("away", "link")).alias("m"))
    alone = own.join(several, "route", "left_anti").join(near, "stop").select("route", "seq", F.col("m.link").alias("link"), (params.off * F.col("m.away")).alias("total"))
    return solved.unionByName(alone).join(own.select("route", "seq", "stop"), ["route", "seq"]).select("route", "seq", "stop", "link", "total")


def route_links(mapped: DataFrame, links: DataFrame, max_links: int | None = None) -> DataFrame:
    """The links that mapped routes pass: ``(route, hop, place, a, b, made)``, hop by hop from 1, in order of ``place``.

    A hop passes the way from the end of its first link, and then the next stop's link; between stops of one link it passes nothing. Where there is
    no way, one made-up link joins the two (``made``).
    """
    order = Window.partitionBy("route").orderBy("seq")
    ends = links.select("link", "a", "b")
    own = mapped.join(ends, "link").select("route", "seq", "link", "a", "b").withColumns({"to_link": F.lead("link").over(order), "to_a": F.lead("a").over(order), "to_b": F.lead("b").over(order)})
    hops = own.filter("to_link is not null and to_link <> link")
    found = P.paths(links.select("a", "b", F.col("length").alias("cost")), hops.select(F.col("b").alias("origin"), F.col("to_a").alias("target")).distinct(), max_links=max_links)
    met = hops.join(found.select(F.col("origin").alias("b"), F.col("target").alias("to_a"), "nodes"), ["b", "to_a"], "left")
    there = F.coalesce("nodes", F.when(F.col("b") == F.col("to_a"), F.array("b")))
    nodes = F.concat(F.coalesce(there, F.array("b", "to_a")), F.array("to_b"))
    steps = met.select("route", "seq", there.isNull().alias("lost"), nodes.alias("nodes")).select("route", F.col("seq").alias("hop"), "lost", "nodes", F.posexplode("nodes").alias("place", "a"))
    return steps.withColumn("b", F.get("nodes", F.col("place") + 1)).dropna(subset=["b"]).select("route", "hop", "place", "a", "b", (F.col("lost") & (F.col("place") == 0)).alias("made"))
