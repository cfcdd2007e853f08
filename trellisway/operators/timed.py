"""Least-time paths over links whose time depends on when they are entered."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import paths as P

#: A table of at most this many times by link and bin (16 bytes each) is sent to every task, beside the links.
MAX_TIMES = 8_000_000


def profiles(links: DataFrame, times: DataFrame, size: float = 900.0, bins: int = 96) -> DataFrame:
    """``(a, b, bin, tau, later)`` of the links that ``times (a, b, bin, time)`` has seen, for every bin of the day.

    links: ``(a, b, time[, dist])`` with the free time, which counts in bins that nobody has entered a link, and after the last bin. Who
    enters a link first leaves it first: one who enters at t leaves at t + tau, and no later than ``later``, the earliest that
    anybody leaves who enters in a later bin.
    """
    free = links.groupBy("a", "b").agg(F.min("time").alias("free"))
    seen = times.select("a", "b", F.col("bin").cast("long").alias("bin"), F.col("time").cast("double").alias("seen")).dropna()
    known = seen.select("a", "b").distinct().join(free, ["a", "b"])
    every = known.select("a", "b", "free", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(bins - 1).cast("long"))).alias("bin"))
    own = every.join(seen.groupBy("a", "b", "bin").agg(F.avg("seen").alias("seen")), ["a", "b", "bin"], "left").withColumn("tau", F.coalesce("seen", "free"))
    after = Window.partitionBy("a", "b").orderBy(F.col("bin").desc()).rowsBetween(Window.unboundedPreceding, -1)
    last = F.lit(bins * float(size)) + F.col("free")
    least = F.least(last, F.coalesce(F.min(F.col("bin") * F.lit(float(size)) + F.col("tau")).over(after), last))
    return own.select("a", "b", "bin", "tau", least.alias("later"))


@dataclass(frozen=True)
class Timed:
    """Links by their start node, with the row of those that have a profile in ``tau`` and ``later`` (rows, bins), or -1."""

    nodes: np.ndarray
    start: np.ndarray
    head: np.ndarray
    free: np.ndarray
    dist: np.ndarray
    row: np.ndarray
    tau: np.ndarray
    later: np.ndarray
    size: float

    def exits(self, edge: np.ndarray, entered: np.ndarray) -> np.ndarray:
        """When links are left that are entered at these times."""
        out = entered + self.free[edge]
        bin_ = np.floor(entered / self.size).astype(np.int64)
        at = np.flatnonzero((self.row[edge] >= 0) & (bin_ >= 0) & (bin_ < self.tau.shape[1]))
        cell = self.row[edge[at]], bin_[at]
        out[at] = np.minimum(entered[at] + self.tau[cell], self.later[cell])
        return out

    def arrivals(self, origins: np.ndarray, departures: np.ndarray, targets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Arrivals, metres and parents (lanes, nodes); a lane goes on until no open label could improve one of its targets."""
        n, k = len(self.nodes), len(origins)
        time, dist, parent = np.full(k * n, np.inf), np.zeros(k * n), np.full(k * n, -1, np.int64)
        active = np.arange(k) * n + origins
        time[active] = departures
        degree, band = np.diff(self.start), 8 * self.free.mean() * n / len(self.free) if len(self.free) else 0.0
        wanted, owner = np.concatenate([i * n + t for i, t in enumerate(targets)]), np.repeat(np.arange(k), [len(t) for t in targets])
        first_target = np.cumsum([0, *(len(t) for t in targets)])[:-1]
        while len(active):
            bound = np.maximum.reduceat(time[wanted], first_target) if len(owner) else np.full(k, np.inf)
            active = active[time[active] < bound[active // n]]
            if not len(active):
                break
            lane = active // n
            first = np.flatnonzero(np.concatenate([[True], lane[1:] != lane[:-1]]))
            low = np.minimum.reduceat(time[active], first)
            now = time[active] <= np.repeat(low + band, np.diff(np.append(first, len(active))))
            changed, turn = [active[~now]], active[now]
            use = degree[turn % n]
            work = np.cumsum(use)
            cuts = np.searchsorted(work, np.arange(P.STEP, work[-1], P.STEP), "right")
            for part, count in zip(np.split(turn, cuts), np.split(use, cuts), strict=True):
                edge = P.spans(self.start[part % n], count)
                source = np.repeat(part, count)
                to, t = source - source % n + self.head[edge], self.exits(edge, time[source])
                better = np.flatnonzero(t < time[to])
                to, t, source, edge = to[better], t[better], source[better], edge[better]
                order = np.lexsort((source, t, to))
                order = order[np.concatenate([[True], to[order][1:] != to[order][:-1]])] if len(order) else order
                to, source, edge = to[order], source[order], edge[order]
                time[to], dist[to], parent[to] = t[order], dist[source] + self.dist[edge], source % n
                changed.append(to)
            active = np.unique(np.concatenate(changed))
        return time.reshape(k, n), dist.reshape(k, n), parent.reshape(k, n)


def _send(links: DataFrame, found: DataFrame, size: float, max_links: int | None, max_times: int) -> Timed | None:
    """Links and profiles as arrays, or None where there are more of them than are sent. Both are counted first."""
    graph = P.send(links, max_links=max_links, slack=None)
    if graph is None or found.limit(max_times + 1).count() > max_times:
        return None
    table = found.orderBy("a", "b", "bin").toArrow()
    a, b, bins = (table.column(c).to_numpy() for c in ("a", "b", "bin"))
    width = int(bins.max()) + 1 if len(bins) else 1
    pairs = np.searchsorted(graph.nodes, a[::width]) * len(graph.nodes) + np.searchsorted(graph.nodes, b[::width])
    order = np.argsort(pairs)
    own = np.repeat(np.arange(len(graph.nodes)), np.diff(graph.start)) * len(graph.nodes) + graph.head
    at = np.minimum(np.searchsorted(pairs[order], own), max(len(pairs) - 1, 0))
    row = np.where(pairs[order][at] == own, order[at], -1) if len(pairs) else np.full(len(own), -1)
    tau, later = (table.column(c).to_numpy().reshape(-1, width) for c in ("tau", "later"))
    return Timed(graph.nodes, graph.start, graph.head, graph.time, graph.dist, row, tau, later, float(size))


_FOUND = "origin long, departure double, target long, arrival double, dist double, nodes array<long>"


def _rows(rows: list[tuple], graph: Timed) -> Iterator[pa.RecordBatch]:
    place = {int(x): i for i, x in enumerate(graph.nodes)}
    known = [(place[o], o, d, sorted({place[t] for t in targets if t in place})) for o, d, targets in rows if o in place]
    known = [r for r in known if r[3]]
    if not known:
        return
    targets = [np.array(r[3], np.int64) for r in known]
    time, dist, parent = graph.arrivals(np.array([r[0] for r in known]), np.array([r[2] for r in known], float), targets)
    out: list[tuple] = []
    for k, (_, origin, departure, _) in enumerate(known):
        for t in targets[k].tolist():
            if np.isfinite(time[k, t]):
                nodes, at = [], t
                while at >= 0:
                    nodes.append(int(graph.nodes[at]))
                    at = int(parent[k, at])
                out.append((origin, departure, int(graph.nodes[t]), time[k, t], dist[k, t], nodes[::-1]))
    types = [pa.int64(), pa.float64(), pa.int64(), pa.float64(), pa.float64(), pa.list_(pa.int64())]
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=[c.split()[0] for c in _FOUND.split(", ")])


def timed_paths(
    links: DataFrame, times: DataFrame, requests: DataFrame, size: float = 900.0, bins: int = 96, max_links: int | None = None, max_times: int = MAX_TIMES
) -> DataFrame:
    """Earliest arrival of every request over congested links: ``(origin, departure, target, arrival, dist, nodes)``.

    links: ``(a, b, time[, dist])``; times: ``(a, b, bin, time)``, as :func:`network.congested_times` finds them, in bins of ``size`` seconds;
    requests: ``(origin, target, departure)``, of which equal ones are one. A link entered in a bin takes the bin's time, with the rule of
    :func:`profiles`, so that waiting never helps and a label of the earliest arrival is enough. Requests without a path have no row, and
    neither have those with a null; where the ends are one node the arrival is the departure.

    Links and profiles are counted first. Within the bounds they are sent to the tasks, which search from blocks of origins and
    departures until their targets are settled; beyond them labels are relaxed by joins on the link and its bin.
    """
    own = P._links(links.withColumn("cost", F.col("time")))
    found = profiles(own.select("a", "b", "time"), times, size, bins)
    ends = [F.col(c).cast("long").alias(c) for c in ("origin", "target")]
    asked = requests.select(*ends, F.col("departure").cast("double").alias("departure")).dropna().distinct()
    graph = _send(own, found, size, max_links, max_times)
    if graph is None:
        return _by_joins(own, found.checkpoint(), asked, size)
    grouped = asked.groupBy("origin", "departure").agg(F.collect_list("target").alias("targets"))
    return P.over_blocks(grouped, _FOUND, graph, lambda rows, g: [len(g.nodes)] * len(rows), _rows)


def _by_joins(links: DataFrame, found: DataFrame, asked: DataFrame, size: float, rounds: int = 10_000) -> DataFrame:
    """The same by rounds: labels that improved meet the links of their nodes and the profile of the bin. Each round is a checkpoint.

    Labels that are no earlier than the last of their targets go no further. A round relaxes only what improved in the one before; paths are
    followed back by a join a link.
    """
    lane = ["origin", "departure"]
    nodes = links.select(F.explode(F.array("a", "b")).alias("origin")).distinct()
    asked = asked.join(nodes, "origin", "left_semi").join(nodes.withColumnRenamed("origin", "target"), "target", "left_semi").select(*lane, "target").checkpoint()
    step = links.select(F.col("a").alias("node"), F.col("b").alias("to"), F.col("time").alias("free"), F.col("dist").alias("d"))
    prof = found.select(F.col("a").alias("node"), F.col("b").alias("to"), "bin", "tau", "later")
    none = F.lit(None).cast("long")
    settled = asked.select(*lane).distinct().select(*lane, F.col("origin").alias("node"), F.col("departure").alias("arrival"), F.lit(0.0).alias("dist"), none.alias("parent")).checkpoint()
    fresh = settled
    for _ in range(rounds):
        now = fresh.withColumn("bin", F.floor(F.col("arrival") / size)).join(step, "node").join(prof, ["node", "to", "bin"], "left")
        left = F.coalesce(F.least(F.col("arrival") + F.col("tau"), F.col("later")), F.col("arrival") + F.col("free"))
        label = F.struct(left.alias("arrival"), (F.col("dist") + F.col("d")).alias("dist"), F.col("node").alias("parent"))
        least = now.groupBy(*lane, F.col("to").alias("node")).agg(F.min(label).alias("m")).select(*lane, "node", "m.*")
        old = settled.select(*lane, "node", F.col("arrival").alias("old"))
        better = least.join(old, [*lane, "node"], "left").filter(F.col("old").isNull() | (F.col("arrival") < F.col("old"))).drop("old").checkpoint()
        if better.isEmpty():
            break
        settled = settled.join(better.select(*lane, "node"), [*lane, "node"], "left_anti").unionByName(better).checkpoint()
        known = asked.join(settled.withColumnRenamed("node", "target"), [*lane, "target"], "left").groupBy(*lane).agg(F.max(F.coalesce("arrival", F.lit(float("inf")))).alias("bound"))
        fresh = better.join(known, lane).filter(F.col("arrival") < F.col("bound")).drop("bound").checkpoint()
        if fresh.isEmpty():
            break
    else:
        raise RuntimeError("labels did not settle")
    ends = asked.join(settled.withColumnRenamed("node", "target"), [*lane, "target"])
    open_, done = ends.select(*lane, "target", "arrival", "dist", F.array("target").alias("nodes"), F.col("parent").alias("at")).checkpoint(), None
    steps = settled.select(*lane, F.col("node").alias("at"), "parent")
    while True:
        arrived = open_.filter("at is null").drop("at")
        done = arrived if done is None else done.unionByName(arrived).checkpoint()
        open_ = open_.filter("at is not null")
        if open_.isEmpty():
            return done.select(*lane, "target", "arrival", "dist", F.reverse("nodes").alias("nodes"))
        open_ = open_.join(steps, [*lane, "at"]).withColumn("nodes", F.concat("nodes", F.array("at"))).drop("at").withColumnRenamed("parent", "at").checkpoint()
