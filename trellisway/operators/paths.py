"""Shortest-path operators: trees over a broadcast graph, and a relational form for graphs that don't fit."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: A graph of at most this many links is sent to every task (about 32 bytes a link); larger ones take `tree_by_joins`.
MAX_BROADCAST_LINKS = 8_000_000

#: A graph of more links is cut down to those that a cheapest path can take (`undominated`) before it is sent.
WHOLE_LINKS = 1_000_000

#: Draws of cost weights that are searched one after the other where a graph is cut down.
FEW_DRAWS = 16

#: Labels (origins times nodes) that a task holds at once, and links that it relaxes in one step.
LABELS, STEP = 1_000_000, 1_000_000


def spans(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The numbers of all the ranges, one range after the other."""
    ends = np.cumsum(lengths)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - lengths), lengths)


def parts(n: int, tail: np.ndarray, head: np.ndarray) -> np.ndarray:
    """Number of each node's connected part: least nodes spread over links, and each node then looks up its own least one's."""
    least = np.arange(n)
    while True:
        low, old = np.minimum(least[tail], least[head]), least.copy()
        np.minimum.at(least, tail, low)
        np.minimum.at(least, head, low)
        np.minimum.at(least, old, least.copy())
        while not np.array_equal(near := least[least], least):
            least = near
        if np.array_equal(least, old):
            return np.unique(least, return_inverse=True)[1].reshape(-1)


@dataclass(frozen=True)
class Trees:
    """Labels of a block of origins: arrays (origins, nodes), infinite or -1 where a node is not reached."""

    cost: np.ndarray
    time: np.ndarray
    dist: np.ndarray
    parent: np.ndarray


@dataclass(frozen=True)
class Labels:
    """Labels of a block of origins, one after the other: an origin has those of the nodes of its connected part only, in order of their numbers.

    ``node`` and ``owner`` tell a label's node and origin, ``base`` an origin's first label; ``parent`` is the label before, or -1.
    """

    cost: np.ndarray
    time: np.ndarray
    dist: np.ndarray
    parent: np.ndarray
    node: np.ndarray
    owner: np.ndarray
    base: np.ndarray

    def way(self, label: int) -> np.ndarray:
        """Nodes from the seed to the node of a reached label."""
        out = []
        while label >= 0:
            out.append(label)
            label = self.parent[label]
        return self.node[out[::-1]]


def _whole(values: np.ndarray, empty, shape: tuple[int, int], owner: np.ndarray, node: np.ndarray) -> np.ndarray:
    """Labels of some nodes of each origin as an array over all nodes."""
    if len(values) == shape[0] * shape[1]:
        return values.reshape(shape)
    out = np.full(shape, empty, values.dtype)
    out[owner, node] = values
    return out


@dataclass(frozen=True)
class Csr:
    """Links grouped by their start node, with dense node numbers."""

    nodes: np.ndarray
    start: np.ndarray
    head: np.ndarray
    cost: np.ndarray
    time: np.ndarray
    dist: np.ndarray
    ordered: bool = True  # the links of a node are in order of their cost
    part: np.ndarray | None = None  # number of each node's connected part, along and against links

    @classmethod
    def of(cls, links, reverse: bool, more_nodes: np.ndarray | None = None) -> Csr:
        tail, head = (links["b"], links["a"]) if reverse else (links["a"], links["b"])
        nodes = np.unique(np.concatenate([tail, head] if more_nodes is None else [tail, head, more_nodes]))
        t, h = np.searchsorted(nodes, tail), np.searchsorted(nodes, head)
        order = np.lexsort((h, links["cost"], t))
        start = np.searchsorted(t[order], np.arange(len(nodes) + 1))
        return cls(nodes, start, h[order], links["cost"][order], links["time"][order], links["dist"][order], part=parts(len(nodes), t, h))

    def place(self, node: int) -> int:
        """Dense number of a node, or -1."""
        at = int(np.searchsorted(self.nodes, node))
        return at if at < len(self.nodes) and self.nodes[at] == node else -1

    def places(self, nodes: np.ndarray) -> np.ndarray:
        """Dense numbers of nodes, or -1."""
        at = np.minimum(np.searchsorted(self.nodes, nodes), max(0, len(self.nodes) - 1))
        return np.where(self.nodes[at] == nodes, at, -1) if len(self.nodes) else np.full(len(nodes), -1)

    @cached_property
    def _by_part(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Each node's part, the nodes by part, where a part begins among them, and a node's number within its part."""
        n = len(self.nodes)
        part = np.zeros(n, np.int64) if self.part is None else self.part
        members = np.argsort(part, kind="stable")
        begin = np.searchsorted(part[members], np.arange(part.max() + 2 if n else 1))
        rank = np.empty(n, np.int64)
        rank[members] = np.arange(n) - begin[part[members]]
        return part, members, begin, rank

    @cached_property
    def _by_cost(self) -> tuple[float, np.ndarray]:
        """The costs of links with the nodes in front, so that a node's links up to a cost are found by one search."""
        scale = 2.0 ** np.ceil(np.log2(1 + self.cost.max()))
        return scale, np.repeat(np.arange(len(self.nodes)) * scale, np.diff(self.start)) + self.cost

    @cached_property
    def rank(self) -> np.ndarray:
        """A node's number within its part."""
        return self._by_part[3]

    def same_part(self, places: np.ndarray, other: np.ndarray | int) -> np.ndarray:
        """Whether nodes stand in the connected part of the others, dense numbers both."""
        part = self._by_part[0]
        return part[places] == part[other]

    def sizes(self, places: np.ndarray) -> np.ndarray:
        """Labels that origins at dense numbers have; none outside of the graph."""
        if not len(self.nodes):
            return np.zeros(len(places), np.int64)
        part, _, begin, _ = self._by_part
        own = part[places]
        return np.where(places >= 0, begin[own + 1] - begin[own], 0)

    def trees(self, seeds: list[list[tuple[int, float, float, float]]], limit: float = np.inf) -> Trees:
        """The labels of :meth:`search` as arrays (origins, nodes); the parent is a node's dense number."""
        found, shape = self.search(seeds, limit), (len(seeds), len(self.nodes))
        full = lambda values, empty: _whole(values, empty, shape, found.owner, found.node)
        parent = np.where(found.parent >= 0, found.node[found.parent], -1) if len(found.node) else found.parent
        return Trees(full(found.cost, np.inf), full(found.time, 0.0), full(found.dist, 0.0), full(parent, -1))

    def search(self, seeds: list[list[tuple[int, float, float, float]]], limit: float = np.inf) -> Labels:
        """Least costs from the seeds ``(node, cost, time, dist)`` of each origin, up to ``limit``; numbers are dense.

        All origins of the block are relaxed together. Each takes those of its open labels that are within a band above its
        least one, so that few labels are relaxed again, and keeps for each node the cheapest of a step, from the least
        parent. Only a lower cost replaces a label, and what an origin finds does not depend on the rest of the block.
        """
        n, k = len(self.nodes), len(seeds)
        # An origin has labels for the nodes of its part only: those of `node` from `base` on, in order of their numbers.
        if self.part is not None and any(len(own) > 1 and len({self.part[s[0]] for s in own}) > 1 for own in seeds):
            return replace(self, part=None).search(seeds, limit)
        part, members, begin, rank = self._by_part
        of = np.array([part[own[0][0]] if own else -1 for own in seeds], np.int64)
        size = np.where(of >= 0, begin[of + 1] - begin[of], 0) if n else np.zeros(k, np.int64)
        base, owner = np.cumsum(size) - size, np.repeat(np.arange(k), size)
        node = members[spans(begin[of], size)] if n else np.empty(0, np.int64)
        some = np.flatnonzero(size)
        row = np.cumsum(size > 0) - 1  # an origin's number among those with labels
        cost, time, dist = np.full(len(node), np.inf), np.zeros(len(node)), np.zeros(len(node))
        parent = np.full(len(node), -1, np.int64)
        for o, own in enumerate(seeds):
            for at, c, t, d in own:
                at = base[o] + rank[at]
                if c <= limit and c < cost[at]:
                    cost[at], time[at], dist[at] = c, t, d
        degree = np.diff(self.start)
        # Once an origin has reached every node, links that lead beyond its largest label are of no use: a node's links
        # are in order of cost, so those before that point are found by one search in the costs with the nodes in front.
        prunes = self.ordered and len(self.cost) > 0
        if prunes:
            scale, keys = self._by_cost
        band = 8 * self.cost.mean() * n / len(self.cost) if len(self.cost) else 0.0
        open_ = np.isfinite(cost)
        active = np.flatnonzero(open_)
        while len(active):
            whose = owner[active]
            first = np.flatnonzero(np.concatenate([[True], whose[1:] != whose[:-1]]))
            low = np.minimum.reduceat(cost[active], first)
            now = cost[active] <= np.repeat(low + band, np.diff(np.append(first, len(active))))
            turn = active[now]
            open_[turn] = False
            use = degree[node[turn]]
            if prunes:
                most = np.minimum(np.maximum.reduceat(cost, base[some]), limit)
                room = most[row[owner[turn]]] - cost[turn]
                key = node[turn] * scale + np.minimum(room, scale)
                use = np.minimum(use, np.searchsorted(keys, key + 4 * np.spacing(key), "right") - self.start[node[turn]])
            work = np.cumsum(use)
            cuts = np.searchsorted(work, np.arange(STEP, work[-1], STEP), "right")
            for own, count in zip(np.split(turn, cuts), np.split(use, cuts), strict=True):
                edge = spans(self.start[node[own]], count)
                source = np.repeat(own, count)
                to, c = base[owner[source]] + rank[self.head[edge]], cost[source] + self.cost[edge]
                better = np.flatnonzero((c < cost[to]) & (c <= limit))
                to, c, source, edge = to[better], c[better], source[better], edge[better]
                np.minimum.at(cost, to, c)
                least = np.flatnonzero(c == cost[to])
                to, source, edge = to[least], source[least], edge[least]
                parent[to] = len(node)
                np.minimum.at(parent, to, source)
                least = np.flatnonzero(source == parent[to])
                to, source, edge = to[least], source[least], edge[least]
                values = time[source] + self.time[edge], dist[source] + self.dist[edge]
                time[to], dist[to] = values
                open_[to] = True
            active = np.flatnonzero(open_)
        return Labels(cost, time, dist, parent, node, owner, base)

    def blocks(self) -> int:
        """Origins whose labels a task holds at once."""
        return max(1, LABELS // max(1, int(np.diff(self._by_part[2]).max(initial=0))))

    def path(self, parent: np.ndarray, at: int) -> list[int]:
        """Nodes from the seed to a reached node, by one origin's parents."""
        out = []
        while at >= 0:
            out.append(int(self.nodes[at]))
            at = parent[at]
        return out[::-1]


def _links(links: DataFrame) -> DataFrame:
    """Ends, cost, time and distance; parallel links keep the cheapest. Links with an unknown cost are left out."""
    names = links.columns
    own = links.select(
        F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b"), F.col("cost").cast("double").alias("cost"),
        (F.col("time") if "time" in names else F.col("cost")).cast("double").alias("time"),
        (F.col("dist") if "dist" in names else F.col("cost")).cast("double").alias("dist"),
    ).dropna()
    bad = F.raise_error("a link has a negative cost")
    if "time" in names or "dist" in names:
        least = own.groupBy("a", "b").agg(F.min(F.struct("cost", "time", "dist")).alias("m")).select("a", "b", "m.cost", "m.time", "m.dist")
    else:  # the least number is found by hash; for that of a struct Spark sorts all links
        least = own.groupBy("a", "b").agg(F.min("cost").alias("cost")).select("a", "b", "cost", F.col("cost").alias("time"), F.col("cost").alias("dist"))
    return least.withColumn("cost", F.when(F.col("cost") < 0, bad.cast("double")).otherwise(F.col("cost")))


def _ranked(links: DataFrame, end: str = "a", other: str = "b") -> DataFrame:
    """Links with ``_r``, their place by cost among those of their node, which stand together."""
    return links.withColumn("_r", F.row_number().over(Window.partitionBy(end).orderBy("cost", other)))


def undominated(links: DataFrame, most: int, nodes: int, slack: float = 1.0, near: int = 16, end: str = "a") -> DataFrame | None:
    """The links of ``(a, b, cost, time, dist)`` that cost no more than ``slack`` times the cheapest way between their ends; None if there are too many nodes.

    The others are on no cheapest path, so trees and paths are those of all links. Ways are searched over the cheapest
    links out of each node, or into it with ``end`` b, which are sent, at most ``most``; a task searches from the starts of its links, no
    farther than they are long, and drops those that such a way undercuts. What a way over further links would undercut stays in, which is
    no loss. Costs within 1e-9 of a way's stay too, since sums are rounded. Links that are dealt by ``a`` are not shuffled for that end, and
    ranked ones (:func:`_ranked`) are not sorted again.
    """
    spark, near = links.sparkSession, min(near, most // max(1, nodes))
    if near < 1:
        return None
    dealt = links if "_r" in links.columns else _ranked(links)  # one node's links stand together
    cheapest = dealt if end == "a" else _ranked(links.drop("_r"), "b", "a")
    table = cheapest.filter(F.col("_r") <= near).select("a", "b", "cost").toArrow()
    arrays = {c: table.column(c).to_numpy() for c in table.column_names}
    sent = spark.sparkContext.broadcast(Csr.of(arrays | {"time": arrays["cost"], "dist": arrays["cost"]}, False))

    def run(batches) -> Iterator[pa.RecordBatch]:
        graph = sent.value
        for batch in batches:
            a, b, cost = (batch.column(c).to_numpy() for c in ("a", "b", "cost"))
            keep = np.ones(len(a), bool)
            tails, whose = np.unique(a, return_inverse=True)
            at, head = graph.places(tails), graph.places(b)
            known = (at[whose] >= 0) & (head >= 0)
            known[known] = graph.same_part(head[known], at[whose[known]])  # other parts are out of reach
            block = np.cumsum(graph.sizes(at)) // LABELS
            for i in range(int(block[-1]) + 1 if len(block) else 0):
                mine = np.flatnonzero((block[whose] == i) & known)
                if len(mine):
                    own = np.unique(whose[mine])
                    found = graph.search([[(i, 0.0, 0.0, 0.0)] for i in at[own].tolist()], float(cost[mine].max()))
                    way = found.cost[found.base[np.searchsorted(own, whose[mine])] + graph.rank[head[mine]]]
                    keep[mine] = cost[mine] <= way * (slack * (1 + 1e-9))
            yield batch.filter(pa.array(keep)).select(["a", "b", "cost", "time", "dist"])

    return dealt.mapInArrow(run, "a long, b long, cost double, time double, dist double")


def send(links: DataFrame, reverse: bool = False, more_nodes: np.ndarray | None = None, max_links: int | None = None, slack: float | None = 1.0) -> Csr | None:
    """The graph of ``(a, b, cost, time, dist)`` as arrays, or None if it has more links than are sent. Links are counted first.

    Of more than WHOLE_LINKS only those are sent that a cheapest path can take, or that cost no more than ``slack`` times the cheapest way
    between their ends; every node stays, as one of its cheapest links does. Without a slack all links are sent or none.
    """
    most = MAX_BROADCAST_LINKS if max_links is None else max_links
    if most <= 0:
        return None
    held = [(links if slack is None else _ranked(links)).persist()]  # counted, then fetched
    try:
        size = held[0].agg(F.count("*").alias("n"), F.approx_count_distinct("a").alias("nodes")).first()
        if size["n"] > (most if slack is None else min(most, WHOLE_LINKS)):
            for end in ("a", "b"):  # ways over links out of nodes, and if many links are left, ways over links into nodes
                cut = undominated(held[-1], most, size["nodes"], slack, end=end) if slack is not None else None
                if cut is None:
                    return None
                held.append(cut.persist())
                left = held[-1].count()
                if left <= most // 2:
                    break
            if left > most:
                return None
        table = held[-1].select("a", "b", "cost", "time", "dist").toArrow()
    finally:
        for df in held:
            df.unpersist()
    return Csr.of({c: table.column(c).to_numpy() for c in table.column_names}, reverse, more_nodes)


def _tasks(spark: SparkSession) -> int:
    return max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))


def at_places(rows: list[tuple], graph: Csr) -> np.ndarray:
    """Labels that each row's search takes, from the node that is its first value."""
    return graph.sizes(graph.places(np.array([r[0] for r in rows], np.int64)))


def over_blocks(origins: DataFrame, schema: str, shared, weigh: Callable, work: Callable) -> DataFrame:
    """Spread rows over the tasks and give them to ``work(rows, shared)`` as tuples, in blocks of at most LABELS by ``weigh(rows, shared)``; it yields record batches.

    Rows are dealt by a hash of the first column: by the column itself Spark would take them for dealt already where they are distinct,
    and join the small partitions to one. It takes what comes out for as small as what goes in and would broadcast it, so joins with it are asked to merge.
    """
    spark = origins.sparkSession
    sent = spark.sparkContext.broadcast(shared)

    def run(batches) -> Iterator[pa.RecordBatch]:
        held, load = [], 0
        for batch in batches:
            rows = list(zip(*(c.to_pylist() for c in batch.columns), strict=True))
            for row, n in zip(rows, weigh(rows, sent.value), strict=True):
                if held and load + n > LABELS:
                    yield from work(held, sent.value)
                    held, load = [], 0
                held.append(row)
                load += int(n)
        if held:
            yield from work(held, sent.value)

    return origins.repartition(_tasks(spark), F.xxhash64(origins.columns[0])).mapInArrow(run, schema).hint("merge")


def _tree_rows(rows: list[tuple], graph: Csr, limit: float) -> Iterator[pa.RecordBatch]:
    seeds = [[(at, s["cost"], s["time"], s["dist"]) for s in own if (at := graph.place(s["node"])) >= 0] for _, own in rows]
    found = graph.search(seeds, limit)
    at = np.flatnonzero(np.isfinite(found.cost))
    parent = found.parent[at]
    names = np.array([r[0] for r in rows], np.int64)
    columns = [names[found.owner[at]], graph.nodes[found.node[at]], found.cost[at], found.time[at], found.dist[at]]
    before = pa.array(graph.nodes[found.node[np.maximum(parent, 0)]] if len(at) else np.empty(0, np.int64), mask=parent < 0)
    batch = pa.RecordBatch.from_arrays([*map(pa.array, columns), before], names=_TREE_NAMES)
    yield from (batch.slice(i, 100_000) for i in range(0, batch.num_rows, 100_000))
    lost = [(name, s) for (name, own), known in zip(rows, seeds, strict=True) if not known for s in own[:1]]  # outside of the graph: itself
    if lost:
        columns = [[x[0] for x in lost], *([x[1][c] for x in lost] for c in ("node", "cost", "time", "dist")), [None] * len(lost)]
        types = [pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64(), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=_TREE_NAMES)


def _at_seeds(rows: list[tuple], graph: Csr) -> np.ndarray:
    """Labels of each row's search from its seeds; with seeds in several parts those of all nodes."""
    out = np.zeros(len(rows), np.int64)
    for i, (_, own) in enumerate(rows):
        places = graph.places(np.array([s["node"] for s in own], np.int64))
        places = places[places >= 0]
        several = len(places) > 1 and len(np.unique(graph.part[places])) > 1
        out[i] = len(graph.nodes) if several else graph.sizes(places[:1]).sum()
    return out


_TREE_NAMES = ["origin", "node", "cost", "time", "dist", "parent"]
TREE = "origin long, node long, cost double, time double, dist double, parent long"


def tree(
    links: DataFrame, origins: DataFrame, reverse: bool = False, limit: float | None = None, max_links: int | None = None,
    max_time: float | None = None, max_dist: float | None = None,
) -> DataFrame:
    """Least-cost tree of every origin: ``(origin, node, cost, time, dist, parent)``.

    links: ``(a, b, cost[, time, dist])``; time and distance are carried along the cheapest path. origins: a column
    ``origin``. With ``reverse`` costs are those into the origin. ``limit`` keeps nodes of at most that cost, ``max_time`` and
    ``max_dist`` those whose cheapest path is within them; the search itself stops there where the cost is the time or the
    distance. Nodes that cannot be reached have no row. The links are counted first: a graph within ``max_links`` is sent to
    the tasks, and origins are spread over them; a larger one is relaxed by joins.
    """
    seeds = F.array(F.struct(F.col("origin").alias("node"), F.lit(0.0).alias("cost"), F.lit(0.0).alias("time"), F.lit(0.0).alias("dist")))
    own = origins.select(F.col("origin").cast("long").alias("origin")).dropna().distinct()
    bounds = {"time": max_time, "dist": max_dist}
    limits = [x for x in (limit, *(v for c, v in bounds.items() if c not in links.columns)) if x is not None]
    found = seeded_tree(links, own.select("origin", seeds.alias("seeds")), reverse, min(limits, default=None), max_links)
    for c, v in bounds.items():
        if v is not None:
            found = found.filter(F.col(c) <= v)
    return found


def seeded_tree(links: DataFrame, seeds: DataFrame, reverse: bool = False, limit: float | None = None, max_links: int | None = None) -> DataFrame:
    """Trees that start from several nodes with costs of their own: ``seeds (origin, seeds array<struct>)``.

    Where two seeds are the same node the cheaper counts.
    """
    own = _links(links)
    graph = send(own, reverse, max_links=max_links)
    if graph is None:
        return tree_by_joins(own, seeds, reverse, limit)
    most = np.inf if limit is None else limit
    return over_blocks(seeds, TREE, graph, _at_seeds, lambda rows, g: _tree_rows(rows, g, most))


def tree_by_joins(links: DataFrame, seeds: DataFrame, reverse: bool = False, limit: float | None = None, rounds: int = 10_000) -> DataFrame:
    """The same trees by relaxing a frontier with joins; for graphs of any size. Time, dist and parent follow the cost.

    A round joins the labels that improved with the links of their nodes and keeps the least cost per origin and node. Each
    round is written by checkpoint(), which cuts the lineage and survives lost executors.
    """
    tail, head = ("b", "a") if reverse else ("a", "b")
    step = links.select(F.col(tail).alias("node"), F.col(head).alias("to"), F.col("cost").alias("c"), F.col("time").alias("t"), F.col("dist").alias("d"))
    label = F.struct("cost", "time", "dist", "parent")
    best = (
        seeds.select("origin", F.explode("seeds").alias("s"))
        .select("origin", "s.node", "s.cost", "s.time", "s.dist", F.lit(None).cast("long").alias("parent"))
        .groupBy("origin", "node").agg(F.min(label).alias("m")).select("origin", "node", "m.*", F.lit(True).alias("fresh"))
    ).checkpoint()
    for _ in range(rounds):
        reached = best.filter("fresh").join(step, "node").select(
            "origin", F.col("to").alias("node"), (F.col("cost") + F.col("c")).alias("cost"), (F.col("time") + F.col("t")).alias("time"),
            (F.col("dist") + F.col("d")).alias("dist"), F.col("node").alias("parent"),
        )
        if limit is not None:
            reached = reached.filter(F.col("cost") <= limit)
        least = reached.groupBy("origin", "node").agg(F.min(label).alias("m"))  # partial minima before the shuffle
        old = best.select("origin", "node", F.struct("cost", "time", "dist", "parent").alias("old"))
        both = old.join(least, ["origin", "node"], "full").withColumn("fresh", F.col("old").isNull() | F.coalesce(F.col("m.cost") < F.col("old.cost"), F.lit(False)))
        best = both.select("origin", "node", F.when(F.col("fresh"), F.col("m")).otherwise(F.col("old")).alias("l"), "fresh").select("origin", "node", "l.*", "fresh").checkpoint()
        if best.filter("fresh").isEmpty():
            return best.select("origin", "node", "cost", "time", "dist", "parent")
    raise RuntimeError("trees did not end")


def two_way_tree(links: DataFrame, origins: DataFrame, limit: float | None = None, max_links: int | None = None) -> DataFrame:
    """Mean of the costs there and back, for nodes that are reached both ways; ``limit`` keeps those of at most that mean."""
    own = _links(links)
    graph = send(own, max_links=max_links)
    if graph is None:
        there, back = tree(links, origins, max_links=max_links), tree(links, origins, reverse=True, max_links=max_links)
        mean = lambda c: ((there[c] + back[c]) / 2).alias(c)
        both = there.join(back, (there["origin"] == back["origin"]) & (there["node"] == back["node"])).select(
            there["origin"], there["node"], mean("cost"), mean("time"), mean("dist")
        )
        return both if limit is None else both.filter(F.col("cost") <= limit)
    tail = np.repeat(np.arange(len(graph.nodes)), np.diff(graph.start))
    ends = {"a": graph.nodes[tail], "b": graph.nodes[graph.head], "cost": graph.cost, "time": graph.time, "dist": graph.dist}
    most = np.inf if limit is None else limit

    def work(rows, graphs):
        out, inn = graphs
        seeds = [[(at, 0.0, 0.0, 0.0)] if (at := out.place(o)) >= 0 else [] for (o,) in rows]
        there, back = out.search(seeds, 2 * most), inn.search(seeds, 2 * most)  # over the same parts, so their labels stand in the same order
        cost = (there.cost + back.cost) / 2
        at = np.flatnonzero(np.isfinite(cost) & (cost <= most))
        mean = [((getattr(there, c) + getattr(back, c)) / 2)[at] for c in ("time", "dist")]
        names = np.array([r[0] for r in rows], np.int64)
        batch = pa.RecordBatch.from_arrays(
            [pa.array(names[there.owner[at]]), pa.array(out.nodes[there.node[at]]), pa.array(cost[at]), *map(pa.array, mean)], names=_TREE_NAMES[:5]
        )
        yield from (batch.slice(i, 100_000) for i in range(0, batch.num_rows, 100_000))
        lost = [r[0] for r, s in zip(rows, seeds, strict=True) if not s]  # outside of the graph: itself
        if lost:
            yield pa.RecordBatch.from_arrays([pa.array(lost, pa.int64())] * 2 + [pa.array(np.zeros(len(lost)))] * 3, names=_TREE_NAMES[:5])

    own = origins.select(F.col("origin").cast("long").alias("origin")).dropna().distinct()
    return over_blocks(own, "origin long, node long, cost double, time double, dist double", (graph, Csr.of(ends, True)), lambda rows, g: at_places(rows, g[0]), work)


def _asked(pairs: DataFrame) -> DataFrame:
    asked = pairs.select(F.col("origin").cast("long").alias("origin"), F.col("target").cast("long").alias("target")).dropna()
    return asked.groupBy("origin").agg(F.collect_set("target").alias("targets"))


_PATH = "origin long, target long, cost double, time double, dist double"


def _path_rows(rows: list[tuple], graph: Csr, with_nodes: bool) -> Iterator[pa.RecordBatch]:
    rows = [(at, *r) for r in rows if (at := graph.place(r[0])) >= 0]
    found = graph.search([[(at, 0.0, 0.0, 0.0)] for at, *_ in rows])
    for k, (place, origin, targets) in enumerate(rows):
        at = graph.places(np.array(sorted(set(targets)), np.int64))
        at = at[at >= 0]
        at = at[graph.same_part(at, place)]
        label = found.base[k] + graph.rank[at]
        at, label = at[np.isfinite(found.cost[label])], label[np.isfinite(found.cost[label])]
        if len(at):
            columns = [pa.array(np.full(len(at), origin)), pa.array(graph.nodes[at]), *(pa.array(x[label]) for x in (found.cost, found.time, found.dist))]
            if with_nodes:
                columns.append(pa.array([graph.nodes[found.way(i)] for i in label], pa.list_(pa.int64())))
            yield pa.RecordBatch.from_arrays(columns, names=["origin", "target", "cost", "time", "dist", "nodes"][: len(columns)])


def paths(links: DataFrame, pairs: DataFrame, max_links: int | None = None) -> DataFrame:
    """Cheapest path of every ``(origin, target)``: cost, time, distance and its nodes. Pairs without a path have no row.

    Pairs are grouped by origin, so a tree serves all its targets. A graph of more than ``max_links`` links is relaxed by
    joins, and the paths are followed back by joins too.
    """
    graph = send(own := _links(links), max_links=max_links)
    if graph is None:
        return _paths_by_joins(own, pairs)
    return over_blocks(_asked(pairs), f"{_PATH}, nodes array<long>", graph, at_places, lambda rows, g: _path_rows(rows, g, True))


def costs(links: DataFrame, pairs: DataFrame, max_links: int | None = None) -> DataFrame:
    """G08 without the paths: ``(origin, target, cost, time, dist)`` of every pair that has one."""
    graph = send(own := _links(links), max_links=max_links)
    if graph is None:
        return _paths_by_joins(own, pairs).drop("nodes")
    return over_blocks(_asked(pairs), _PATH, graph, at_places, lambda rows, g: _path_rows(rows, g, False))


def trip_paths(links: DataFrame, trips: DataFrame, with_nodes: bool = False, max_links: int | None = None) -> DataFrame:
    """G08 for whole trips ``(origin, target, ...)``: their rows with ``cost, time, dist`` added, and ``nodes`` if asked for.

    Trips are dealt by origin and take their other columns through the search, so they are not joined with what it finds. A
    trip within one node costs 0; others without a path, or with an unknown end, have no row.
    """
    asked = trips.withColumns({c: F.col(c).cast("long") for c in ("origin", "target")}).dropna(subset=["origin", "target"])
    graph = send(own := _links(links), max_links=max_links)
    if graph is None:
        stays = F.col("origin") == F.col("target")
        values = {c: F.coalesce(c, F.when(stays, 0.0)) for c in ("cost", "time", "dist")} | {"nodes": F.coalesce("nodes", F.when(stays, F.array("origin")))}
        found = asked.join(_paths_by_joins(own, asked), ["origin", "target"], "left").withColumns(values).dropna(subset=["cost"])
        return found.select(*trips.columns, "cost", "time", "dist", *(["nodes"] if with_nodes else []))
    names = ["cost", "time", "dist", *(["nodes"] if with_nodes else [])]
    sent = asked.sparkSession.sparkContext.broadcast(graph)

    def run(batches) -> Iterator[pa.RecordBatch]:
        g = sent.value
        for batch in batches:
            origin, target = (batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("origin", "target"))
            starts, whose = np.unique(origin, return_inverse=True)
            at, end = g.places(starts), g.places(target)
            block = np.cumsum(g.sizes(at)) // LABELS
            for i in range(int(block[-1]) + 1 if len(block) else 0):
                own = np.flatnonzero(block == i)
                mine = np.flatnonzero(block[whose] == i)
                if not len(own):
                    continue
                stays, row = origin[mine] == target[mine], whose[mine] - own[0]
                values = [np.where(stays, 0.0, np.inf), np.zeros(len(mine)), np.zeros(len(mine))]
                found = g.search([[(p, 0.0, 0.0, 0.0)] if p >= 0 else [] for p in at[own].tolist()])
                known = np.flatnonzero((at[whose[mine]] >= 0) & (end[mine] >= 0))
                known = known[g.same_part(end[mine[known]], at[whose[mine[known]]])]
                label = np.full(len(mine), -1, np.int64)
                label[known] = found.base[row[known]] + g.rank[end[mine[known]]]
                for v, labels in zip(values, (found.cost, found.time, found.dist), strict=True):
                    v[known] = labels[label[known]]
                keep = np.flatnonzero(np.isfinite(values[0]))
                columns = [*batch.take(pa.array(mine[keep])).columns, *(pa.array(v[keep]) for v in values)]
                if with_nodes:
                    ways = [np.array([target[mine[i]]]) if stays[i] else g.nodes[found.way(label[i])] for i in keep]
                    columns.append(pa.array(ways, pa.list_(pa.int64())))
                yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names, *names])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in asked.schema) + ", cost double, time double, dist double" + (", nodes array<long>" if with_nodes else "")
    return asked.repartition(_tasks(asked.sparkSession), "origin").sortWithinPartitions("origin").mapInArrow(run, schema).hint("merge")  # more than its input


def _paths_by_joins(links: DataFrame, pairs: DataFrame, rounds: int = 1_000_000) -> DataFrame:
    """Trees by joins, then one join a hop from every target back to its origin; what has arrived waits in a table of its own."""
    asked = pairs.select(F.col("origin").cast("long").alias("origin"), F.col("target").cast("long").alias("target")).dropna().distinct()
    seeds = F.array(F.struct(F.col("origin").alias("node"), F.lit(0.0).alias("cost"), F.lit(0.0).alias("time"), F.lit(0.0).alias("dist")))
    known = links.select(F.explode(F.array("a", "b")).alias("origin")).distinct()
    found = tree_by_joins(links, asked.select("origin").distinct().join(known, "origin", "left_semi").select("origin", seeds.alias("seeds"))).checkpoint()
    ends = asked.join(found.withColumnRenamed("node", "target"), ["origin", "target"])
    open_ = ends.select(*ends.columns[:5], F.array("target").alias("nodes"), F.col("parent").alias("at")).checkpoint()
    steps, done = found.select("origin", F.col("node").alias("at"), "parent"), None
    for _ in range(rounds):
        arrived = open_.filter("at is null").drop("at")
        done = arrived if done is None else done.unionByName(arrived).checkpoint()
        open_ = open_.filter("at is not null")
        if open_.isEmpty():
            return done.select("origin", "target", "cost", "time", "dist", F.reverse("nodes").alias("nodes"))
        open_ = open_.join(steps, ["origin", "at"]).withColumn("nodes", F.concat("nodes", F.array("at"))).drop("at").withColumnRenamed("parent", "at").checkpoint()
    raise RuntimeError("paths did not end")


def _sampled_rows(rows: list[tuple], shared) -> Iterator[pa.RecordBatch]:
    graph, attributes = shared
    for draw in dict.fromkeys(r[0] for r in rows):
        own = [(r[2], r[3]) for r in rows if r[0] == draw]
        weights = next(r[1] for r in rows if r[0] == draw)
        priced = replace(graph, cost=graph.time * (1 + np.array(weights) @ attributes), ordered=False)
        for batch in _path_rows(own, priced, True):
            yield pa.RecordBatch.from_arrays([pa.array(np.full(batch.num_rows, draw)), *batch.columns], names=["draw", *batch.schema.names])


def sampled_paths(links: DataFrame, pairs: DataFrame, draws: DataFrame, attributes: list[str]) -> DataFrame:
    """F27 with J06: cheapest paths of every pair under every draw of cost weights: ``(draw, origin, target, cost, time, dist, nodes)``.

    links: a, b, time, dist and the attribute columns; a link costs ``time * (1 + sum of weight * attribute)``. draws: ``(draw,
    weights array<double>)`` in the attributes' order, 0 or more. The links are sent once, within MAX_BROADCAST_LINKS, and
    draws times origins are spread over the tasks, so a thousand draws are one job. FEW_DRAWS over more than WHOLE_LINKS are searched one
    after the other, each over the links that a cheapest path can take under it. Links with a null are left out.
    """
    spark = links.sparkSession
    ends = [F.col(c).cast("long").alias(c) for c in ("a", "b")]
    own = links.select(*ends, *(F.col(c).cast("double").alias(c) for c in ("time", "dist", *attributes))).dropna().persist()  # counted, then fetched
    try:
        size = own.count()
        if size > MAX_BROADCAST_LINKS or (size > WHOLE_LINKS and draws.count() <= FEW_DRAWS):
            return _sampled_by_draws(own, pairs, draws, attributes)
        table = own.toPandas()
    finally:
        own.unpersist()
    place = np.arange(len(table), dtype=float)  # carried through the sort, to bring the attributes into the same order
    graph = Csr.of({"a": table["a"].to_numpy(), "b": table["b"].to_numpy(), "cost": place, "time": table["time"].to_numpy(), "dist": table["dist"].to_numpy()}, False)
    values = table[attributes].to_numpy(float)[graph.cost.astype(np.int64)].T
    listed = draws.select(F.col("draw").cast("long").alias("draw"), F.col("weights").cast("array<double>").alias("weights"))
    packed = F.broadcast(listed.agg(F.collect_list(F.struct("draw", "weights")).alias("ds")))  # one row: the draws are a parameter
    work = _asked(pairs).join(packed).select(F.explode("ds").alias("d"), "origin", "targets").select("d.draw", "d.weights", "origin", "targets")
    work = work.repartition(_tasks(spark), "draw", "origin").sortWithinPartitions("draw")
    sent, size = spark.sparkContext.broadcast((graph, values)), graph.blocks()

    def run(batches):
        held: list[tuple] = []
        for batch in batches:
            held += zip(*(c.to_pylist() for c in batch.columns), strict=True)
            while len(held) >= size:
                yield from _sampled_rows(held[:size], sent.value)
                held = held[size:]
        if held:
            yield from _sampled_rows(held, sent.value)

    return work.mapInArrow(run, f"draw long, {_PATH}, nodes array<long>").hint("merge")  # not as small as its input


def _sampled_by_draws(links: DataFrame, pairs: DataFrame, draws: DataFrame, attributes: list[str]) -> DataFrame:
    """The same one draw after the other, for a graph too large to send whole; draws are a parameter."""
    out = None
    for r in draws.select("draw", "weights").collect():
        factor = sum((F.lit(float(w)) * F.col(c) for w, c in zip(r["weights"], attributes, strict=True)), F.lit(1.0))
        found = paths(links.withColumn("cost", F.col("time") * factor), pairs).select(F.lit(r["draw"]).cast("long").alias("draw"), "*")
        out = found if out is None else out.unionByName(found)
    return out


def path_links(found: DataFrame) -> DataFrame:
    """The links of each path in order: ``(origin, target, seq, a, b)``."""
    return found.select("origin", "target", F.posexplode("nodes").alias("seq", "a"), "nodes").select(
        "origin", "target", "seq", "a", F.get("nodes", F.col("seq") + 1).alias("b")
    ).dropna(subset=["b"])
