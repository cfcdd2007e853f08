"""Multinomial-logit mode choice: utilities as columns, likelihood and gradient as one aggregate, estimation, inference.

The data stay in Spark. An evaluation is one job: the log likelihood and the gradient, summed in the tasks. The optimiser and the small matrices live on the driver.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import RDD, StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .paths import _tasks, sampled_paths


#: Class codes of at most so many labels are broadcast.
MAX_CLASSES = 100_000


@dataclass(frozen=True)
class Specification:
    """Alternatives with their linear utilities, ``alternative -> [(coefficient, column expression in SQL)]``.

    ``available`` maps an alternative to a condition in SQL; those without one are always available. ``fixed`` coefficients
    keep their value. The alternatives are numbered in the order given, and ``choice`` holds that number.
    """

    utilities: dict[str, list[tuple[str, str]]]
    choice: str = "choice"
    available: dict[str, str] = field(default_factory=dict)
    fixed: dict[str, float] = field(default_factory=dict)

    def __post_init__(self):
        if unknown := set(self.available) - set(self.utilities):
            raise ValueError(f"availability of unknown alternatives {sorted(unknown)}")
        if unknown := set(self.fixed) - set(self.coefficients(all_=True)):
            raise ValueError(f"unknown fixed coefficients {sorted(unknown)}")

    def coefficients(self, all_: bool = False) -> list[str]:
        names = dict.fromkeys(c for terms in self.utilities.values() for c, _ in terms)
        return [c for c in names if all_ or c not in self.fixed]

    def values(self, beta: np.ndarray) -> dict[str, float | Column]:
        return dict(zip(self.coefficients(), map(float, beta), strict=True)) | self.fixed

    def utility(self, alternative: str, values: dict[str, float | Column]) -> Column:
        """NULL where the alternative is unavailable."""
        total = sum((F.lit(values[c]) * F.expr(x).cast("double") for c, x in self.utilities[alternative]), F.lit(0.0))
        return F.when(F.expr(self.available[alternative]), total) if alternative in self.available else total


def probabilities(data: DataFrame, spec: Specification, values: dict[str, float]) -> DataFrame:
    """Adds ``p array<double>``, the chance of every alternative; 0 where it is unavailable.

    The largest utility is taken off before exponents. A row without any available alternative has a null array.
    """
    own = data.withColumn("_u", F.array(*(spec.utility(a, values) for a in spec.utilities)))
    top = F.array_max("_u")
    raw = F.transform("_u", lambda u: F.coalesce(F.exp(u - top), F.lit(0.0)))
    own = own.withColumn("_e", F.when(top.isNotNull(), raw))
    total = F.aggregate("_e", F.lit(0.0), lambda a, b: a + b)
    return own.withColumn("_t", total).withColumn("p", F.transform("_e", lambda e: e / F.col("_t"))).drop("_u", "_e", "_t")


def _terms(data: DataFrame, spec: Specification, values: dict[str, float]) -> tuple[DataFrame, Column, list[Column]]:
    named = probabilities(data, spec, values)
    chosen = F.get("p", F.col(spec.choice).cast("int"))
    bad = F.raise_error(F.lit("the choice is none of the alternatives")).cast("double")
    loss = -F.log(F.when(chosen > 0, chosen).when(chosen == 0, 1e-300).otherwise(bad))
    parts = []
    for c in spec.coefficients():
        total = F.lit(0.0)
        for i, terms in enumerate(spec.utilities.values()):
            for name, x in terms:
                if name == c:
                    hit = F.when(F.col(spec.choice) == i, 1.0).otherwise(0.0)
                    total = total + (F.element_at("p", i + 1) - hit) * F.coalesce(F.expr(x).cast("double"), F.lit(0.0))
        parts.append(total)
    return named, loss, parts


def likelihoods(data: DataFrame, spec: Specification, betas: list[np.ndarray]) -> list[tuple[float, np.ndarray]]:
    """Negative log likelihood and its gradient at several points, by one aggregate with partial sums.

    Every row meets the handful of points inside its own task. A chance that underflows to 0 counts as 1e-300. A choice outside
    of the alternatives is an error.
    """
    names = spec.coefficients()
    points = [F.struct(F.lit(i).alias("point"), *(F.lit(float(b)).alias(n) for n, b in zip(names, beta, strict=True))) for i, beta in enumerate(betas)]
    own = data.withColumn("_b", F.explode(F.array(*points)))
    named, loss, parts = _terms(own, spec, {n: F.col(f"_b.{n}") for n in names} | spec.fixed)
    rows = named.groupBy("_b.point").agg(F.sum(loss).alias("f"), *(F.sum(p).alias(f"g{i}") for i, p in enumerate(parts))).collect()
    found = {r["point"]: (float(r["f"]), np.array([r[f"g{i}"] for i in range(len(parts))])) for r in rows}
    return [found.get(i, (0.0, np.zeros(len(parts)))) for i in range(len(betas))]


def likelihood(data: DataFrame, spec: Specification, beta: np.ndarray) -> tuple[float, np.ndarray]:
    """:func:`likelihoods` at one point."""
    return likelihoods(data, spec, [beta])[0]


def _constant(x: str) -> float | None:
    try:
        return float(x)
    except ValueError:
        return None


def packed(data: DataFrame, spec: Specification) -> RDD:
    """The data of an estimation in blocks of rows ``(values, available, choice)``, kept for the repeated evaluations; unpersist() releases them.

    values: a row of numbers for each different expression of the utilities that is no constant, 0 for null; available: a row for
    each alternative, false too where one of its expressions is null. Blocks are dealt over all tasks, however few files the data had.
    """
    terms = list(dict.fromkeys(x for own in spec.utilities.values() for _, x in own if _constant(x) is None))
    known = lambda own: [F.expr(x).cast("double").isNotNull() for _, x in own if _constant(x) is None]
    flags = []
    for name, own in spec.utilities.items():
        flag = F.coalesce(F.expr(spec.available[name]), F.lit(False)) if name in spec.available else F.lit(True)
        for k in known(own):
            flag = flag & k
        flags.append(flag)
    columns = [F.coalesce(F.expr(x).cast("double"), F.lit(0.0)) for x in terms] + [f.cast("boolean") for f in flags] + [F.coalesce(F.col(spec.choice).cast("int"), F.lit(-1))]
    n, k = len(terms), len(flags)

    def pack(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = b"".join(np.ascontiguousarray(c.to_numpy()).tobytes() for c in batch.columns[:n])
            available = b"".join(c.to_numpy(zero_copy_only=False).tobytes() for c in batch.columns[n : n + k])
            yield pa.RecordBatch.from_arrays([pa.array([x], pa.binary()) for x in (values, available, batch.columns[n + k].to_numpy().tobytes())], names=["v", "a", "c"])

    def unpack(r) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        choice = np.frombuffer(r["c"], np.int32)
        return np.frombuffer(r["v"], float).reshape(n, len(choice)), np.frombuffer(r["a"], bool).reshape(k, len(choice)), choice

    blocks = data.select(*(c.alias(f"c{i}") for i, c in enumerate(columns))).mapInArrow(pack, "v binary, a binary, c binary")
    return blocks.repartition(_tasks(data.sparkSession)).rdd.map(unpack).persist(StorageLevel.MEMORY_AND_DISK)


def evaluated(blocks: RDD, spec: Specification, betas: list[np.ndarray]) -> list[tuple[float, np.ndarray]]:
    """:func:`likelihoods` over :func:`packed` data: a task goes over its blocks once for all points, and one row of sums a task is added up."""
    names = spec.coefficients()
    terms = list(dict.fromkeys(x for own in spec.utilities.values() for _, x in own if _constant(x) is None))
    # For each alternative: (number of the free coefficient or -1, its fixed value, number of the expression or -1, its constant).
    of = [[(names.index(c) if c in names else -1, spec.fixed.get(c, 0.0), -1 if _constant(x) is not None else terms.index(x), _constant(x)) for c, x in own] for own in spec.utilities.values()]
    points = np.array(betas, float).reshape(len(betas), len(names))

    def run(part) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        loss, slope = np.zeros(len(points)), np.zeros(points.shape)
        for values, available, choice in part:
            rows = np.arange(len(choice))
            if ((choice < 0) | (choice >= len(of))).any() or not available.any(axis=0).all():
                raise ValueError("the choice is none of the alternatives")
            for i, beta in enumerate(points):
                u = np.empty(available.shape)
                for own, line in zip(of, u, strict=True):
                    line[:] = 0.0
                    for c, fixed, x, one in own:
                        line += (beta[c] if c >= 0 else fixed) * (one if x < 0 else values[x])
                u[~available] = -np.inf
                p = np.exp(u - u.max(axis=0))
                p /= p.sum(axis=0)
                chosen = p[choice, rows]
                loss[i] -= np.log(np.where(chosen == 0, 1e-300, chosen)).sum()
                p[choice, rows] -= 1
                for own, line in zip(of, p, strict=True):
                    for c, _, x, one in own:
                        if c >= 0:
                            slope[i, c] += one * line.sum() if x < 0 else line @ values[x]
        yield loss, slope

    sums = blocks.mapPartitions(run).collect()
    loss, slope = (np.sum([s[j] for s in sums], axis=0) for j in (0, 1))
    return [(float(loss[i]), slope[i]) for i in range(len(points))]


def minimise(evaluate, start: np.ndarray, tolerance: float = 1e-10, max_rounds: int = 500) -> tuple[np.ndarray, float, np.ndarray, int]:
    """Quasi-Newton steps (BFGS) with a backtracking line search; returns (point, value, gradient, rounds).

    A step that lowers the value too little is cut by quadratic and then cubic interpolation, never below a tenth. The inverse
    Hessian is left as it is where the curvature isn't positive. Ends when the step or the scaled gradient is small.
    """
    x, (f, g) = start.astype(float), evaluate(start.astype(float))
    inverse = np.eye(len(x))
    for done in range(1, max_rounds + 1):
        direction = -inverse @ g
        slope = float(g @ direction)
        if slope >= 0:
            inverse, direction = np.eye(len(x)), -g
            slope = float(g @ direction)
        if slope == 0:
            return x, f, g, done - 1
        longest = 100 * max(float(np.linalg.norm(x)), len(x))
        if (norm := float(np.linalg.norm(direction))) > longest:
            direction, slope = direction * longest / norm, slope * longest / norm
        step, last, last_f = 1.0, 0.0, f
        while True:
            new = x + step * direction
            new_f, new_g = evaluate(new)
            if new_f <= f + 1e-4 * step * slope:
                break
            if step * np.max(np.abs(direction) / np.maximum(np.abs(x), 1.0)) < 1e-12:
                return x, f, g, done
            if last == 0.0:
                cut = -slope * step * step / (2 * (new_f - f - slope * step))
            else:
                r1, r2 = new_f - f - step * slope, last_f - f - last * slope
                a = (r1 / step**2 - r2 / last**2) / (step - last)
                b = (-last * r1 / step**2 + step * r2 / last**2) / (step - last)
                inner = b * b - 3 * a * slope
                cut = -slope / (2 * b) if a == 0 else 0.5 * step if inner < 0 else (-b + math.sqrt(inner)) / (3 * a)
            last, last_f = step, new_f
            step = max(0.1 * step, min(cut, 0.5 * step)) if math.isfinite(cut) else 0.5 * step
        moved, change = new - x, new_g - g
        x, f, g = new, new_f, new_g
        if np.max(np.abs(moved) / np.maximum(np.abs(x), 1.0)) < 4e-8 * max(tolerance / 1e-10, 1e-6):
            return x, f, g, done
        if np.max(np.abs(g) * np.maximum(np.abs(x), 1.0)) / max(f, 1.0) < tolerance:
            return x, f, g, done
        curve = float(change @ moved)
        if curve > math.sqrt(1e-16 * float(change @ change) * float(moved @ moved)):
            v = np.eye(len(x)) - np.outer(moved, change) / curve
            inverse = v @ inverse @ v.T + np.outer(moved, moved) / curve
    return x, f, g, max_rounds


def hessian(gradients, x: np.ndarray, first: float = 1e-2, levels: int = 4) -> np.ndarray:
    """Second derivatives by central differences of the gradient, extrapolated by Richardson's scheme.

    gradients: a list of points -> their gradients, asked once for all steps. The step is relative to a coordinate's size, and
    absolute where it is 0.
    """
    steps = [(i, first * max(abs(x[i]), 0.1) / 2**k) for i in range(len(x)) for k in range(levels)]
    unit = np.eye(len(x))
    found = gradients([x + sign * h * unit[i] for i, h in steps for sign in (1, -1)])
    slopes = [(up - down) / (2 * h) for (_, h), up, down in zip(steps, found[::2], found[1::2], strict=True)]
    out = np.empty((len(x), len(x)))
    for i in range(len(x)):
        row = slopes[i * levels : (i + 1) * levels]
        for k in range(1, levels):
            row = [(4**k * b - a) / (4**k - 1) for a, b in zip(row[:-1], row[1:], strict=True)]
        out[i] = row[0]
    return (out + out.T) / 2


@dataclass(frozen=True)
class Estimate:
    """Coefficients with standard errors, t, two-sided normal p and stars; the likelihood at zero and at the end."""

    rows: list[tuple[str, float, float | None, float | None, float | None, str]]
    at_zero: float
    final: float
    rounds: int
    eigenvalues: list[float]


def stars(p: float | None) -> str:
    return "" if p is None else "***" if p < 0.001 else "**" if p < 0.01 else "*" if p < 0.05 else "." if p < 0.1 else ""


def estimate(
    data: DataFrame, spec: Specification, start: dict[str, float] | None = None, max_rounds: int = 500, routings: list[Routing] | None = None, tolerance: float = 1e-10
) -> Estimate:
    """Fit the free coefficients. The data are kept in blocks for the repeated sums and released at the end.

    With ``routings`` (data then has an ``id``) every trial point of a line search takes the times and attributes of the paths that are
    cheapest at its coefficients; the gradient is that of the accepted point's paths, and the Hessian that of the last ones. A trip without
    a path cannot choose that mode. A singular Hessian leaves the standard errors empty.
    """
    names = spec.coefficients()
    first = np.array([(start or {}).get(n, 0.0) for n in names])
    needed = data.cache() if routings else packed(data, spec)
    try:
        routes = [Routes(r, needed) for r in routings or []]
        at = lambda b: routed(needed, routes, spec.values(b))
        evaluate = lambda b: likelihood(at(b), spec, b) if routes else evaluated(needed, spec, [b])[0]
        zero, _ = evaluate(np.zeros(len(names)))
        x, f, _, rounds = minimise(evaluate, first, tolerance, max_rounds)
        last = at(x).checkpoint() if routes else needed
        several = likelihoods if routes else evaluated
        second = hessian(lambda points: [g for _, g in several(last, spec, points)], x)
    finally:
        needed.unpersist()
    values = np.linalg.eigvalsh(second)
    regular = values.min() > 1e-10 * max(values.max(), 1.0)
    spread = np.sqrt(np.diag(np.linalg.inv(second))) if regular else [None] * len(names)
    rows = []
    for name, b, s in zip(names, x, spread, strict=True):
        t = float(b / s) if s else None
        p = None if t is None else math.erfc(abs(t) / math.sqrt(2))
        rows.append((name, float(b), None if s is None else float(s), t, p, stars(p)))
    return Estimate(rows, -zero, -f, rounds, values.tolist())


def personas(data: DataFrame, conditions: dict[str, str]) -> DataFrame:
    """``(persona, valid array<boolean>, n)``, the distinct combinations of conditions in SQL, numbered by their order.

    A null condition counts as false. There are at most two to the number of conditions.
    """
    valid = F.array(*(F.coalesce(F.expr(c), F.lit(False)) for c in conditions.values()))
    counts = data.groupBy(valid.alias("valid")).agg(F.count("*").alias("n"))
    return counts.withColumn("persona", F.dense_rank().over(Window.orderBy("valid")) - 1).select("persona", "valid", "n")


def persona_weights(found: DataFrame, conditions: dict[str, str], values: dict[str, float]) -> DataFrame:
    """Adds ``weight``, the sum of a persona's valid coefficients; a negative one counts as 0."""
    total = F.lit(0.0)
    for i, name in enumerate(conditions):
        total = total + F.when(F.get("valid", i), values[name]).otherwise(0.0)
    return found.withColumn("weight", F.greatest(F.lit(0.0), total))


def short_trip(mode: str, dist: str | Column | None, ox, oy, dx, dy, longest: float) -> tuple[Column, Column]:
    """(length, seconds) of a trip whose ends snap to one node: the stated distance, or 1.2 straight lines, from 10 m on."""
    speed = {"bike": 5.1, "walk": 1.38}[mode]
    line = 1.2 * F.hypot(dx - ox, dy - oy)
    own = F.col(dist) if isinstance(dist, str) else dist
    length = F.least(F.greatest(line if own is None else F.coalesce(own, line), F.lit(10.0)), F.lit(longest))
    return length, length / speed


def encode_classes(data: DataFrame, label: str, code: str = "code") -> DataFrame:
    """Adds ``code``, the place of a label among the sorted different labels, from 0; a null label has none."""
    names = data.select(label).dropna().distinct()
    coded = names.withColumn(code, F.row_number().over(Window.orderBy(label)) - 1).checkpoint()  # as many rows as classes
    return data.join(F.broadcast(coded) if coded.count() <= MAX_CLASSES else coded, label, "left")


@dataclass(frozen=True)
class StreetAttribute:
    """A route attribute of a model: ``name`` is its coefficient and column; one with a ``base`` counts the base's value where
    ``when`` (SQL on the person) holds."""

    name: str
    base: str | None = None
    when: str | None = None


def street_columns(attributes: list[StreetAttribute]) -> dict[str, Column]:
    """Columns of the attributes on rows with the base attributes' values, precomputed or of rerouted paths.

    A base must come before what builds on it, a name counts once, and a negative value of a base is an error.
    """
    out: dict[str, Column] = {}
    for a in attributes:
        if a.name in out:
            raise ValueError(f"{a.name} is there twice")
        if a.base is None:
            bad = F.raise_error(F.concat(F.lit(f"{a.name} is negative: "), F.col(a.name).cast("string"))).cast("double")
            out[a.name] = F.when(F.col(a.name) < 0, bad).otherwise(F.col(a.name))
        elif a.base not in out:
            raise ValueError(f"{a.base} must come before {a.name}")
        else:
            out[a.name] = F.when(F.coalesce(F.expr(a.when), F.lit(False)), out[a.base]).otherwise(0.0)
    return out


def route_sums(links: DataFrame, asked: DataFrame, draws: DataFrame, bases: list[str]) -> DataFrame:
    """``(draw, origin, target, time, <bases>)`` in minutes along the cheapest path of every pair of ``asked (draw, origin, target)``.

    draws: ``(draw, weights)`` as in :func:`paths.sampled_paths`. A base is the sum of a link's minutes times its value. Pairs without a path
    have no row; where the ends are one node all is 0.
    """
    pairs = asked.select("draw", "origin", "target").distinct()
    routes = sampled_paths(links, pairs, draws, bases).join(pairs, ["draw", "origin", "target"])
    steps = routes.select("draw", "origin", "target", F.posexplode("nodes").alias("k", "a"), "nodes").select("draw", "origin", "target", "a", F.get("nodes", F.col("k") + 1).alias("b"))
    priced = links.select("a", "b", "time", *bases)
    sums = steps.dropna(subset=["b"]).join(priced, ["a", "b"]).groupBy("draw", "origin", "target").agg(
        (F.sum("time") / 60).alias("time"), *((F.sum(F.col("time") * F.col(c)) / 60).alias(c) for c in bases)
    )
    known = routes.select("draw", "origin", "target").join(sums, ["draw", "origin", "target"], "left")
    return known.na.fill(0.0, ["time", *bases])  # no link where the ends are one node


def base_weights(attributes: list[StreetAttribute], valid: list[bool], values: dict[str, float]) -> tuple[float, ...]:
    """The weight of each base attribute for a persona: its coefficient and those of the interactions that hold; a negative sum counts as 0."""
    total = {a.name: 0.0 for a in attributes if a.base is None}
    for a, holds in zip(attributes, valid, strict=True):
        if holds:
            total[a.base or a.name] += float(values[a.name])
    return tuple(max(0.0, v) for v in total.values())


def rerouted(links: DataFrame, trips: DataFrame, data: DataFrame, attributes: list[StreetAttribute], values: dict[str, float]) -> DataFrame:
    """``(id, time, <base attributes>)`` in minutes of the cheapest paths at the present coefficients, one search for each persona.

    links: a, b, time, dist and the base attributes' columns; trips: ``(id, origin, target)``; data: ``(id, ...)`` with what the
    conditions see. A persona weighs a base attribute by :func:`base_weights`. Trips of a persona and pair share a path; those without one
    have no row.
    """
    return Routes(Routing(links, trips, attributes, {a.name: a.name for a in attributes}), data).at(values)


@dataclass(frozen=True)
class Routing:
    """A mode whose time and attributes are those of the paths that its coefficients make cheapest.

    links and trips: see :func:`rerouted`. ``coefficients``: attribute -> name of its coefficient. Where utilities hold products ``c = b g``
    with a cost coefficient b, ``scale`` names b, and an attribute weighs c over b; while b is 0 all weigh nothing. The paths' minutes become
    column ``time`` of the data, an attribute the column of its name behind ``prefix``. ``short``: ``(id, time, <base attributes>)`` of
    trips too short to be routed (:func:`short_trips`).
    """

    links: DataFrame
    trips: DataFrame
    attributes: list[StreetAttribute]
    coefficients: dict[str, str]
    scale: str | None = None
    time: str = "time"
    prefix: str = ""
    short: DataFrame | None = None


class Routes:
    """Paths of a mode at changing coefficients. A persona's paths are kept, and searched anew only for weights that it has not had."""

    def __init__(self, routing: Routing, data: DataFrame):
        self.routing, self.bases = routing, [a.name for a in routing.attributes if a.base is None]
        conditions = {a.name: a.when or "true" for a in routing.attributes}
        found = personas(data, conditions).drop("n").checkpoint()
        self.valid = {r["persona"]: r["valid"] for r in found.collect()}  # at most two to the number of conditions
        holds = F.array(*(F.coalesce(F.expr(c), F.lit(False)) for c in conditions.values()))
        whose = data.select("id", holds.alias("valid")).join(F.broadcast(found), "valid").drop("valid")
        trips = routing.trips if routing.short is None else routing.trips.join(routing.short.select("id"), "id", "left_anti")
        self.asked = trips.select("id", "origin", "target").join(whose, "id").checkpoint()
        self.known: dict[tuple, tuple[DataFrame, int]] = {}  # (persona, weights) -> a table of sums and the draw in it
        self.searches = 0

    def weights(self, values: dict[str, float]) -> dict[int, tuple[float, ...]]:
        """The present weights of each persona."""
        own = {a: values[c] for a, c in self.routing.coefficients.items()}
        if self.routing.scale is not None:
            b = values[self.routing.scale]
            own = {a: v / b if b else 0.0 for a, v in own.items()}
        return {p: base_weights(self.routing.attributes, valid, own) for p, valid in self.valid.items()}

    def _search(self, wanted: dict[int, tuple[float, ...]]) -> None:
        spark = self.asked.sparkSession
        rows = [(p, float(p), list(w)) for p, w in wanted.items()]
        draws = spark.createDataFrame([(p, w) for p, _, w in rows], "draw long, weights array<double>")
        pairs = self.asked.filter(F.col("persona").isin(list(wanted))).select(F.col("persona").cast("long").alias("draw"), "origin", "target")
        found = route_sums(self.routing.links, pairs, draws, self.bases).checkpoint()
        self.searches += len(wanted)
        self.known |= {(p, w): (found, p) for p, w in wanted.items()}

    def at(self, values: dict[str, float]) -> DataFrame:
        """``(id, time, <base attributes>)`` of every trip that has a path at these coefficients."""
        now = self.weights(values)
        if fresh := {p: w for p, w in now.items() if (p, w) not in self.known}:
            self._search(fresh)
        tables: dict[int, tuple[DataFrame, list[int]]] = {}
        for p, w in now.items():
            table, draw = self.known[p, w]
            tables.setdefault(id(table), (table, []))[1].append(draw)
        parts = [table.filter(F.col("draw").isin(drawn)) for table, drawn in tables.values()]
        out = self.asked.limit(0).select("id", *(F.lit(0.0).alias(c) for c in ("time", *self.bases)))
        if parts:
            sums = parts[0]
            for part in parts[1:]:
                sums = sums.unionByName(part)
            out = self.asked.withColumnRenamed("persona", "draw").join(sums, ["draw", "origin", "target"]).select("id", "time", *self.bases)
        return out if self.routing.short is None else out.unionByName(self.routing.short.select("id", "time", *self.bases))

    def columns(self, data: DataFrame, values: dict[str, float]) -> DataFrame:
        """``data (id, ...)`` with the columns of the routing; they are null for trips without a path, which makes the mode unavailable."""
        r = self.routing
        own = self.at(values)
        named = own.select("id", F.col("time").alias("_time"), *(F.col(c).alias(f"_{c}") for c in self.bases))
        out = data.join(named, "id", "left")
        whole = {a.name: F.col(f"_{a.base or a.name}") for a in r.attributes}
        made = {r.prefix + a.name: whole[a.name] if a.when is None else F.when(F.coalesce(F.expr(a.when), F.lit(False)), whole[a.name]).otherwise(whole[a.name] * 0) for a in r.attributes}
        return out.withColumns({r.time: F.col("_time"), **made}).drop("_time", *(f"_{c}" for c in self.bases))


def routed(data: DataFrame, routes: list[Routes], values: dict[str, float]) -> DataFrame:
    """The data at a trial point, with the columns of every routing."""
    for r in routes:
        data = r.columns(data, values)
    return data


def short_trips(trips: DataFrame, reference: DataFrame, links: DataFrame, bases: list[str], mode: str) -> DataFrame:
    """``(id, time, <bases>)`` in minutes of trips whose ends snap to one node, from the links around them.

    trips: ``(id, ox, oy, dx, dy[, dist])``; reference: ``(id, link)``, see :func:`short_trip_links`; links: ``(link, length, <bases>)``. A trip
    is as long as it says or 1.2 straight lines, from 10 m on and at most as long as its links together; it takes the mode's mean speed,
    and meets an attribute as its links do on average by length. Trips without a link have no row.
    """
    around = reference.select("id", "link").distinct().join(links, "link").groupBy("id").agg(
        F.sum("length").alias("_total"), *(F.sum(F.col("length") * F.col(c)).alias(c) for c in bases)
    )
    own = trips.join(around.filter("_total > 0"), "id")
    length, seconds = short_trip(mode, "dist" if "dist" in trips.columns else None, *(F.col(c) for c in ("ox", "oy", "dx", "dy")), F.col("_total"))
    minutes = seconds / 60
    return own.select("id", minutes.alias("time"), *((F.col(c) * minutes / F.col("_total")).alias(c) for c in bases))


def short_trip_links(trips: DataFrame, zone_links: DataFrame | None = None) -> DataFrame:
    """``(id, link)``: the links of the zone that holds both ends of a trip, or else those nearest to its ends.

    trips: ``(id, origin_link, target_link[, origin_zone, target_zone])``; zone_links: ``(zone, link)``.
    """
    nearest = trips.select("id", F.explode(F.array_distinct(F.array("origin_link", "target_link"))).alias("link")).dropna()
    if zone_links is None:
        return nearest
    inside = trips.filter("origin_zone = target_zone").select("id", F.col("origin_zone").alias("zone")).join(zone_links, "zone").select("id", "link")
    return inside.unionByName(nearest.join(inside.select("id").distinct(), "id", "left_anti"))
