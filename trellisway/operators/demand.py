"""Travel demand: trips from origin-destination counts, expansion factors, times of day, departures.

Draws are :func:`..operators.spatial.uniform` numbers of the rows' own keys, so results are reproducible on any cluster.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .paths import costs
from .spatial import nearest_link, uniform

#: Trips a day per trip of the period, and what a truck's trip counts against a car's.
PERIOD_FACTORS = {"AM": 2.58, "IP": 9.159, "PM": 2.75}
TRUCK_SHARE = 2.5

#: First and last hour of each period; the off-peak one goes over midnight.
PERIOD_HOURS = {"AM": (7, 10), "IP": (10, 16), "PM": (16, 19), "OP": (19, 7)}


def period_factors(flows: DataFrame, truck: str = "uc5", external_only: tuple[str, ...] = ("uc1", "uc3")) -> DataFrame:
    """Adds ``daily`` and ``external_only`` to flows ``(period, uc, o, d, trips)``.

    The factor of an unknown period is an error, of a truck class it is divided by the truck's share.
    """
    factor = F.create_map(*(F.lit(x) for pair in PERIOD_FACTORS.items() for x in pair))[F.col("period")]
    factor = F.coalesce(factor, F.raise_error(F.concat(F.lit("unknown period "), F.col("period"))).cast("double"))
    share = F.when(F.col("uc") == truck, TRUCK_SHARE).otherwise(1.0)
    return flows.withColumns({"daily": F.col("trips") * factor / share, "external_only": F.col("uc").isin(*external_only)})


def expand(flows: DataFrame, count: str, *keys: str, scale: float = 1.0) -> DataFrame:
    """One row ``(<flows' columns>, n)`` for each trip of a flow, kept with a probability of ``scale``.

    A fractional count gives its whole part and one more with the chance of the rest. ``keys`` identify a flow. Rows are
    made by the tasks that read the flows; null, zero and negative counts make none.
    """
    whole = F.floor(F.greatest(F.col(count), F.lit(0.0)))
    extra = F.when(uniform(*keys, F.lit("rest")) < F.col(count) - whole, 1).otherwise(0)
    total = (whole + extra).cast("int")
    made = flows.withColumn("n", F.explode(F.when(total > 0, F.sequence(F.lit(1), total))))
    return made.filter(uniform(*keys, "n", F.lit("keep")) < scale) if scale < 1 else made


def cumulative_density(minutes: DataFrame) -> DataFrame:
    """``(minute, weight, low, high)``, each minute's part of [0, 1) from ``(minute, weight)``; at most 1,440 rows."""
    upto = Window.orderBy("minute").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    share = F.sum("weight").over(upto) / F.sum("weight").over(Window.partitionBy(F.lit(1)))
    return minutes.withColumn("high", share).withColumn("low", F.coalesce(F.lag("high").over(Window.orderBy("minute")), F.lit(0.0)))


def period_density(minutes: DataFrame) -> DataFrame:
    """``(period, minutes array<struct<high, minute>>)``, the cumulative density within the hours of every period.

    Minutes of the period that goes over midnight come in the order in which they pass.
    """
    hours = F.create_map(*(x for p, (a, b) in PERIOD_HOURS.items() for x in (F.lit(p), F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")))))
    hour = F.floor(F.col("minute") / 60)
    every = minutes.select("minute", "weight", F.explode(hours).alias("period", "h"))
    wraps = F.col("h.a") > F.col("h.b")
    inside = F.when(wraps, (hour >= F.col("h.a")) | (hour < F.col("h.b"))).otherwise((hour >= F.col("h.a")) & (hour < F.col("h.b")))
    own = every.filter(inside).withColumn("place", F.pmod(F.col("minute") - F.col("h.a") * 60, F.lit(1440)))
    order = Window.partitionBy("period").orderBy("place")
    total = F.sum("weight").over(Window.partitionBy("period"))
    high = F.sum("weight").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)) / total
    rows = own.select("period", F.struct(high.alias("high"), "minute").alias("m"))
    return rows.groupBy("period").agg(F.array_sort(F.collect_list("m")).alias("minutes"))


def sample_times(trips: DataFrame, minutes: DataFrame, *keys: str) -> DataFrame:
    """Adds ``seconds`` of the day to trips ``(period, ...)``: a minute by inverse density, and a second in it.

    The density is four rows of at most 1,440 minutes, each with the places at which 1,024 shares of it begin. A trip looks up its share and
    then at the few minutes of it; there is no range join.
    """
    shares = 1024
    begins = F.transform(F.sequence(F.lit(0), F.lit(shares)), lambda k: F.size(F.filter("minutes", lambda m: m["high"] <= k / shares)) + 1)
    density = F.broadcast(period_density(minutes).withColumn("_begins", begins))
    drawn = trips.withColumn("_u", uniform(*keys, F.lit("minute"))).join(density, "period")
    share = F.floor(F.col("_u") * shares).cast("int")
    first, last = F.get("_begins", share), F.get("_begins", share + 1)
    minute = F.get(F.filter(F.slice("minutes", first, last - first + 1), lambda m: m["high"] > F.col("_u")), 0)["minute"]
    second = F.floor(uniform(*keys, F.lit("second")) * 60)
    return drawn.withColumn("seconds", (minute * 60 + second).cast("bigint")).drop("_u", "minutes", "_begins")


def departure(seconds: str | Column, free_time: str | Column) -> Column:
    """Start of a trip whose middle is at a time of the day: half the free-flow time earlier, wrapped into the day."""
    at = F.col(seconds) if isinstance(seconds, str) else seconds
    free = F.col(free_time) if isinstance(free_time, str) else free_time
    return F.pmod(at - free / 2, F.lit(86400.0))


def gate(trips: DataFrame) -> DataFrame:
    """Adds ``kind``: internal, entry, exit or through, by ``origin_inside`` and ``target_inside``."""
    o, t = F.col("origin_inside"), F.col("target_inside")
    return trips.withColumn("kind", F.when(o & t, "internal").when(t, "entry").when(o, "exit").otherwise("through"))


def gated_plans(trips: DataFrame, links: DataFrame, inside: Callable[[Column, Column], Column], cell: float, max_links: int | None = None) -> DataFrame:
    """Adds ``origin_link``, ``target_link`` and ``start`` to trips ``(id, seconds, ox, oy, dx, dy, ...)``.

    links: ``(link, a, b, time, ax, ay, bx, by, internal, entry, exit)``. An end inside the network's boundary lies on the nearest internal link;
    an origin outside comes in by the nearest entry link, and a target outside is left for by the nearest exit link. ``inside(x, y)``
    says what is inside. The trip's middle is at ``seconds``: it starts half its time on the network earlier, from the start of its first
    link to the end of its last, wrapped into the day. Without a way, or a link of the kind, ``start`` is null; so are the links of an end
    without coordinates. Ends at one place are looked up once, and ways between one pair of nodes are searched once.
    """
    place = lambda x, y: F.concat_ws(",", F.col(x).cast("string"), F.col(y).cast("string"))
    kind = lambda x, y, outside: F.when(inside(F.col(x), F.col(y)), "internal").otherwise(outside)
    own = trips.withColumns({"_o": place("ox", "oy"), "_d": place("dx", "dy"), "_ok": kind("ox", "oy", "entry"), "_dk": kind("dx", "dy", "exit")})
    ends = own.select(F.col("_o").alias("point"), F.col("ox").alias("x"), F.col("oy").alias("y"), F.col("_ok").alias("kind")).unionByName(
        own.select(F.col("_d").alias("point"), F.col("dx").alias("x"), F.col("dy").alias("y"), F.col("_dk").alias("kind"))
    ).dropna().distinct().checkpoint()
    found = None
    for name in ("internal", "entry", "exit"):
        near = nearest_link(ends.filter(F.col("kind") == name), links.filter(F.col(name)), cell).select("point", F.lit(name).alias("kind"), F.col("best").alias("link"))
        found = near if found is None else found.unionByName(near)
    found = found.checkpoint()
    side = lambda p, k, link: found.select(F.col("point").alias(p), F.col("kind").alias(k), F.col("link").alias(link))
    placed = own.join(side("_o", "_ok", "origin_link"), ["_o", "_ok"], "left").join(side("_d", "_dk", "target_link"), ["_d", "_dk"], "left").select(*trips.columns, "origin_link", "target_link").checkpoint()
    pairs = placed.select("origin_link", "target_link").dropna().distinct()
    pairs = pairs.join(links.select(F.col("link").alias("origin_link"), F.col("a").alias("origin")), "origin_link").join(links.select(F.col("link").alias("target_link"), F.col("b").alias("target")), "target_link")
    times = costs(links.select("a", "b", F.col("time").alias("cost")), pairs.select("origin", "target"), max_links)
    known = pairs.join(times.select("origin", "target", F.col("cost").alias("_free")), ["origin", "target"]).select("origin_link", "target_link", "_free")
    return placed.join(known, ["origin_link", "target_link"], "left").select(*trips.columns, "origin_link", "target_link", departure("seconds", "_free").alias("start"))


def sample_population(people: DataFrame, share: float, *keys: str) -> DataFrame:
    """Rows kept with a probability, by their keys."""
    return people.filter(uniform(*keys, F.lit("population")) < share)
