"""Public-transport journeys by rounds of boarding: labels by number of vehicles, footpaths between stops, a window of departures, legs.

A journey walks to a stop, rides, may walk to another stop and ride again, and walks to its end. Round k knows the earliest arrivals at
stops with k vehicles, for every departure of a traveller's window at once. All steps are joins on stops, vehicles and time slots with
partial minima, so neither the timetable nor the travellers have to fit a task.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class JourneyParams:
    """Seconds and counts of a search.

    ``slack``: departures from so much before to so much after the wished one, kept inside the day. ``rides``: most vehicles of a
    journey. ``wait``: longest wait at a stop. ``change``: least time between two vehicles. ``longest``: longest time from departure to
    the last stop. ``change_cost``: what a change counts when journeys are compared.
    """

    slack: float = 900.0
    rides: int = 4
    wait: float = 3600.0
    change: float = 0.0
    longest: float = 14_400.0
    change_cost: float = 0.0


LEG = ["trip", "seq", "mode", "vehicle", "from_stop", "to_stop", "start", "end", "seconds", "metres", "wait"]


def _slot(time: Column | str, size: float) -> Column:
    return F.floor((F.col(time) if isinstance(time, str) else time) / size)


def _slots(first: Column, last: Column, size: float) -> Column:
    return F.explode(F.sequence(_slot(first, size), _slot(last, size)))


def _undominated(rows: DataFrame, keys: list[str], value: str, *then: str) -> DataFrame:
    """Rows for which no other row of the keys leaves as late or later and has as small a value or a smaller one; ``then`` breaks ties."""
    before = Window.partitionBy(*keys).orderBy(F.col("leave").desc(), value, *then).rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("_least", F.min(value).over(before)).filter(F.col("_least").isNull() | (F.col(value) < F.col("_least"))).drop("_least")


def _arrivals(boarded: DataFrame, calls: DataFrame, longest: float) -> DataFrame:
    """Earliest arrival at each stop by the vehicles boarded: of a traveller's departures only those count that no later one beats."""
    board = F.min(F.struct("board_seq", "via", "reach", "walk_seconds", "walk_metres", "board_stop", "board_time"))
    first = boarded.groupBy("trip", "leave", "vehicle").agg(board.alias("b")).select("trip", "leave", "vehicle", "b.*")
    riding = _undominated(first, ["trip", "vehicle"], "board_seq")
    onward = calls.select("vehicle", F.col("seq").alias("alight_seq"), F.col("stop").alias("at"), "arrival")
    met = riding.join(onward, "vehicle").filter((F.col("alight_seq") > F.col("board_seq")) & (F.col("arrival") - F.col("leave") <= longest))
    how = F.struct("arrival", "vehicle", "board_seq", "alight_seq", "via", "reach", "walk_seconds", "walk_metres", "board_stop", "board_time")
    return met.groupBy("trip", "leave", "at").agg(F.min(how).alias("h")).select("trip", "leave", "at", "h.*")


def _boardings(ready: DataFrame, calls: DataFrame, wait: float) -> DataFrame:
    """Vehicles that leave a stop within ``wait`` of being ready there. Stops and times meet in slots of that length."""
    leaving = calls.select(
        F.col("stop").alias("board_stop"), F.col("vehicle"), F.col("seq").alias("board_seq"), F.col("departure").alias("board_time"), _slot("departure", wait).alias("slot")
    )
    spread = ready.withColumn("slot", _slots(F.col("ready"), F.col("until"), wait))
    return spread.join(leaving, ["board_stop", "slot"]).filter(F.col("board_time").between(F.col("ready"), F.col("until")))


def _search(calls: DataFrame, asked: DataFrame, access: DataFrame, walks: DataFrame | None, params: JourneyParams) -> list[DataFrame]:
    """The improved arrivals of each round: by traveller, departure and stop the arrival and how it came about. The k-th table has k vehicles."""
    starts = access.join(asked, "trip").select(
        "trip", "earliest", "latest", F.col("stop").alias("board_stop"), F.col("seconds").alias("walk_seconds"), F.col("metres").alias("walk_metres"),
        (F.col("earliest") + F.col("seconds")).alias("ready"), (F.col("latest") + F.col("seconds") + params.wait).alias("until"),
    )
    leave = F.least(F.col("board_time") - F.col("walk_seconds"), F.col("latest"))
    boarded = _boardings(starts, calls, params.wait).withColumn("leave", leave).select(
        "trip", "leave", "vehicle", "board_seq", F.lit(None).cast(calls.schema["stop"].dataType).alias("via"), (F.col("leave") + F.col("walk_seconds")).alias("reach"),
        "walk_seconds", "walk_metres", "board_stop", "board_time",
    )
    rounds, best = [], None
    for k in range(1, params.rides + 1):
        new = _arrivals(boarded, calls, params.longest).withColumn("round", F.lit(k))
        label = ["trip", "at", "leave", "arrival", "round"]
        every = new.select(*label) if best is None else best.unionByName(new.select(*label))
        best = _undominated(every, ["trip", "at"], "arrival", "round").checkpoint()
        found = new.join(best.filter(F.col("round") == k).select("trip", "at", "leave"), ["trip", "at", "leave"], "left_semi").checkpoint()
        if found.isEmpty():
            break
        rounds.append(found)
        if k == params.rides:
            break
        own = F.col("arrival").alias("reach")
        spots = found.select("trip", "leave", F.col("at").alias("via"), F.col("at").alias("board_stop"), own, F.lit(0.0).alias("walk_seconds"), F.lit(0.0).alias("walk_metres"))
        if walks is not None:
            afoot = walks.select(F.col("u").alias("at"), F.col("v").alias("board_stop"), F.col("seconds").alias("walk_seconds"), F.col("metres").alias("walk_metres"))
            spots = spots.unionByName(found.select("trip", "leave", "at", "arrival").join(afoot, "at").select(
                "trip", "leave", F.col("at").alias("via"), "board_stop", (F.col("arrival") + F.col("walk_seconds")).alias("reach"), "walk_seconds", "walk_metres"
            ))
        first = F.min(F.struct("reach", "walk_seconds", "via", "walk_metres")).alias("f")
        ready = spots.groupBy("trip", "leave", "board_stop").agg(first).select("trip", "leave", "board_stop", "f.*")
        ready = ready.withColumn("ready", F.col("reach") + params.change).withColumn("until", F.col("ready") + params.wait)
        boarded = _boardings(ready, calls, params.wait).select(*boarded.columns)
    return rounds


def journeys(
    calls: DataFrame, requests: DataFrame, access: DataFrame, egress: DataFrame, walks: DataFrame | None = None, direct: DataFrame | None = None,
    params: JourneyParams = JourneyParams(),
) -> DataFrame:
    """Legs of the best journey of every request, columns :data:`LEG`.

    calls: ``(vehicle, seq, stop, arrival, departure[, mode, metres])`` of the vehicles, metres counted along the vehicle; requests:
    ``(trip, departure)``; access and egress: ``(trip, stop, seconds, metres)``, the walks from a trip's origin to stops and from
    stops to its end; walks: ``(u, v, seconds, metres)`` between stops; direct: ``(trip, seconds, metres)`` of those who may walk all the way.

    The best journey has the least time from leaving to arriving, plus ``change_cost`` for each change; of equals the one with
    fewer vehicles, then with the departure nearest to the wished one, then the earlier. One leaves just in time for the first vehicle, or at
    the window's end. Legs are numbered from 1: access, rides with the walks between them, egress; ``wait`` stands before a ride. The
    first and the last leg are walks, if of no length; a walk all the way is one leg. A request without a journey, a null trip or a
    null departure has no row; calls with a null are left out, and so are vehicles' calls out of order in time.
    """
    names = calls.columns
    own = calls.select(
        "vehicle", F.col("seq").cast("long").alias("seq"), "stop", F.col("arrival").cast("double").alias("arrival"), F.col("departure").cast("double").alias("departure")
    ).dropna().filter("departure >= arrival")
    wish = F.pmod(F.col("departure").cast("double"), F.lit(86_400.0))
    asked = requests.select("trip", wish.alias("wish")).dropna().withColumns({
        "earliest": F.greatest(F.col("wish") - params.slack, F.lit(0.0)), "latest": F.least(F.col("wish") + params.slack, F.lit(86_399.0))
    })
    ways = [d.select("trip", "stop", F.col("seconds").cast("double").alias("seconds"), F.col("metres").cast("double").alias("metres")).dropna() for d in (access, egress)]
    rounds = _search(own, asked, ways[0], walks, params)
    ends = ways[1].select("trip", F.col("stop").alias("at"), F.col("seconds").alias("out_seconds"), F.col("metres").alias("out_metres"))
    options = [
        r.join(ends, ["trip", "at"]).select("trip", "round", "leave", (F.col("arrival") + F.col("out_seconds")).alias("there"), "at", "arrival", "out_seconds", "out_metres") for r in rounds
    ]
    if direct is not None:
        walk = direct.select("trip", F.col("seconds").cast("double").alias("out_seconds"), F.col("metres").cast("double").alias("out_metres")).dropna().join(asked, "trip")
        options.append(walk.select(
            "trip", F.lit(0).alias("round"), F.col("wish").alias("leave"), (F.col("wish") + F.col("out_seconds")).alias("there"),
            F.lit(None).cast(own.schema["stop"].dataType).alias("at"), F.col("wish").alias("arrival"), "out_seconds", "out_metres",
        ))
    if not options:
        return _no_legs(requests, own)
    every = options[0]
    for o in options[1:]:
        every = every.unionByName(o)
    cost = F.col("there") - F.col("leave") + params.change_cost * F.greatest(F.col("round") - 1, F.lit(0))
    rank = F.struct(cost.alias("c"), "round", F.abs(F.col("leave") - F.col("wish")).alias("off"), "leave", "there", "at", "arrival", "out_seconds", "out_metres")
    best = every.join(asked.select("trip", "wish"), "trip").groupBy("trip").agg(F.min(rank).alias("b")).select("trip", "b.*").checkpoint()
    return _legs(best, rounds, own, calls if {"mode", "metres"} & set(names) else None)


def _no_legs(requests: DataFrame, calls: DataFrame) -> DataFrame:
    kinds = {"trip": requests.schema["trip"].dataType, "vehicle": calls.schema["vehicle"].dataType, "from_stop": calls.schema["stop"].dataType, "to_stop": calls.schema["stop"].dataType, "mode": "string", "seq": "long"}
    return requests.limit(0).select(*(F.lit(None).cast(kinds.get(c, "double")).alias(c) for c in LEG))


def _legs(best: DataFrame, rounds: list[DataFrame], calls: DataFrame, details: DataFrame | None) -> DataFrame:
    """Follow the chosen journeys back, a round at a time."""
    stop, vehicle, nothing = calls.schema["stop"].dataType, calls.schema["vehicle"].dataType, F.lit(None)
    walk = lambda seq, a, b, start, seconds, metres: (
        seq.cast("long").alias("seq"), F.lit("walk").alias("mode"), nothing.cast(vehicle).alias("vehicle"), a.cast(stop).alias("from_stop"), b.cast(stop).alias("to_stop"),
        start.alias("start"), (start + seconds).alias("end"), seconds.alias("seconds"), metres.alias("metres"), F.lit(0.0).alias("wait"),
    )
    none = F.lit(None).cast("long")
    last = F.when(F.col("round") > 0, 3 * F.col("round")).otherwise(1)
    out = best.select("trip", *walk(last, F.col("at"), nothing, F.col("arrival"), F.col("out_seconds"), F.col("out_metres")), none.alias("board_seq"), none.alias("alight_seq"))
    open_ = None
    for k in range(len(rounds), 0, -1):
        here = best.filter(F.col("round") == k).select("trip", "leave", "at")
        open_ = here if open_ is None else open_.unionByName(here)
        steps = open_.join(rounds[k - 1], ["trip", "leave", "at"]).checkpoint()
        ride = steps.select(
            "trip", F.lit(3 * k - 1).cast("long").alias("seq"), F.lit("pt").alias("mode"), "vehicle", F.col("board_stop").alias("from_stop"), F.col("at").alias("to_stop"),
            F.col("board_time").alias("start"), F.col("arrival").alias("end"), (F.col("arrival") - F.col("board_time")).alias("seconds"), F.lit(None).cast("double").alias("metres"),
            (F.col("board_time") - F.col("reach")).alias("wait"), "board_seq", "alight_seq",
        )
        foot = steps if k == 1 else steps.filter("via <> board_stop")
        before = foot.select(
            "trip", *walk(F.lit(3 * k - 2), F.col("via"), F.col("board_stop"), F.col("reach") - F.col("walk_seconds"), F.col("walk_seconds"), F.col("walk_metres")),
            none.alias("board_seq"), none.alias("alight_seq"),
        )
        out = out.unionByName(ride).unionByName(before)
        open_ = steps.select("trip", "leave", F.col("via").alias("at"))
    if details is not None:
        known = details.select("vehicle", F.col("seq").cast("long").alias("board_seq"), *([F.col("mode").alias("kind")] if "mode" in details.columns else []), *([F.col("metres").alias("m0")] if "metres" in details.columns else []))
        out = out.join(known, ["vehicle", "board_seq"], "left")
        if "metres" in details.columns:
            far = details.select("vehicle", F.col("seq").cast("long").alias("alight_seq"), F.col("metres").alias("m1"))
            out = out.join(far, ["vehicle", "alight_seq"], "left").withColumn("metres", F.coalesce("metres", F.col("m1") - F.col("m0")))
        if "mode" in details.columns:
            out = out.withColumn("mode", F.coalesce("kind", "mode"))
    place = F.row_number().over(Window.partitionBy("trip").orderBy("seq")).cast("long")
    return out.withColumn("seq", place).select(*LEG)


def journey_attributes(legs: DataFrame) -> DataFrame:
    """The twelve attributes of a journey, one row a trip.

    Numbers of rides and walks, their seconds and the sum, modes and times leg by leg joined by ``_`` (metres with one digit), the metres of
    access and egress where there is more than one leg, and of all walks. Waits are in no sum.
    """
    walk = F.col("mode") == "walk"
    listed = lambda c, ok: F.array_join(
        F.transform(F.array_sort(F.collect_list(F.when(ok, F.struct("seq", c.alias("v"))))), lambda s: s["v"]), "_"
    )
    total = lambda c, ok: F.coalesce(F.sum(F.when(ok, F.col(c))), F.lit(0.0))
    several = F.count("*") > 1
    return legs.groupBy("trip").agg(
        F.count_if(~walk).alias("rides"), F.count_if(walk).alias("walks"), total("seconds", ~walk).alias("ride_seconds"), total("seconds", walk).alias("walk_seconds"),
        F.sum("seconds").alias("seconds"), listed(F.col("mode"), ~walk).alias("ride_modes"), listed(F.col("seconds").cast("string"), ~walk).alias("ride_times"),
        listed(F.col("seconds").cast("string"), walk).alias("walk_times"), listed(F.format_string("%.1f", "metres"), walk).alias("walk_distances"),
        F.when(several, F.min_by("metres", "seq")).alias("access_metres"), F.when(several, F.max_by("metres", "seq")).alias("egress_metres"),
        total("metres", walk).alias("walk_metres"),
    )


def journey_skim(legs: DataFrame, ends: DataFrame, *modes: str) -> DataFrame:
    """``(o, d, n, seconds, access, egress, wait, changes[, share_<mode>])``, means over the journeys of ``ends (trip, o, d)``.

    A share is the part of the time in vehicles that is spent in that mode; of journeys without a ride it is null.
    """
    walk = F.col("mode") == "walk"
    n, at = F.count("*").over(Window.partitionBy("trip")), F.col("seq")
    own = legs.withColumn("_n", n)
    ride = F.sum(F.when(~walk, F.col("seconds")))
    by_trip = own.groupBy("trip").agg(
        (F.max("end") - F.min("start")).alias("seconds"), F.sum(F.when((at == 1) & (F.col("_n") > 1), F.col("seconds")).otherwise(0.0)).alias("access"),
        F.sum(F.when((at == F.col("_n")) & (F.col("_n") > 1), F.col("seconds")).otherwise(0.0)).alias("egress"), F.sum("wait").alias("wait"),
        F.greatest(F.count_if(~walk) - 1, F.lit(0)).alias("changes"), *((F.coalesce(F.sum(F.when(F.col("mode") == m, F.col("seconds"))), F.lit(0.0)) / ride).alias(f"share_{m}") for m in modes),
    )
    means = [F.avg(c).alias(c) for c in by_trip.columns if c != "trip"]
    return by_trip.join(ends, "trip").groupBy("o", "d").agg(F.count("*").alias("n"), *means)
