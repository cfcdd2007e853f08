"""Link-level column expressions: gradients, speeds, travel times, stress, ambience and generalised costs.

All functions take column names or Columns and give Columns, so they stay inside whole-stage code generation. Unknown
numbers are NULL (never NaN), and comparisons with them are false, as the formulas ask.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

MPH_PER_KPH = 0.621371
PCU = 0.865

# Share of comfort that a surface leaves.
COMFORT = {
    "paved": 1.0, "asphalt": 1.0, "concrete": 1.0, "concrete:lanes": 0.95, "concrete_plates": 0.90, "concrete:plates": 0.90,
    "fine_gravel": 0.90, "paving_stones": 0.80, "paving_stones:35": 0.80, "paving_stones:30": 0.80, "compacted": 0.70,
    "unpaved": 0.60, "gravel": 0.60, "ground": 0.60, "bricks": 0.60, "asphalt;paving_stones:35": 0.60, "sett": 0.50,
    "cobblestone;flattened": 0.50, "cobblestone:flattened": 0.50, "cobblestone": 0.40, "stone": 0.40, "grass": 0.40,
    "compressed": 0.40, "paving_stones:3": 0.40, "cobblestone (bad)": 0.30, "dirt": 0.30, "earth": 0.30, "wood": 0.30,
    "pebblestone": 0.30, "sand": 0.30, "null": 1.0,
}

# Share of the bicycle's speed that a surface leaves.
BIKE_SURFACE = {
    "paved": 1.0, "asphalt": 1.0, "concrete": 0.9, "asphalt;paving_stones:35": 0.9, "compacted": 0.9, "concrete:lanes": 0.8,
    "concrete_plates": 0.8, "concrete:plates": 0.8, "paving_stones:3": 0.8, "paving_stones": 0.7, "paving_stones:35": 0.7,
    "paving_stones:30": 0.7, "compressed": 0.7, "bricks": 0.7, "stone": 0.7, "pebblestone": 0.7, "fine_gravel": 0.7,
    "gravel": 0.7, "ground": 0.7, "cobblestone;flattened": 0.6, "cobblestone:flattened": 0.6, "sett": 0.6, "earth": 0.6,
    "cobblestone (bad)": 0.4, "grass": 0.4, "sand": 0.2,
}

Col = Column | str


def _c(x: Col | float) -> Column:
    return F.col(x) if isinstance(x, str) else x if isinstance(x, Column) else F.lit(float(x))


def clamp(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def _lookup(key: Col, table: Mapping[str, float], default: float) -> Column:
    """CASE by value, values of one number together."""
    case = None
    for value in dict.fromkeys(table.values()):
        hit = _c(key).isin([k for k, v in table.items() if v == value])
        case = F.when(hit, F.lit(value)) if case is None else case.when(hit, F.lit(value))
    return case.otherwise(F.lit(default))


def gradient(z_from: Col, z_to: Col, length: Col) -> Column:
    """F01. Rise over length; 0 if a height is unknown or the link has no length."""
    return F.coalesce((_c(z_to) - _c(z_from)) / F.nullif(_c(length), F.lit(0.0)), F.lit(0.0))


def walk_time(length: Col, grad: Col) -> Column:
    """F02. Seconds on foot by Tobler's function, gradients limited to 1."""
    return 3 * _c(length) / (5 * F.exp(-3.5 * F.abs(clamp(_c(grad), -1.0, 1.0) + 0.05)))


def bike_gradient_factor(grad: Col) -> Column:
    """F04, F07. Uphill the speed falls by five times the gradient, to a tenth at least."""
    return F.when(_c(grad) > 0, F.greatest(F.lit(0.1), 1 - 5 * _c(grad))).otherwise(F.lit(1.0))


def bike_surface_factor(surface: Col, way_type: Col) -> Column:
    """F05. 1 on cycleways, without a way type and without a surface; other labels 0.5, the label 'null' too."""
    free = _c(way_type).isNull() | (_c(way_type) == "cycleway") | _c(surface).isNull()
    return F.when(free, F.lit(1.0)).otherwise(_lookup(surface, BIKE_SURFACE, 0.5))


def bike_speed(max_speed: Col | float, infra: Col, surface: Col, way_type: Col, grad: Col, freespeed: Col) -> Column:
    """F03, F06."""
    own = _c(max_speed) * F.coalesce(_c(infra), F.lit(1.0)) * bike_surface_factor(surface, way_type) * bike_gradient_factor(grad)
    return F.least(own, _c(freespeed))


def bike_speed_gradient_only(max_speed: Col | float, grad: Col, freespeed: Col) -> Column:
    """F07."""
    return F.least(_c(max_speed) * bike_gradient_factor(grad), _c(freespeed))


def bike_time(length: Col, speed: Col, dismount: Col, walk: Col, stress: Col | None = None, threshold: float | None = None) -> Column:
    """F08. Walking time where one dismounts, and where the stress is over a threshold, if one is given."""
    on_foot = F.coalesce(_c(dismount), F.lit(False))
    if threshold is not None and stress is not None:
        on_foot = on_foot | F.coalesce(_c(stress) > threshold, F.lit(False))
    return F.when(on_foot, _c(walk)).otherwise(_c(length) / _c(speed))


def protection(cycleosm: Col, cycleway: Col, walk_or_bike: Col) -> Column:
    """F11. KERBED, PROTECTED, LANE or MIXED; NULL where neither walking nor cycling is allowed."""
    osm = F.coalesce(_c(cycleosm), F.lit("null"))
    way = F.coalesce(_c(cycleway), F.lit("null"))
    return F.when(
        _c(walk_or_bike),
        F.when(osm.isin("offroad", "kerbed"), "KERBED").when(osm == "protected", "PROTECTED").when(osm == "painted", "LANE")
        .when(osm == "integrated", "MIXED").when(way == "track", "PROTECTED").when(way.isin("share_busway", "lane"), "LANE").otherwise("MIXED"),
    )


def crossing_type(crossing: Col) -> Column:
    """F12."""
    c = F.coalesce(_c(crossing), F.lit("null"))
    return (
        F.when(c == "null", "UNCONTROLLED").when(c.isin("Parallel crossing point", "crossing point"), "ZEBRA")
        .when(c == "Car signal", "SIGNAL_MIXED").otherwise("SIGNAL_ACTIVE")
    )


def effective_speed(limit_mph: Col, percentile_kph: Col) -> Column:
    """Speed limit in mph, or the 85th percentile where that is 10 % higher."""
    seen = _c(percentile_kph) * MPH_PER_KPH
    return F.when(seen >= _c(limit_mph) * 1.1, seen).otherwise(_c(limit_mph))


def freight_factor(hgv_pois: Col, length: Col) -> Column:
    """F13."""
    return F.least(F.lit(1.0), 24 * _c(hgv_pois) / F.nullif(_c(length), F.lit(0.0)))


def link_stress(mode: str, allowed: Col, allows_car: Col, junction: Col, limit: Col, percentile: Col, aadt: Col, kind: Col, hgv: Col, length: Col) -> Column:
    """F14. 0 to 1; NULL where the mode is not allowed."""
    v, a, k = effective_speed(limit, percentile), _c(aadt) * PCU, _c(kind)
    protected = F.lit(mode == "walk") | (k == "PROTECTED")
    own = (
        F.when(k == "KERBED", F.lit(0.0)).when(protected, -1.5 + 0.05 * v)
        .when(k == "LANE", -1.625 + 0.0625 * v + 0.000125 * a).otherwise(-1.25 + 0.0583 * v + 0.000167 * a)
    )
    ring = F.lit(mode == "bike") & F.coalesce(_c(junction).isin("roundabout", "circular"), F.lit(False))
    value = F.when(~_c(allows_car), F.lit(0.0)).when(ring, F.lit(1.0)).otherwise(clamp(own + 0.2 * freight_factor(hgv, length), 0.0, 1.0))
    return F.when(_c(allowed), value)


def link_stress_discrete(allowed: Col, allows_car: Col, junction: Col, limit: Col, percentile: Col, aadt: Col, kind: Col) -> Column:
    """F15. GREEN, AMBER or RED by bands of speed, traffic and protection; NULL where cycling is not allowed."""
    v, a, k = effective_speed(limit, percentile), _c(aadt) * PCU, _c(kind)

    def traffic(red: float | None, amber: float | None, rest: str) -> Column:
        case = F.when(a >= red, "RED") if red is not None else F.when(F.lit(False), "RED")
        return (case.when(a >= amber, "AMBER") if amber is not None else case).otherwise(rest)

    calm = F.when(k == "LANE", traffic(None, 4000, "GREEN")).when(k == "MIXED", traffic(4000, 2000, "GREEN"))
    town = F.when(k == "LANE", traffic(4000, None, "AMBER")).when(k == "MIXED", traffic(2000, None, "AMBER"))
    road = F.when(k.isin("LANE", "MIXED"), "RED").when(k == "PROTECTED", "AMBER")
    fast = F.when(k != "KERBED", "RED")
    band = F.when(v <= 21.75, calm).when(v <= 31.07, town).when(v <= 40.39, road).otherwise(fast)
    ring = F.coalesce(_c(junction).isin("roundabout", "circular"), F.lit(False))
    return F.when(_c(allowed), F.when(~_c(allows_car), "GREEN").when(ring, "RED").otherwise(F.coalesce(band, F.lit("GREEN"))))


def junction_stress(crossed: Col, kind: Col, limit: Col, percentile: Col, aadt: Col, lanes: Col, stress: Col) -> Column:
    """F16. 0 to 1 by the crossing's kind, and 0 where no vehicles are crossed; unknown traffic counts as 800."""
    v, a, n = effective_speed(limit, percentile), F.coalesce(_c(aadt) * PCU, F.lit(800.0)), _c(lanes)
    k = _c(kind)
    plain = F.when(v < 60, a / (300 * v + 16500) + v / 90 + n / 3 - 0.5).otherwise(F.lit(1.0))
    zebra = F.when(v <= 30, a / 24000 + n / 3 - 2 / 3).otherwise(v / 90 + 1 / 3)
    mixed = F.when(v < 60, _c(stress)).otherwise(F.lit(1.0))
    active = F.when(v < 60, F.lit(0.0)).otherwise(F.lit(1.0))
    value = F.when(k == "UNCONTROLLED", plain).when(k == "ZEBRA", zebra).when(k == "SIGNAL_MIXED", mixed).otherwise(active)
    return F.when(_c(crossed), clamp(value, 0.0, 1.0)).otherwise(F.lit(0.0))


def junction_share(cross_width: Col, length: Col, stress: Col) -> Column:
    """F17. Junction stress by the share of the link that the crossing takes."""
    return F.coalesce(F.least(_c(length), _c(cross_width)) / F.nullif(_c(length), F.lit(0.0)), F.lit(0.0)) * _c(stress)


def darkness(primary: Col, lights: Col, length: Col) -> Column:
    """F18."""
    return 1 - F.least(F.lit(1.0), F.when(_c(primary), F.lit(30.0)).otherwise(F.lit(15.0)) * _c(lights) / _c(length))


def ambience(vgvi: Col, shannon: Col, pois: Col, neg_pois: Col, crime: Col, length: Col, night: bool = False, dark: Col | None = None) -> Column:
    """F18 to F20. 0 (pleasant) to 1; counts are factors per length. At night greenery counts half and darkness is added."""
    poi = F.least(F.lit(1.0), 5 * _c(pois) / _c(length))
    neg = F.least(F.lit(1.0), 5 * _c(neg_pois) / _c(length))
    offence = F.least(F.lit(1.0), 4 * _c(crime) / _c(length))
    variety = F.least(F.lit(1.0), _c(shannon) / 1.6)
    return ambience_of(vgvi, variety, poi, neg, offence, night, dark)


def ambience_of(vgvi: Col, variety: Col, poi: Col, neg: Col, offence: Col, night: bool = False, dark: Col | None = None) -> Column:
    """F19, F20 from factors between 0 and 1."""
    lively = F.least(F.lit(0.5), 0.5 * _c(poi) + 0.5 * _c(variety))
    value = 0.5 - ((0.25 if night else 0.5) * _c(vgvi) + lively) + 0.5 * _c(neg) + 0.5 * _c(offence)
    if night:
        value = value + 0.25 * _c(dark)
    return clamp(value, 0.0, 1.0)


def comfort(surface: Col) -> Column:
    """F21. What a surface lacks in comfort; unknown labels 0.15."""
    return 1 - _lookup(F.coalesce(_c(surface), F.lit("null")), COMFORT, 0.85)


@dataclass(frozen=True)
class CompositeWeights:
    """F25. Marginal costs of the composite disutility, per mode by default."""

    gradient: float
    comfort: float
    ambience: float
    stress: float

    @classmethod
    def of(cls, mode: str) -> CompositeWeights:
        return {"walk": cls(4.0, 0.0, 3.0, 1.0), "bike": cls(15.0, 0.15, 1.0, 3.0)}[mode]


def composite_cost(w: CompositeWeights, time: Col, grad: Col, rough: Col, ambient: Col, stress: Col, cross_width: Col, length: Col, jct: Col) -> Column:
    """F24, F26. Time weighted by steepness, surface, ambience and stress, and the stress of the junction at its end."""
    t = _c(time)
    link = t * (1 + w.gradient * clamp(_c(grad), 0.0, 0.5) + w.comfort * _c(rough) + w.ambience * _c(ambient) + w.stress * _c(stress))
    return link + junction_cost(w, time, cross_width, length, jct)


def junction_cost(w: CompositeWeights, time: Col, cross_width: Col, length: Col, jct: Col) -> Column:
    """F26. The junction's part of the composite cost."""
    return w.stress * _c(time) * junction_share(cross_width, length, jct)


def weighted_cost(time: Col, attributes: Sequence[tuple[Col, float]]) -> Column:
    """F27. ``time * (1 + sum of weight * attribute)``; weights are 0 or more."""
    if any(weight < 0 for _, weight in attributes):
        raise ValueError("weights must not be negative")
    total = F.lit(1.0)
    for column, weight in attributes:
        total = total + weight * _c(column)
    return _c(time) * total


def marginal(value: Col, junction: Col | float, length: Col) -> Column:
    """G19. Cost or time per metre, without the junction's part."""
    return (_c(value) - _c(junction)) / F.nullif(_c(length), F.lit(0.0))


def vgvi_or_ndvi(vgvi: Col, ndvi: Col) -> Column:
    """Visible greenery, or its estimate from the vegetation index, an unknown index counting as 0."""
    return F.coalesce(_c(vgvi), 0.0293269 + 1.0927493 * F.coalesce(_c(ndvi), F.lit(0.0)))


def congested_capacity(capacity: Col, road: Col, length: Col) -> Column:
    """F30. 70 % on primary and secondary roads, and twice on links under 100 m."""
    scaled = F.when(_c(road).isin("primary", "secondary"), 0.7 * _c(capacity)).otherwise(_c(capacity))
    return F.when(_c(length) < 100, 2 * scaled).otherwise(scaled)


def urban_freespeed(freespeed: Col, urban: Col) -> Column:
    """F30. Three quarters of the free speed on urban links; an unknown place is not urban."""
    return F.when(F.coalesce(_c(urban), F.lit(False)), 0.75 * _c(freespeed)).otherwise(_c(freespeed))


def street_attributes(
    gradient: Col = "gradient", vgvi: Col = "vgvi", stress_link: Col = "stress_link", stress_jct: Col = "stress_jct", cross_width: Col = "cross_width",
    length: Col = "length", limit_mph: Col | None = "limit_mph", freespeed: Col = "freespeed",
) -> dict[str, Column]:
    """F32. What a mode-choice model sees of a street: steepness up, missing greenery, stresses, and speed as a share of 50 mph.

    Without a speed limit the free speed in m/s stands for it.
    """
    speed = _c(freespeed) / 22.35 if limit_mph is None else _c(limit_mph) / 50
    return {
        "grad": clamp(_c(gradient), 0.0, 0.5), "vgvi": F.greatest(F.lit(0.0), 0.81 - _c(vgvi)), "stress_link": _c(stress_link),
        "stress_jct": junction_share(cross_width, length, stress_jct), "speed": F.least(F.lit(1.0), speed),
    }


#: Factors of the plain set of route attributes, and of the two weighted sets.
PLAIN_FACTORS = ("vgvi", "darkness", "shannon_factor", "crime", "poi", "neg_poi", "freight_poi", "ambience", "stress_link")
WEIGHTED_FACTORS = ("comfort", "vgvi", "darkness", "shannon_factor", "shannon", "crime", "poi", "neg_poi", "ambience", "stress_link")


def attribute_set(kind: str) -> dict[str, Column]:
    """F28. Route attributes of a link by name, to be summed over a path's links: ``plain``, ``time`` or ``distance``.

    plain: factors times length, and the junction's stress. The two others weigh factors and the steepness up by the time or
    the length, count places as they are, and weigh a junction's stress by the crossed part of the link, nothing where no
    vehicles are crossed. Columns: length, time, gradient, those of the factors, pois, neg_pois, stress_jct, crosses, cross_width.
    """
    if kind == "plain":
        return {name: _c(name) * _c("length") for name in PLAIN_FACTORS} | {"stress_jct": _c("stress_jct")}
    if kind not in ("time", "distance"):
        raise ValueError(f"unknown set {kind}")
    weight = _c("time" if kind == "time" else "length")
    part = F.least(_c("cross_width") / F.nullif(_c("length"), F.lit(0.0)), F.lit(1.0))
    crossed = F.when(_c("crosses"), _c("stress_jct") * weight * F.coalesce(part, F.lit(0.0))).otherwise(0.0)
    return {
        "gradient": clamp(_c("gradient"), 0.0, 0.5) * weight, **{name: _c(name) * weight for name in WEIGHTED_FACTORS},
        "poi_count": _c("pois"), "neg_poi_count": _c("neg_pois"), "stress_jct": crossed,
    }
