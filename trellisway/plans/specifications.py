"""Mode-choice specifications by city and purpose, and the cost weights of their skims."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.link import weighted_cost
from ..operators.access import skim
from ..operators.choice import Specification

ALTERNATIVES = ("carD", "carP", "pt", "bike", "walk")


@dataclass(frozen=True)
class Purpose:
    """Names separated by spaces: demographic columns, street attributes of the two modes, and coefficients that stay 0.

    Coefficients of carD always stay 0, and with ``no_bike`` those of the bicycle too.
    """

    people: str
    bike: str = ""
    walk: str = ""
    fixed: str = ""
    no_bike: bool = False


# The published model structures.
PURPOSES = {
    ("manchester", "HBW"): Purpose(
        "p.age_group_agg_15_24 p.age_group_agg_40_54 p.age_55up p.female hh.cars_gr_0 hh.cars_gr_2 hh.cars_gr_3 hh.income_agg_high",
        "grad stressLink stressLink_f", "vgvi stressJct", "carP_p.age_55up walk_p.age_group_agg_40_54 walk_p.age_55up",
    ),
    ("manchester", "HBE"): Purpose(
        "p.age_group_agg_15_24 p.female hh.cars_gr_0 hh.cars_gr_2 hh.cars_gr_3 hh.cars_gr_23", "stressLink", "stressJct",
        "carP_hh.cars_gr_0 carP_hh.cars_gr_23 pt_hh.cars_gr_23 bike_hh.cars_gr_2 bike_hh.cars_gr_3 walk_hh.cars_gr_23",
    ),
    ("manchester", "HBD"): Purpose(
        "p.age_group_agg_5_14 p.age_group_agg_15_24 p.age_group_agg_40_69 p.age_group_agg_70 p.female p.occupation_worker hh.cars_gr_0 hh.cars_gr_2 "
        "hh.cars_gr_3 hh.income_agg_high t.full_purpose_HBR t.full_purpose_HBO",
        "grad stressLink stressLink_c", "vgvi stressJct speed speed_c speed_o",
        "carP_p.age_group_agg_5_14 carP_hh.income_agg_high carP_t.full_purpose_HBO bike_p.age_group_agg_40_69",
    ),
    ("manchester", "HBDdisability"): Purpose(
        "p.age_group_agg_5_14 p.age_group_agg_15_24 p.age_group_agg_40_69 p.age_group_agg_70 p.female p.occupation_worker p.disability_lot hh.cars_gr_0 "
        "hh.cars_gr_2 hh.cars_gr_3 hh.income_agg_high t.full_purpose_HBR t.full_purpose_HBO",
        "grad stressLink stressLink_c", "vgvi stressJct stressJct_d speed",
        "carP_p.age_group_agg_5_14 carP_hh.income_agg_high carP_t.full_purpose_HBO bike_p.age_group_agg_40_69",
    ),
    ("manchester", "HBA"): Purpose(
        "p.age_group_agg_5_24 p.age_group_agg_40_69 p.age_group_agg_70 p.female p.occupation_worker hh.cars_gr_0 hh.cars_gr_2 hh.cars_gr_3", "", "vgvi",
        "pt_hh.cars_gr_2 pt_hh.cars_gr_3 bike_hh.cars_gr_0 bike_hh.cars_gr_2 bike_hh.cars_gr_3 bike_p.female walk_hh.cars_gr_2 pt_p.age_group_agg_5_24 "
        "pt_p.age_group_agg_40_69 pt_p.age_group_agg_70 bike_p.age_group_agg_5_24 bike_p.age_group_agg_40_69 bike_p.age_group_agg_70 bike_p.occupation_worker",
    ),
    ("manchester", "NHBW"): Purpose(
        "p.age_group_agg_15_24 p.female hh.cars_gr_0 hh.cars_gr_23 hh.income_agg_high", "", "",
        "pt_p.female carP_p.female walk_p.age_group_agg_15_24 walk_hh.cars_gr_23 carP_hh.income_agg_high", no_bike=True,
    ),
    ("manchester", "NHBO"): Purpose(
        "p.age_group_agg_5_14 p.age_group_agg_15_24 p.age_group_agg_40_69 p.age_group_agg_70 p.female p.occupation_worker hh.cars_gr_0 hh.cars_gr_23", "", "speed",
        "carP_p.age_group_agg_5_14 carP_hh.cars_gr_0 bike_p.age_group_agg_5_14 bike_p.age_group_agg_15_24 bike_p.age_group_agg_40_69 bike_p.age_group_agg_70 "
        "pt_p.age_group_agg_40_69 pt_p.age_group_agg_70 bike_hh.cars_gr_0 bike_hh.cars_gr_23 bike_p.female bike_p.occupation_worker carP_hh.cars_gr_23 "
        "walk_hh.cars_gr_23 carP_p.age_group_agg_40_69 carP_p.age_group_agg_70 walk_p.occupation_worker walk_p.female pt_p.female",
    ),
    ("melbourne", "HBW"): Purpose(
        "age_gr_under16 age_gr_40_54 age_gr_55up female hhcars_0 hhcars_2 hhcars_3", "stressLink stressLink_f", "speed", "carP_age_gr_under16"
    ),
    ("melbourne", "HBE"): Purpose(
        "age_gr_under16 female hhcars_0 hhcars_2 hhcars_3", "grad stressLink", "speed", "carP_age_gr_under16 bike_hhcars_0 carP_hhcars_2 walk_hhcars_2 walk_hhcars_3"
    ),
    ("melbourne", "HBD"): Purpose(
        "age_gr_under16 age_gr_16_24 age_gr_45_64 age_gr_65up female shopping_trip recreation_trip hhcars_0 hhcars_2 hhcars_3",
        "grad stressLink stressLink_c", "vgvi speed speed_c speed_e", "carP_age_gr_under16 walk_age_gr_45_64",
    ),
    ("melbourne", "HBR"): Purpose(
        "age_gr_under16 age_gr_45_64 age_gr_65up female hhcars_0 hhcars_2 hhcars_23 hhcars_3", "grad grad_f grad_c stressLink stressLink_f stressLink_c",
        "vgvi speed speed_c",
        "carP_age_gr_under16 walk_hhcars_2 walk_hhcars_23 bike_hhcars_23 pt_hhcars_23 carP_hhcars_2 carP_hhcars_3 bike_stressLink",
    ),
    ("melbourne", "HBSO"): Purpose(
        "age_gr_under16 age_gr_45_64 age_gr_65up female shopping_trip hhcars_0 hhcars_2 hhcars_3", "grad stressLink", "speed", "carP_age_gr_under16"
    ),
    ("melbourne", "HBA"): Purpose(
        "age_gr_under16 age_gr_40_54 age_gr_55up female hhcars_0 hhcars_23", "grad", "",
        "carP_age_gr_under16 carP_age_gr_55up bike_age_gr_40_54 bike_hhcars_0 walk_hhcars_0",
    ),
    ("melbourne", "NHBW"): Purpose(
        "age_gr_under25 age_gr_40_54 age_gr_55up female hhcars_0 hhcars_2 hhcars_3 hhcars_23", "stressLink", "speed",
        "bike_age_gr_under25 carP_hhcars_23 pt_hhcars_23 bike_hhcars_23 walk_hhcars_0 walk_hhcars_2 walk_hhcars_3",
    ),
    ("melbourne", "NHBO"): Purpose(
        "age_gr_under16 age_gr_45_64 age_gr_65up female hhcars_0 hhcars_2 hhcars_3 hhcars_23", "stressLink", "speed",
        "carP_age_gr_under16 carP_hhcars_23 pt_hhcars_2 pt_hhcars_3 bike_hhcars_2 bike_hhcars_3 walk_hhcars_2 walk_hhcars_3 walk_hhcars_23 pt_hhcars_23",
    ),
}

# Weights of (gradient, link stress) for the bicycle and of (vgvi gap, speed, junction stress) for walking.
SKIM_WEIGHTS = {
    ("manchester", "HBW", "bike"): (35.9032908, 2.3084587), ("manchester", "HBW", "bike_f"): (35.9032908, 2.3084587 + 2.7762033),
    ("manchester", "HBW", "walk"): (0.3307472, 0.0, 4.9887390), ("manchester", "HBE", "bike"): (0.0, 4.3075357),
    ("manchester", "HBE", "walk"): (0.0, 0.0, 1.0037846), ("manchester", "HBD", "bike"): (57.0135325, 1.2411983),
    ("manchester", "HBD", "bike_c"): (57.0135325, 1.2411983 + 6.4243251), ("manchester", "HBD", "walk"): (0.7789561, 0.4479527, 5.8219067),
    ("manchester", "HBD", "walk_c"): (0.7789561, 0.4479527 + 2.0418898, 5.8219067), ("manchester", "HBD", "walk_o"): (0.7789561, 0.4479527 + 0.3715017, 5.8219067),
    ("manchester", "HBA", "walk"): (0.6908324, 0.0, 0.0), ("manchester", "NHBO", "walk"): (0.0, 3.4485883, 0.0),
    ("melbourne", "HBW", "bike"): (0.0, 1.1705777), ("melbourne", "HBW", "bike_f"): (0.0, 1.1705777 + 1.3119864),
    ("melbourne", "HBW", "walk"): (0.0, 2.2560371), ("melbourne", "HBE", "bike"): (65.8455067, 2.6375670), ("melbourne", "HBE", "walk"): (0.0, 0.8270912),
    ("melbourne", "HBR", "bike"): (8.7270880, 0.0), ("melbourne", "HBR", "bike_f"): (8.7270880 + 23.5710917, 1.7298508),
    ("melbourne", "HBR", "bike_c"): (8.7270880 + 51.9352371, 4.6070250), ("melbourne", "HBR", "walk"): (0.6866997, 0.6779886),
    ("melbourne", "HBR", "walk_c"): (0.6866997, 0.6779886 + 1.0379374), ("melbourne", "HBSO", "bike"): (331.2382835, 11.4359257),
    ("melbourne", "HBSO", "walk"): (0.0, 0.3421390), ("melbourne", "HBA", "bike"): (21.4115565, 0.0), ("melbourne", "NHBW", "bike"): (0.0, 3.9477647),
    ("melbourne", "NHBW", "walk"): (0.0, 4.3210968), ("melbourne", "NHBO", "bike"): (0.0, 2.6660050), ("melbourne", "NHBO", "walk"): (0.0, 5.7158683),
}


def specification(city: str, purpose: str, times: dict[str, str] | None = None) -> Specification:
    """Five alternatives with constants, demographics, time, and street attributes for the active modes.

    Columns: the demographics by name, ``<alternative>_time`` unless ``times`` names others, ``<mode>_<attribute>`` for the
    active modes, and ``av_<alternative>``. The street attributes enter as products with the mode's cost coefficient in the
    published form, ``b (time + g x)``; here the product ``c = b g`` is the coefficient, which has the same likelihood, and
    g is c over b. Fixed coefficients are 0.
    """
    own = PURPOSES[city, purpose]
    utilities, quoted = {}, lambda c: f"`{c}`"
    for mode in ALTERNATIVES:
        terms = [(f"asc_{mode}", "1"), *((f"b_{mode}_{p}", quoted(p)) for p in own.people.split())]
        time = quoted((times or {}).get(mode, f"{mode}_time"))
        terms.append(({"carD": "b_car_time", "carP": "b_car_time", "pt": "b_pt_time"}.get(mode, f"b_{mode}_cost"), time))
        terms += [(f"c_{mode}_{x}", quoted(f"{mode}_{x}")) for x in {"bike": own.bike, "walk": own.walk}.get(mode, "").split()]
        utilities[mode] = terms
    named = {c for terms in utilities.values() for c, _ in terms}
    zero = {c for c in named if "carD" in c or own.no_bike and "bike" in c}
    zero |= {c for f in own.fixed.split() for c in (f"b_{f}", f"c_{f}") if c in named}
    return Specification(utilities, available={m: f"av_{m} = 1" for m in ALTERNATIVES}, fixed=dict.fromkeys(sorted(zero), 0.0))


def intercity(stated: bool) -> Specification:
    """The two small examples of four alternatives between cities, of revealed choices or, with classes of service, of stated ones.

    Columns: ``time_<alternative>``, ``cost_<alternative>``, ``access_<alternative>`` but for the car, ``av_<alternative>``, and for stated choices
    ``service_air`` and ``service_rail``, where 1 is no frills, 2 wifi and 3 food. The choice is the alternative's number from 0; the published
    data count from 1.
    """
    service = {"b_no_frills": 1, "b_wifi": 2, "b_food": 3} if stated else {}
    utilities = {}
    for mode in ("car", "bus", "air", "rail"):
        access = [("b_access", f"access_{mode}")] if mode != "car" else []
        served = [(b, f"CAST(service_{mode} = {level} AS DOUBLE)") for b, level in service.items()] if mode in ("air", "rail") else []
        utilities[mode] = [(f"asc_{mode}", "1"), (f"b_tt_{mode}", f"time_{mode}"), *access, ("b_cost", f"cost_{mode}"), *served]
    fixed = {"asc_car": 0.0} | ({"b_no_frills": 0.0} if stated else {})
    return Specification(utilities, available={m: f"av_{m} = 1" for m in utilities}, fixed=fixed)


def trip_key(household: str, person: str, trip: str) -> Column:
    """Household, P and T with two digits each."""
    return F.concat(F.col(household).cast("string"), F.format_string("P%02dT%02d", F.col(person).cast("int"), F.col(trip).cast("int")))


def purpose_skims(links: DataFrame, zones: DataFrame, city: str, modes: dict[str, str]) -> DataFrame:
    """``(matrix, o, d, value)``, the mean composite cost between zones for every purpose and group of a city.

    links: a, b, and per mode the time column named by ``modes``; gradient, bike_stress, vgvi_gap, speed and junction. Every
    matrix is a set of its own. A matrix is one pass of trees, so they run one after the other over the same links.
    """
    attributes = {"bike": ("gradient", "bike_stress"), "walk": ("vgvi_gap", "speed", "junction")}
    out = None
    for (where, purpose, group), weights in SKIM_WEIGHTS.items():
        mode = group.split("_")[0]
        if where != city or mode not in modes:
            continue
        cost = weighted_cost(modes[mode], list(zip(map(F.col, attributes[mode]), weights, strict=False)))
        found = skim(links.select("a", "b", cost.alias("cost")), zones).withColumn("matrix", F.lit(f"{purpose}_{group}"))
        out = found if out is None else out.unionByName(found)
    return out.select("matrix", "o", "d", "value")
