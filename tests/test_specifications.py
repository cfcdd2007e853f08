"""The specifications are complete and can be evaluated."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from trellisway.operators.choice import likelihood
from trellisway.plans.specifications import PURPOSES, SKIM_WEIGHTS, intercity, purpose_skims, specification, trip_key


@pytest.mark.parametrize(("city", "purpose"), sorted(PURPOSES))
def test_fixed_names_exist(city, purpose):
    spec, own = specification(city, purpose), PURPOSES[city, purpose]
    free = spec.coefficients()
    assert not any("carD" in c for c in free) and "b_car_time" in free
    for name in own.fixed.split():
        assert f"b_{name}" in spec.fixed or f"c_{name}" in spec.fixed, name
    assert not own.no_bike or not any("bike" in c for c in free)


def test_likelihood_at_zero(spark):
    spec = specification("melbourne", "HBW")
    names = PURPOSES["melbourne", "HBW"].people.split() + [f"{m}_time" for m in spec.utilities] + ["bike_stressLink", "bike_stressLink_f", "walk_speed"]
    rows = spark.range(40).select(
        *(((F.col("id") * (i + 3)) % 7 / 7).alias(n) for i, n in enumerate(names)), (F.col("id") % 5).cast("int").alias("choice"),
        *(F.lit(1).alias(f"av_{m}") for m in spec.utilities),
    )
    f, g = likelihood(rows, spec, np.zeros(len(spec.coefficients())))
    assert abs(f - 40 * np.log(5)) < 1e-9 and len(g) == len(spec.coefficients())


def test_keys_and_skims(spark):
    assert spark.createDataFrame([("h7", 2, 11)], "h string, p int, t int").select(trip_key("h", "p", "t").alias("k")).first().k == "h7P02T11"
    links = spark.createDataFrame([(1, 2, 10.0, 0.1, 0.5), (2, 1, 10.0, 0.0, 0.0)], "a long, b long, time double, gradient double, bike_stress double")
    zones = spark.createDataFrame([(1, 1), (2, 2)], "node long, zone long")
    found = {(r.matrix, r.o, r.d): r.value for r in purpose_skims(links, zones, "manchester", {"bike": "time"}).collect()}
    assert len(found) == 4 * sum(k[0] == "manchester" and k[2].startswith("bike") for k in SKIM_WEIGHTS)
    assert abs(found["HBW_bike", 1, 2] - 10 * (1 + 35.9032908 * 0.1 + 2.3084587 * 0.5)) < 1e-9 and found["HBW_bike", 2, 1] == 10.0


@pytest.mark.parametrize("stated", [False, True])
def test_choices_between_cities(spark, stated):
    draw, modes = np.random.default_rng(6), ("car", "bus", "air", "rail")
    names = [f"{kind}_{m}" for m in modes for kind in ("time", "cost", "access") if (kind, m) != ("access", "car")] + [f"av_{m}" for m in modes] + ["service_air", "service_rail", "choice"]
    rows = []
    for _ in range(60):
        r = {n: float(draw.integers(1, 9)) for n in names[:11]} | {f"av_{m}": int(draw.random() < 0.8) for m in modes} | {"service_air": int(draw.integers(0, 4)), "service_rail": int(draw.integers(0, 4))}
        r["av_car"], r["choice"] = 1, int(draw.choice([i for i, m in enumerate(modes) if r[f"av_{m}"] or m == "car"]))
        rows.append(r)
    spec = intercity(stated)
    assert spec.coefficients() == ["b_tt_car", "b_cost", "asc_bus", "b_tt_bus", "b_access", "asc_air", "b_tt_air", *(["b_wifi", "b_food"] if stated else []), "asc_rail", "b_tt_rail"]
    beta = draw.normal(size=len(spec.coefficients())) / 10
    b, total = dict(zip(spec.coefficients(), beta)), 0.0
    for r in rows:
        u = [b.get(f"asc_{m}", 0.0) + b[f"b_tt_{m}"] * r[f"time_{m}"] + b["b_cost"] * r[f"cost_{m}"] + (b["b_access"] * r[f"access_{m}"] if m != "car" else 0.0) for m in modes]
        for i, m in ((2, "air"), (3, "rail")) if stated else ():
            u[i] += {2: b["b_wifi"], 3: b["b_food"]}.get(r[f"service_{m}"], 0.0)
        total -= u[r["choice"]] - np.log(sum(np.exp(v) for v, m in zip(u, modes) if r[f"av_{m}"]))
    f, _ = likelihood(spark.createDataFrame([tuple(r[n] for n in names) for r in rows], names), spec, beta)
    assert abs(f - total) < 1e-8
