"""Values worked out by hand, and the borders of the formulas."""

import pytest
from pyspark.sql import functions as F

from trellisway.functions import link as L
from trellisway.functions.decay import Decay


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


def lit(*values):
    return [F.lit(v) for v in values]


@pytest.mark.parametrize(("length", "grad", "want"), [(100.0, 0.0, 71.47477299674149), (100.0, -0.05, 60.0), (100.0, 0.1, 101.4275309027455), (100.0, 2.0, 2366.919411432032)])
def test_walk_time(spark, length, grad, want):
    assert abs(one(spark, L.walk_time(*lit(length, grad))) - want) < 1e-9


@pytest.mark.parametrize(("grad", "want"), [(0.04, 4.4), (0.3, 0.55), (-0.2, 5.5)])
def test_bike_speed(spark, grad, want):
    got = one(spark, L.bike_speed(5.5, F.lit(1.0), F.lit("asphalt"), F.lit("residential"), F.lit(grad), F.lit(20.0)))
    assert abs(got - want) < 1e-9


@pytest.mark.parametrize(
    ("mode", "kind", "mph", "aadt", "want"),
    [("bike", "MIXED", 30.0, 5000.0, 1.0), ("bike", "MIXED", 20.0, 1000.0, 0.060455), ("bike", "LANE", 30.0, 5000.0, 0.790625), ("walk", "MIXED", 30.0, 5000.0, 0.0), ("bike", "PROTECTED", 40.0, 0.0, 0.5)],
)
def test_link_stress(spark, mode, kind, mph, aadt, want):
    got = one(spark, L.link_stress(mode, F.lit(True), F.lit(True), F.lit("none"), F.lit(mph), F.lit(None).cast("double"), F.lit(aadt), F.lit(kind), F.lit(0.0), F.lit(100.0)))
    assert abs(got - want) < 1e-9


@pytest.mark.parametrize(
    ("kind", "mph", "aadt", "lanes", "want"),
    [("UNCONTROLLED", 30.0, 4000.0, 2.0, 0.6356862745098), ("UNCONTROLLED", 30.0, 4000.0, 1.0, 0.3023529411765), ("ZEBRA", 20.0, 8000.0, 2.0, 0.2883333333), ("ZEBRA", 40.0, 8000.0, 2.0, 0.7777777778)],
)
def test_junction_stress(spark, kind, mph, aadt, lanes, want):
    got = one(spark, L.junction_stress(F.lit(True), F.lit(kind), F.lit(mph), F.lit(None).cast("double"), F.lit(aadt), F.lit(lanes), F.lit(0.0)))
    assert abs(got - want) < 1e-9


@pytest.mark.parametrize(
    ("decay", "cost", "want"),
    [
        (Decay("cumulative_gaussian", a=200.0, v=57708.0), 500.0, 0.2102252308), (Decay("cumulative_gaussian", a=200.0, v=57708.0), 200.0, 1.0),
        (Decay("cumulative", cut_dist=1.0), 9.0, 1.0), (Decay("gaussian", v=2.0), 2.0, 0.1353352832), (Decay("power", a=2.0), 4.0, 0.0625), (Decay("power", a=1.0), 0.0, float("inf")),
    ],
)
def test_decay(spark, decay, cost, want):
    got = one(spark, decay(F.lit(cost)))
    assert got == want or abs(got - want) < 1e-9


def test_decay_arguments():
    for bad in (("unknown", {}), ("exponential", {}), ("cumulative", {})):
        with pytest.raises(ValueError):
            Decay(bad[0], **bad[1])
