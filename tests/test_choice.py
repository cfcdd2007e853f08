"""Estimation against plain numpy, and the optimiser on known functions."""

import math

import numpy as np
import pytest

from trellisway.operators import choice as M

SPEC = M.Specification({"a": [("b", "x")], "b": [("asc", "1"), ("b", "y"), ("k", "z")], "c": [("asc_c", "1")]}, available={"c": "open"}, fixed={"k": 0.5})


def data(spark, n=600):
    draw = np.random.default_rng(4)
    x, y, z = draw.normal(size=(3, n))
    open_ = draw.random(n) < 0.8
    u = np.stack([0.8 * x, 0.3 + 0.8 * y + 0.5 * z, np.where(open_, -0.4, -np.inf)]) + draw.gumbel(size=(3, n))
    rows = list(zip(x.tolist(), y.tolist(), z.tolist(), open_.tolist(), u.argmax(axis=0).tolist()))
    return spark.createDataFrame(rows, "x double, y double, z double, open boolean, choice int"), rows


def plain(rows, beta):
    b, asc, asc_c = beta
    total = 0.0
    for x, y, z, open_, choice in rows:
        u = [b * x, asc + b * y + 0.5 * z, asc_c if open_ else -math.inf]
        total -= u[choice] - math.log(sum(math.exp(v) for v in u if v > -math.inf))
    return total


def test_likelihood_gradient_hessian(spark):
    df, rows = data(spark)
    beta = np.array([0.4, -0.2, 0.1])
    assert SPEC.coefficients() == ["b", "asc", "asc_c"]
    f, g = M.likelihood(df, SPEC, beta)
    assert abs(f - plain(rows, beta)) < 1e-8
    for i, e in enumerate(np.eye(3) * 1e-5):
        assert abs(g[i] - (plain(rows, beta + e) - plain(rows, beta - e)) / 2e-5) < 1e-4
    h = M.hessian(lambda points: [v for _, v in M.likelihoods(df, SPEC, points)], beta)
    for i, e in enumerate(np.eye(3) * 1e-4):
        up, down = (M.likelihood(df, SPEC, beta + s * e)[1] for s in (1, -1))
        assert np.allclose(h[i], (up - down) / 2e-4, atol=1e-3)


def test_estimate_finds_the_truth(spark):
    df, rows = data(spark)
    found = M.estimate(df, SPEC)
    values = {r[0]: r for r in found.rows}
    for name, truth in (("b", 0.8), ("asc", 0.3), ("asc_c", -0.4)):
        assert abs(values[name][1] - truth) < 4 * values[name][2]
    assert found.final > found.at_zero and min(found.eigenvalues) > 0
    assert abs(-found.final - plain(rows, [r[1] for r in found.rows])) < 1e-6
    assert values["b"][5] == "***"


def test_optimiser():
    def rosenbrock(x):
        return (1 - x[0]) ** 2 + 100 * (x[1] - x[0] ** 2) ** 2, np.array([-2 * (1 - x[0]) - 400 * x[0] * (x[1] - x[0] ** 2), 200 * (x[1] - x[0] ** 2)])

    x, f, _, _ = M.minimise(rosenbrock, np.array([-1.2, 1.0]))
    assert np.allclose(x, 1, atol=1e-5) and f < 1e-9


def test_errors(spark):
    df, _ = data(spark, 20)
    with pytest.raises(Exception, match="none of the alternatives"):
        M.likelihood(df.selectExpr("x", "y", "z", "open", "7 AS choice"), SPEC, np.zeros(3))
    with pytest.raises(ValueError):
        M.Specification({"a": [("b", "x")]}, fixed={"q": 1.0})
    with pytest.raises(ValueError):
        M.Specification({"a": [("b", "x")]}, available={"q": "true"})


def test_probabilities(spark):
    spec = M.Specification({"a": [("one", "0")], "b": [("one", "1")], "c": [("one", "-1")]})
    row = M.probabilities(spark.range(1), spec, {"one": 1.0}).first()
    assert np.allclose(row.p, [0.244728, 0.665241, 0.090031], atol=1e-6)
    shut = M.Specification({"a": [("one", "0")]}, available={"a": "false"})
    assert M.probabilities(spark.range(1), shut, {"one": 1.0}).first().p is None
