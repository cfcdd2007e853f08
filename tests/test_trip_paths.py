"""Trips that take their columns through the search, and the shuffles that this saves."""

import pytest

from trellisway.operators import access as A
from trellisway.operators import paths as P
from trellisway.plans import model_queries, path_queries


@pytest.mark.parametrize("max_links", [None, 0])
def test_trips_keep_their_rows(spark, max_links):
    links = spark.createDataFrame([(1, 2, 3.0), (2, 3, 1.0), (1, 3, 9.0), (8, 9, 1.0)], "a long, b long, cost double")
    trips = spark.createDataFrame(
        [("p", 1, 3), ("q", 1, 3), ("r", 3, 1), ("s", 2, 2), ("t", 77, 77), ("u", 77, 1), ("v", 1, 8), ("w", None, 1), ("x", 1, 77), (None, 1, 2)], "name string, origin int, target int"
    )
    found = P.trip_paths(links, trips, True, max_links)
    assert found.columns == ["name", "origin", "target", "cost", "time", "dist", "nodes"]
    got = sorted((r["name"] or "", r["cost"], r["nodes"]) for r in found.collect())
    assert got == [("", 3.0, [1, 2]), ("p", 4.0, [1, 2, 3]), ("q", 4.0, [1, 2, 3]), ("s", 0.0, [2]), ("t", 0.0, [77])]
    assert sorted((r["name"] or "", r["cost"]) for r in P.trip_paths(links, trips, False, max_links).collect()) == [g[:2] for g in got]


def test_a_network_without_links(spark):
    links, trips = spark.createDataFrame([], "a long, b long, cost double"), spark.createDataFrame([(1, 1), (1, 2)], "origin long, target long")
    assert [tuple(r) for r in P.trip_paths(links, trips).select("origin", "target", "cost").collect()] == [(1, 1, 0.0)]


def _exchanges(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange ")


def test_trips_are_not_joined_with_their_costs(spark, sf_dir):
    found = path_queries.q_trip_indicators(spark, sf_dir)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Join") == 1  # orders with their first and last line


def test_routes_are_shuffled_once(spark):
    routes = spark.createDataFrame([(1, 1, 2.0, [1, 2]), (1, 2, 2.0, [2, 1]), (1, 3, 2.0, [1, 2]), (1, 4, None, [1, 2]), (2, 5, 1.0, [7])], "trip long, seq long, dist double, links array<long>")
    found = A.unique_paths(routes)
    assert sorted((r.trip, r.seq, r.path_id) for r in found.collect()) == [(1, 1, 0), (1, 2, 1), (1, 3, 0), (1, 4, 2), (2, 5, 0)]
    assert _exchanges(A.unique_paths(routes)) == 1


@pytest.mark.parametrize("query", [path_queries.q_two_seed, model_queries.q_features])
def test_links_are_derived_once(spark, sf_dir, query, monkeypatch):
    kept = []
    keep, names = P._links, path_queries.D.links
    monkeypatch.setattr(path_queries.D, "links", lambda *args: kept.append(1) or names(*args))
    seen = []
    monkeypatch.setattr(P, "_links", lambda df: seen.append(df.is_cached) or keep(df))
    monkeypatch.setattr(A, "_links", lambda df: seen.append(df.is_cached) or keep(df))
    query(spark, sf_dir)
    assert kept == [1] and seen and all(seen)
