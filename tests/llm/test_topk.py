"""Top-k search against all products."""

import math

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from trellisway.llm.topk import OP11_SQL, TopKParams, op11_topk_search, select, top_k

SCHEMA = "vec_id long, embedding array<float>, rank int, score double, _row string"


def table(spark, rows):
    return spark.createDataFrame([(i, v, 7, 0.5, "x") for i, v in rows], SCHEMA)


def expected(rows, k, of=5):
    """By row: every other row of finite components, scored with Python integers."""
    usable = [(n, i, [math.floor(256 * float(np.float32(x))) for x in v]) for n, (i, v) in enumerate(rows)
              if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for n, i, q in usable:
        if i is not None and i % of == 0:
            scored = [(-max(-(2**63), min(2**63 - 1, sum(a * b for a, b in zip(q, c, strict=False)))), math.inf if j is None else j) for m, j, c in usable if m != n]
            out += [(i, r + 1, None if j is math.inf else j, -s) for r, (s, j) in enumerate(sorted(scored)[:k])]
    return sorted(out, key=str)


def found(df):
    return sorted(((r.query_id, r["rank"], r.vec_id, r.score) for r in df.collect()), key=str)


ODD = [
    (1000, None), (1001, []), (1005, []), (1002, [None, 1.0]), (1003, [float("nan")] * 4), (1004, [float("inf"), 0.0]), (1006, [0.0] * 8),
    (1007, [1.0]), (1010, [2.0, -3.0, 0.5]), (None, [0.25] * 8), (1020, [0.25] * 8), (1020, [0.25] * 8), (1021, [0.25] * 12),
]


@pytest.mark.parametrize("params", [TopKParams(), TopKParams(query_rows=7, candidate_rows=11, least_rows=5), TopKParams(k=500)])
def test_against_all_products(spark, params):
    draw = np.random.default_rng(3)
    rows = [(i, (draw.normal(size=8) * (draw.random(8) < 0.6)).tolist()) for i in range(120)] + ODD
    rows += [(200 + i, [0.5] * 8) for i in range(60)]  # one vector in many places: ties
    assert found(top_k(table(spark, rows), F.col("vec_id") % 5 == 0, params)) == expected(rows, params.k)


def test_components_beyond_64_bits(spark):
    rows = [(0, [3e38, 1.0]), (1, [1e20, -5.0]), (2, [-1e20, 2.0]), (3, [1e9, 1e9]), (5, [1e10, -1e10])]
    assert found(top_k(table(spark, rows), F.col("vec_id") % 5 == 0)) == expected(rows, 5)


def test_selection_takes_the_first_of_equal_scores():
    draw = np.random.default_rng(4)
    for _ in range(300):
        scores, k = draw.integers(0, 5, draw.integers(1, 40)), int(draw.integers(1, 12))
        assert sorted(select(scores, k).tolist()) == sorted(np.lexsort((np.arange(len(scores)), -scores))[:k].tolist())


def test_empty_table(spark):
    assert top_k(table(spark, []), F.col("vec_id") % 5 == 0).count() == 0
    assert top_k(table(spark, [(1, [1.0]), (2, [2.0])]), F.col("vec_id") % 5 == 0).count() == 0


def test_query_against_sql(spark, sf_dir):
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from read_parquet('{sf_dir}/embeddings.parquet')")
    cur = con.execute(OP11_SQL)
    names = [d[0] for d in cur.description]
    want = sorted(cur.fetchall())
    assert sorted(tuple(r[n] for n in names) for r in op11_topk_search(spark, sf_dir).collect()) == want
