"""Exact top-k inner products by term-at-a-time accumulation over blocks of postings."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import keep_only, materialize

FOUND = "_query_row long, query_id long, vec_id long, score long"
_LONG = (1 << 63) - 1


@dataclass(frozen=True)
class TopKParams:
    """A task accumulates one block of queries over one block of candidates; ``scale`` turns components into integers."""

    k: int = 5
    scale: int = 256
    query_rows: int = 8192
    candidate_rows: int = 32_768
    least_rows: int = 2048


def _integers(column: pa.ChunkedArray, scale: int) -> tuple[np.ndarray, np.ndarray]:
    """All components as integers, one vector after the other, and where each vector ends. Python integers where 64 bits are too few."""
    lists = column.combine_chunks()
    lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
    with np.errstate(over="ignore"):
        values = np.floor(scale * lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64))
    ends = np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64))
    if len(values) and np.abs(values).max() >= 2.0**62:
        return np.array([int(v) for v in values.tolist()], object), ends
    return values.astype(np.int64), ends


class Postings:
    """For each term (the position of a component) the rows that have a weight there and their weights, in row order."""

    def __init__(self, values: np.ndarray, ends: np.ndarray):
        self.rows = len(ends)
        lengths = np.diff(ends, prepend=0)
        row = np.repeat(np.arange(self.rows), lengths)
        term = np.arange(len(values)) - np.repeat(ends - lengths, lengths)
        filled = np.flatnonzero(values != 0)
        order = filled[np.argsort(term[filled], kind="stable")]
        bounds = np.searchsorted(term[order], np.arange(int(lengths.max(initial=0)) + 1))
        own = [order[a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
        #: None in place of rows: the posting list holds every row.
        self.lists = [(None if len(at) == self.rows else row[at], values[at]) for at in own]

    def accumulate(self, terms: np.ndarray, weights: np.ndarray, scores: np.ndarray) -> None:
        """Scatter the postings of a query's terms, weighted, into one dense array of scores."""
        scores[:] = 0
        for term, weight in zip(terms.tolist(), weights.tolist(), strict=True):
            if term < len(self.lists):
                rows, values = self.lists[term]
                if rows is None:
                    scores += weight * values
                elif len(rows):
                    scores[rows] += weight * values


def select(scores: np.ndarray, k: int) -> np.ndarray:
    """Rows of the ``k`` highest scores, ties to the smaller row, in no order."""
    if len(scores) <= k:
        return np.arange(len(scores))
    least = np.partition(scores, len(scores) - k)[len(scores) - k]
    above = np.flatnonzero(scores > least)
    return np.concatenate([above, np.flatnonzero(scores == least)[: k - len(above)]])


def _search(candidates: pa.Table, queries: pa.Table, params: TopKParams) -> pa.Table:
    keep_only()
    none = pa.table({c.split()[0]: pa.array([], pa.int64()) for c in FOUND.split(", ")})
    if not candidates.num_rows or not queries.num_rows:
        return none
    candidates = candidates.sort_by([("vec_id", "ascending"), ("_row", "ascending")])  # nulls come last
    (values, ends), (weights, stops) = (_integers(t["embedding"], params.scale) for t in (candidates, queries))
    bound = int(np.abs(values).max(initial=0)) * int(np.abs(weights).max(initial=0)) * int(np.diff(ends, prepend=0).max(initial=1))
    if bound >= _LONG:
        values, weights = values.astype(object), weights.astype(object)
    postings = Postings(values, ends)
    place = {row: i for i, row in enumerate(candidates["_row"].to_pylist())}
    ids = candidates["vec_id"].combine_chunks()
    sums = np.zeros(postings.rows, values.dtype)
    found_at, found, counts = [], [], []
    for i, row in enumerate(queries["_row"].to_pylist()):
        own = weights[stops[i - 1] if i else 0 : stops[i]]
        terms = np.flatnonzero(own != 0)
        postings.accumulate(terms, own[terms], sums)
        scores = sums if sums.dtype == np.int64 else np.array([max(-_LONG - 1, min(_LONG, s)) for s in sums.tolist()], np.int64)
        at = place.get(row)
        top = select(scores, params.k + (at is not None))
        if at is not None:  # the query itself is among the candidates of this block
            top = top[top != at]
            if len(top) > params.k:
                least = max(top.tolist(), key=lambda j: (-scores[j], j))
                top = top[top != least]
        found_at.append(top)
        found.append(scores[top])
        counts.append(len(top))
    if not sum(counts):
        return none
    who = pa.array(np.repeat(np.arange(len(counts)), counts))
    return pa.table({
        "_query_row": queries["_row"].take(who), "query_id": queries["vec_id"].take(who),
        "vec_id": ids.take(pa.array(np.concatenate(found_at))), "score": pa.array(np.concatenate(found)),
    })


def top_k(vectors: DataFrame, is_query, params: TopKParams = TopKParams()) -> DataFrame:
    """The ``k`` highest integer inner products of each row of ``vectors`` (vec_id, embedding) that meets ``is_query``.

    Returns query_id, rank (from 1), vec_id and score; candidates are all rows but the query's own, all of them if there are fewer
    than ``k``, and ties go to the smaller vec_id. A component x counts as ``floor(scale * x)``; of vectors of different length
    the common components count. Vectors that are null or hold a null or non-finite component take no part, neither as query nor
    as candidate; a vector without components scores 0 everywhere. Scores beyond 64 bits count as the ends of that range.

    Queries and candidates are dealt into blocks of a bounded number of rows, and a task holds one block of each: the candidates as
    postings by component, into whose dense score array the weights of one query after another are scattered. It hands on ``k``
    rows a query, which are merged by query. Repeated rows are rows of their own: a copy of a query is among its candidates. A null vec_id is
    no smaller than any other. An empty table gives no rows.
    """
    spark = vectors.sparkSession
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < F.lit(float("inf"))))
    kept = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    kept = kept.filter(F.col("embedding").isNotNull() & finite).withColumn("_row", F.monotonically_increasing_id())
    kept = materialize(kept.withColumn("_query", F.coalesce(is_query, F.lit(False))), "vectors")  # _row stays what it is
    sizes = kept.agg(F.count("*").alias("n"), F.count_if("_query").alias("q")).first()
    spread = min(-(-sizes["n"] // params.least_rows), 3 * spark.sparkContext.defaultParallelism)
    blocks = max(1, spread, -(-sizes["n"] // params.candidate_rows))
    turns = max(1, -(-sizes["q"] // params.query_rows))

    def every(n: int):
        return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))

    own = F.xxhash64("_row")
    left = kept.select(F.pmod(own, F.lit(blocks)).cast("int").alias("_block"), every(turns).alias("_turn"), "_row", "vec_id", "embedding")
    right = kept.filter("_query").select(every(blocks).alias("_block"), F.pmod(own, F.lit(turns)).cast("int").alias("_turn"), "_row", "vec_id", "embedding")
    keys = ["_block", "_turn"]
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(lambda a, b: _search(a, b, params), FOUND)
    best = Window.partitionBy("_query_row").orderBy(F.col("score").desc(), F.col("vec_id").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= params.k).select("query_id", "rank", "vec_id", "score")


def op11_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five highest scores of every fiftieth vector against all rows of ``embeddings``: :func:`top_k`."""
    return top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 50 == 0)


#: The same result in SQL, by all products.
OP11_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM p)
SELECT query_id, rank::INT AS rank, vec_id, score FROM r WHERE rank <= 5
"""
