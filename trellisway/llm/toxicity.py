"""Toxicity scores by FTRL-proximal logistic regression over hashed word n-grams and skip-grams."""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BoundedCache, crc_bucket, documents, keep_only, sub_batches

_EDGES = re.compile(r"[\W_]+")


@dataclass(frozen=True)
class ToxicityParams:
    """``train_rows`` bounds the labelled rows of each label that are learned from, chosen by a hash of doc_id. Features
    in fewer than ``min_rows`` of them are not learned: they would only name single documents."""

    bits: int = 18
    alpha: float = 0.5
    beta: float = 1.0
    l1: float = 6.0
    l2: float = 0.1
    epochs: int = 4
    min_rows: int = 5
    train_rows: int = 6000


def _hash_words(chunk: str) -> bytes:
    return b"".join(xxhash.xxh32_digest(w.encode("utf-8", "surrogatepass")) for w in _EDGES.split(chunk.lower()) if w)


_words = BoundedCache(_hash_words, 200_000)


def features(texts: list[str | None], bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(text number, hashed feature) of all words, word pairs and pairs with one word between, with repeats."""
    packed, counts = [], []
    for text in texts:
        own = b"".join(map(_words.__getitem__, text.split())) if text else b""
        packed.append(own)
        counts.append(len(own) // 4)
    words = np.frombuffer(b"".join(packed), ">u4").astype(np.uint32)
    owner = np.repeat(np.arange(len(texts), dtype=np.int32), counts)
    shift = np.uint32(32 - bits)
    ids, owners = [(words * np.uint32(0x9E3779B1)) >> shift], [owner]
    for step, c in ((1, 0x85EBCA6B), (2, 0xC2B2AE35)):
        if len(words) > step:
            same = owner[step:] == owner[:-step]
            pair = (words[:-step] * np.uint32(c) + words[step:]) * np.uint32(0x27D4EB2F)
            pair = (pair ^ (pair >> np.uint32(15))) * np.uint32(0x9E3779B1)
            ids.append((pair >> shift)[same])
            owners.append(owner[:-step][same])
    return np.concatenate(owners), np.concatenate(ids)


def _by_text(texts: list[str | None], bits: int) -> list[np.ndarray]:
    owner, ids = features(texts, bits)
    both = np.unique(owner.astype(np.uint64) << np.uint64(bits) | ids)
    cut = np.searchsorted(both >> np.uint64(bits), np.arange(len(texts) + 1))
    plain = (both & np.uint64((1 << bits) - 1)).astype(np.int64)
    return [plain[a:b] for a, b in zip(cut[:-1], cut[1:], strict=True)]


def ftrl(rows: list[np.ndarray], labels: np.ndarray, params: ToxicityParams) -> np.ndarray:
    """Weights after a few passes over the rows; the last weight is the intercept, which has no L1.

    The learning rate of a coordinate falls with its own squared gradients, and a coordinate whose summed gradient
    stays below l1 has weight 0. The rarer label counts more, so that both weigh the same.
    """
    size = 1 << params.bits
    z, n = np.zeros(size + 1), np.zeros(size + 1)
    l1 = np.full(size + 1, params.l1)
    l1[size] = 0.0
    share = max(labels.mean(), 1 / len(labels))
    weight = np.where(labels == 1, 0.5 / share, 0.5 / max(1 - share, 1 / len(labels)))

    def weights(at):
        zz = z[at]
        return np.where(
            np.abs(zz) <= l1[at], 0.0, -(zz - np.sign(zz) * l1[at]) / ((params.beta + np.sqrt(n[at])) / params.alpha + params.l2)
        )

    order = np.random.default_rng(5)
    for _ in range(params.epochs):
        for i in order.permutation(len(rows)):
            at = np.append(rows[i], size)
            w = weights(at)
            p = 1 / (1 + np.exp(-np.clip(w.sum(), -30, 30)))
            g = (p - labels[i]) * weight[i]
            sigma = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / params.alpha
            z[at] += g - sigma * w
            n[at] += g * g
    return weights(np.arange(size + 1))


def _train(batches, params: ToxicityParams):
    keep_only(_words)
    rows, labels = [], []
    for batch in sub_batches(batches):
        rows += _by_text(batch.column(0).to_pylist(), params.bits)
        labels += batch.column(1).to_pylist()
    if rows:
        common = np.bincount(np.concatenate(rows), minlength=1 << params.bits) >= params.min_rows
        w = ftrl([at[common[at]] for at in rows], np.array(labels), params)
        at = np.flatnonzero(w)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(w[at])], names=["feature", "weight"])


def fit(docs: DataFrame, labels: DataFrame, params: ToxicityParams = ToxicityParams(), usable=None) -> tuple[np.ndarray, np.ndarray]:
    """Sparse weights ``(feature, weight)`` from ``docs`` (doc_id, text) and ``labels`` (doc_id, toxic).

    usable: condition on doc_id that training rows meet. At most ``train_rows`` rows of each label are used, those with
    the least hash of doc_id, in one task. Rows with a null label or doc_id are not learned from; of
    labels that differ for a doc_id the higher counts. Without any row the weights
    are empty, and every score is 0.5 or less.
    """
    known = labels.select(F.col("doc_id"), F.col("toxic").cast("int").alias("toxic")).filter("toxic in (0, 1) and doc_id is not null")
    if usable is not None:
        known = known.filter(usable)
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).withColumn("h", F.xxhash64("doc_id", F.lit(3)))
    picked = known.filter("toxic = 1").orderBy("h").limit(params.train_rows).unionByName(
        known.filter("toxic = 0").orderBy("h").limit(params.train_rows)
    )
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(picked.select("doc_id", "toxic", "h")), "doc_id")
    rows = rows.groupBy("doc_id", "h", "toxic").agg(F.min("text").alias("text"))  # rows that repeat a doc_id count once
    ordered = rows.select("text", F.col("toxic").cast("double").alias("toxic"), "h").repartition(1).sortWithinPartitions("h")
    model = ordered.select("text", "toxic").mapInArrow(lambda it: _train(it, params), "feature long, weight double")
    found = model.orderBy("feature").toPandas()
    return found["feature"].to_numpy(np.int64), found["weight"].to_numpy(np.float64)


def _score(batches, sent, params: ToxicityParams, text_at: int, name: str):
    keep_only(_words)
    at, weights = sent.value
    size = 1 << params.bits
    table = np.zeros(size + 1)
    table[at] = weights
    used = table[:size] != 0
    for batch in sub_batches(batches):
        owner, ids = features(batch.column(text_at).to_pylist(), params.bits)
        hit = used[ids]
        both = np.unique(owner[hit].astype(np.uint64) << np.uint64(params.bits) | ids[hit])
        total = np.bincount((both >> np.uint64(params.bits)).astype(np.int64), table[(both & np.uint64(size - 1)).astype(np.int64)], batch.num_rows)
        score = 1 / (1 + np.exp(-np.clip(total + table[size], -30, 30)))
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(score)], names=[*batch.schema.names, name])


def scored_rows(docs: DataFrame, model: tuple[np.ndarray, np.ndarray], params: ToxicityParams = ToxicityParams(), name: str = "toxicity") -> DataFrame:
    """The rows of ``docs`` with a column ``name``, the chance of label 1 of the whole ``text`` (a string column).

    The model sent to the tasks has at most 2**bits + 1 weights. Null and empty texts score by the intercept alone.
    Repeated rows and null doc_ids are scored row by row, and other columns stay; a column of the same name is replaced.
    """
    docs = docs.drop(name)
    sent, text_at = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index("text")
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.mapInArrow(lambda it: _score(it, sent, params, text_at, name), f"{fields}, `{name}` double")


def score(docs: DataFrame, model: tuple[np.ndarray, np.ndarray], params: ToxicityParams = ToxicityParams()) -> DataFrame:
    """``(doc_id, score)`` of every row's whole text; see :func:`scored_rows`."""
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return scored_rows(own, model, params).select("doc_id", F.col("toxicity").alias("score"))


#: Rows with this remainder are held out.
HELD_OUT, MOD = 0, 5


def fit_on_labels(spark: SparkSession, sf_dir: str, params: ToxicityParams = ToxicityParams()):
    """The model of the labelled rows that are not held out."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return fit(documents(spark, sf_dir), labels, params, crc_bucket("doc_id", MOD) != HELD_OUT)


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score of every document by the model of the rows that aren't held out; null and empty texts score by the intercept alone."""
    scored = score(documents(spark, sf_dir), fit_on_labels(spark, sf_dir))
    return scored.select(
        "doc_id", F.coalesce(crc_bucket("doc_id", MOD) == HELD_OUT, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )
