"""Near-duplicate documents by one-permutation MinHash, banded buckets and verified star edges."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BoundedCache, documents, keep_only, materialize, small_side, sub_batches
from .components import connected_components
from .lsh import Bound, band_keys, linked_components, mix, odd_constants, one_permutation


@dataclass(frozen=True)
class MinHashParams:
    """Two documents are linked where ``den * overlap >= num * union`` on their sets of ``words``-word shingles.

    48 bands of 8 bins miss a pair at 85 % with a chance of (1 - 0.85**8)**48 < 3e-7, and one permutation makes the
    number of bins almost free.
    """

    words: int = 5
    num: int = 85
    den: int = 100
    bands: int = 48
    rows: int = 8


_word_hash = BoundedCache(xxhash.xxh64_digest, 200_000)


def shingle_sets(texts: list[str | None], words: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct 64-bit hashes of each text's word shingles, one text after the other, and their numbers.

    A-Z are lower-cased and words end at ASCII white space. Fewer words than a shingle make one shingle; no words,
    an empty text or null make none. Hashes are taken over all texts at once.
    """
    packed, counts = [], np.zeros(len(texts), np.int64)
    for i, text in enumerate(texts):
        parts = text.encode("utf-8", "surrogatepass").lower().split() if text else []
        counts[i] = len(parts)
        packed.extend(map(_word_hash.__getitem__, parts))
    hashes = np.frombuffer(b"".join(packed), ">u8").astype(np.uint64)
    n = len(hashes)
    ends = np.cumsum(counts)
    total = np.zeros(max(0, n - words + 1), np.uint64)
    for i, c in enumerate(odd_constants(words)):
        total += mix(hashes[i : n - words + 1 + i] + c) * c if n >= words else total
    total = mix(total)
    sizes, parts = np.zeros(len(texts), np.int64), []
    for i in np.flatnonzero(counts):
        start, end = ends[i] - counts[i], ends[i]
        if counts[i] < words:
            own = mix(np.array([(mix(hashes[start:end] + np.uint64(counts[i])) * odd_constants(words)[: counts[i]]).sum()], np.uint64))
        else:
            own = np.sort(total[start : end - words + 1])
            if len(own) > 1 and not (distinct := own[1:] != own[:-1]).all():
                own = own[np.concatenate([[True], distinct])]
        parts.append(own)
        sizes[i] = len(own)
    return np.concatenate(parts) if parts else np.empty(0, np.uint64), sizes


def _sketch(batches, params: MinHashParams):
    keep_only(_word_hash)
    for batch in sub_batches(batches):
        hashes, sizes = shingle_sets(batch.column(1).to_pylist(), params.words)
        owner = np.repeat(np.arange(len(sizes)), sizes)
        sig = one_permutation(owner, hashes, len(sizes), params.bands * params.rows)
        keys = band_keys(sig, params.rows)
        ends = np.cumsum(sizes)
        digest = b"".join(xxhash.xxh3_128_digest(hashes[e - n : e].tobytes()) for e, n in zip(ends, sizes, strict=True))
        parts = np.frombuffer(digest, np.int64).reshape(-1, 2)
        empty = sizes == 0
        lists = pa.FixedSizeListArray.from_arrays(pa.array(keys.reshape(-1)), params.bands).cast(pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(sizes), pa.array(parts[:, 0], mask=empty), pa.array(parts[:, 1], mask=empty), lists],
            names=["doc_id", "n_shingles", "d1", "d2", "keys"],
        )


def near_duplicates(docs: DataFrame, params: MinHashParams = MinHashParams(), bound: Bound = Bound()) -> DataFrame:
    """Component of near-duplicate documents for every row of ``docs`` (doc_id, text; more columns are ignored).

    Returns doc_id, n_shingles, component_id (the smallest linked doc_id) and kept (doc_id = component_id). Equal
    shingle sets collapse to their smallest id first, so thousands of copies cost one sketch. The stars of all band
    buckets give candidate clusters, within which links are verified on full sets (:func:`lsh.linked_components`).

    Null, empty and white-space texts have no shingles, are linked with nothing and kept. A null doc_id keeps its
    row, with a null component, as kept. Rows that repeat a doc_id count as one document that has the links
    of each of them, and each row is returned. An empty table gives no rows.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    sketched = materialize(
        docs.mapInArrow(
            lambda it: _sketch(it, params), "doc_id long, n_shingles long, d1 long, d2 long, keys array<long>"
        ),
        "sketch",
    )
    usable = sketched.filter("doc_id is not null and n_shingles > 0")
    groups = materialize(
        usable.groupBy("d1", "d2").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies")), "sets"
    )
    reps = usable.join(
        groups.select(F.col("rep").alias("doc_id"), "d1", "d2"), ["doc_id", "d1", "d2"], "left_semi"
    ).select(F.col("doc_id").alias("id"), "keys")

    def texts_of(ids: DataFrame) -> DataFrame:
        return docs.withColumnRenamed("doc_id", "id").join(small_side(ids), "id", "left_semi")

    components = linked_components(reps, texts_of, lambda texts: shingle_sets(texts, params.words), params.num, params.den, bound)
    copied = groups.filter("copies > 1").select("d1", "d2", "rep")
    copied = small_side(materialize(copied, "copied"))
    spread = F.when(F.col("d1").isNull(), F.xxhash64("doc_id"))
    with_rep = (
        sketched.select("doc_id", "n_shingles", F.coalesce("d1", spread).alias("d1"), F.coalesce("d2", spread).alias("d2"))
        .join(copied, ["d1", "d2"], "left").withColumn("rep", F.coalesce("rep", "doc_id"))
    )
    named = small_side(components.select(F.col("id").alias("rep"), "component"))
    placed = with_rep.join(named, "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    component = F.col("component")
    text_of = F.struct(F.coalesce("d1", F.lit(0)), F.coalesce("d2", F.lit(0)))
    several = sketched.filter("doc_id is not null").groupBy("doc_id").agg(F.min(text_of).alias("least"), F.max(text_of).alias("most"))
    several = materialize(several.filter("least <> most").select("doc_id"), "several")
    if not several.isEmpty():  # the components of all texts of a doc_id are one
        own = placed.join(small_side(several), "doc_id", "left_semi").select(F.col("doc_id").alias("a"), F.col("component").alias("b"))
        merged = small_side(connected_components(own).select(F.col("id").alias("component"), F.col("component").alias("merged")))
        placed = placed.join(merged, "component", "left")
        component = F.coalesce("merged", "component")
    return placed.select(
        "doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept")
    )


def op1_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Component of every document by :func:`near_duplicates`; null and empty texts are linked with nothing."""
    return near_duplicates(documents(spark, sf_dir))


def near_dedup(docs: DataFrame, params: MinHashParams = MinHashParams()) -> DataFrame:
    """The documents that :func:`near_duplicates` keeps, with all their columns."""
    found = near_duplicates(docs, params).filter("not kept").select("doc_id").distinct()
    dropped = small_side(materialize(found, "dropped"))
    return docs.join(dropped, "doc_id", "left_anti").select(*docs.columns)


#: The same result in SQL, by the sets themselves.
OP1_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
    ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i : i + 4], ' ')) END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
rare AS (
  SELECT doc_id, g FROM (
    SELECT s.doc_id, s.g, n.n, row_number() OVER (PARTITION BY s.doc_id ORDER BY f.f, s.g) AS r
    FROM s JOIN n USING (doc_id) JOIN (SELECT g, count(*) AS f FROM s GROUP BY 1) f USING (g))
  WHERE r <= n - ceil(0.85 * n) + 1),
p AS (SELECT DISTINCT x.doc_id AS a, y.doc_id AS b FROM rare x JOIN rare y USING (g) WHERE x.doc_id < y.doc_id),
i AS (SELECT a, b, count(*) AS i FROM p JOIN s x ON x.doc_id = a JOIN s y ON y.doc_id = b AND y.g = x.g GROUP BY 1, 2),
e AS (SELECT a, b FROM i JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * i >= 85 * (na.n + nb.n - i)),
u AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
c(id, root) AS (
  SELECT doc_id, doc_id FROM documents UNION SELECT u.b, c.root FROM c JOIN u ON u.a = c.id WHERE c.root < u.b),
m AS (SELECT id, min(root) AS root FROM c GROUP BY 1)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, m.root::BIGINT AS component_id, d.doc_id = m.root AS kept
FROM documents d JOIN m ON m.id = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id
"""
