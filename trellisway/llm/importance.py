"""Importance resampling of documents towards a target distribution of hashed n-grams, in DataFrame functions only."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import documents, materialize, small_side

#: What stands between words: every ASCII character that is neither a digit nor a lower-case letter.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class ResamplingParams:
    """Features are runs of ``least`` to ``most`` words, hashed into ``buckets``; ``percent`` of the documents with
    ``min_words`` words or more are drawn by the Gumbel noise of ``seed`` and their id."""

    least: int = 1
    most: int = 1
    buckets: int = 10_000
    percent: int = 10
    min_words: int = 20
    seed: int = 2024


def words(text: str) -> Column:
    """Words of a column: only A-Z are lower-cased; null has none."""
    parts = F.split(F.translate(F.coalesce(F.col(text).cast("string"), F.lit("")), UPPER, LOWER), SEPARATORS)
    return F.array_remove(parts, "")


def ngrams(found: Column, least: int, most: int) -> Column:
    """All runs of ``least`` to ``most`` consecutive words, joined by a space, repeats included."""

    def runs(n: int) -> Column:
        if n == 1:
            return found
        length = F.greatest(F.size(found) - (n - 1), F.lit(0))
        joined = F.slice(found, F.lit(1), length)
        for after in range(2, n + 1):
            joined = F.zip_with(joined, F.slice(found, F.lit(after), length), lambda a, b: F.concat_ws(" ", a, b))
        return joined

    return runs(least) if least == most else F.concat(*(runs(n) for n in range(least, most + 1)))


def _features(rows: DataFrame, params: ResamplingParams, *kept: str) -> DataFrame:
    """Words and features of every text, beside the columns that are kept."""
    split = rows.select(*kept, words("text").alias("words"))
    return split.select(*kept, F.size("words").cast("long").alias("n_words"), ngrams(F.col("words"), params.least, params.most).alias("features"))


def _bucket(feature: str, params: ResamplingParams) -> Column:
    return F.crc32(F.col(feature).cast("binary")) % F.lit(params.buckets)


def bucket_counts(rows: DataFrame, params: ResamplingParams) -> DataFrame:
    """``(bucket, n)`` over all features of ``rows`` (text); partial counts leave at most one row a bucket and task."""
    exploded = _features(rows, params).select(F.explode("features").alias("feature"))
    return exploded.groupBy(_bucket("feature", params).alias("bucket")).agg(F.count("*").alias("n"))


def _files(params: ResamplingParams) -> int:
    """Files of a table with a row or two for each bucket: a few, however many partitions the shuffle has."""
    return 1 + params.buckets // 1_000_000


def gain_table(source: DataFrame, target: DataFrame, params: ResamplingParams = ResamplingParams()) -> DataFrame:
    """``(bucket, gain)`` of every bucket: 1000 times the log ratio of its smoothed shares in ``target`` and ``source``, rounded down."""
    counted = materialize(
        bucket_counts(source, params).select("bucket", F.col("n").alias("s"), F.lit(0).cast("long").alias("t"))
        .unionByName(bucket_counts(target, params).select("bucket", F.lit(0).cast("long").alias("s"), F.col("n").alias("t")))
        .repartition(_files(params)),
        "bucket-counts",
    )
    total = counted.agg(F.coalesce(F.sum("s"), F.lit(0)).alias("s"), F.coalesce(F.sum("t"), F.lit(0)).alias("t")).first()
    every = source.sparkSession.range(params.buckets).select(F.col("id").alias("bucket"))
    sums = every.join(counted.groupBy("bucket").agg(F.sum("s").alias("s"), F.sum("t").alias("t")), "bucket", "left").fillna(0, ["s", "t"])
    above = (F.col("t") + 1).cast("double") * F.lit(float(total["s"] + params.buckets))
    below = (F.col("s") + 1).cast("double") * F.lit(float(total["t"] + params.buckets))
    return sums.select("bucket", F.floor(F.lit(1000.0) * F.log(above / below)).cast("long").alias("gain"))


def noise(doc_id: str, seed: int) -> Column:
    """1000 times a standard Gumbel number, rounded down, from the first 32 bits of SHA-256 of ``seed:doc_id``."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(doc_id).cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(name.cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / F.lit(4294967296.0)))).cast("long")


def ranked(rows: DataFrame, by: list[Column], drawn: Column) -> DataFrame:
    """``rows`` with ``place``, the number from 1 in the order of ``by``, and ``n_drawn``, how many meet ``drawn``.

    A range shuffle sorts the rows over all partitions, whose sizes then give each partition its offset. The sorted rows are written
    first: a range shuffle draws its bounds anew whenever it is run, so only what was written has one order.
    """
    ordered = rows.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("_at", F.monotonically_increasing_id())
    ordered = materialize(ordered, "ordered").withColumn("_part", F.shiftright("_at", 33))
    sizes = ordered.groupBy("_part").agg(F.count("*").alias("_n"), F.count(F.when(drawn, 1)).alias("_d"))
    sizes = materialize(sizes.repartition(1), "sizes")  # a row for each partition of the shuffle
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    n_drawn = sizes.agg(F.coalesce(F.sum("_d"), F.lit(0)).alias("n")).first()["n"]
    place = F.col("_before") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)) + 1
    placed = ordered.join(small_side(offsets), "_part").withColumn("place", place).withColumn("n_drawn", F.lit(n_drawn).cast("long"))
    return placed.drop("_at", "_part", "_before")


def importance_resample(source: DataFrame, target: DataFrame, params: ResamplingParams = ResamplingParams()) -> DataFrame:
    """Documents of ``source`` (doc_id, text) drawn towards the bucket distribution of ``target`` (text).

    Returns a row for every row of ``source``: doc_id, n_features, weight (the sum of the gains of its features' buckets),
    score (weight and Gumbel noise) and rank, 1 for the highest score, null for what is not drawn. Of the N documents with
    ``min_words`` words or more, ``floor(percent * N / 100)`` are drawn; ties go to the smaller doc_id.

    The features of a document are summed before the shuffle, which then carries one row a document and task. Null, empty
    and wordless texts have no features and weight 0. A null doc_id hashes as the empty string and comes last among ties.
    Rows that repeat a doc_id are documents of their own. An empty source gives no rows; an empty target is all zero counts.
    Other columns are ignored.
    """
    rows = source.select("doc_id", "text")
    gains = small_side(materialize(gain_table(rows, target.select("text"), params).repartition(_files(params)), "gains"))
    keyed = rows.select(F.monotonically_increasing_id().alias("_row"), "doc_id", "text")
    keys = ["_row", "doc_id", "n_words", "n_features"]
    exploded = _features(keyed, params, "_row", "doc_id").select(
        "_row", "doc_id", "n_words", F.size("features").cast("long").alias("n_features"), F.explode_outer("features").alias("feature")
    ).withColumn("bucket", _bucket("feature", params))
    summed = exploded.join(gains, "bucket", "left").groupBy(*keys).agg(F.coalesce(F.sum("gain"), F.lit(0)).alias("weight"))
    scored = summed.select(
        "doc_id", "n_features", "weight", (F.col("weight") + noise("doc_id", params.seed)).alias("score"), (F.col("n_words") >= params.min_words).alias("open")
    )
    by = [F.col("open").desc(), F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("n_features").asc()]
    quota = F.expr(f"({params.percent} * n_drawn) div 100")
    rank = F.when(F.col("open") & (F.col("place") <= quota), F.col("place"))
    return ranked(scored, by, F.col("open")).select("doc_id", "n_features", "weight", "score", rank.alias("rank"))


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, weighed towards the texts of ``benchmark``, with the ranks of the drawn tenth: :func:`importance_resample`."""
    target = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    found = importance_resample(documents(spark, sf_dir), target)
    return found.select(*(F.col(c).cast("long").alias(c) for c in ("doc_id", "n_features", "weight", "score", "rank")))


#: The same result in SQL; the checksum's table comes from its polynomial.
OP13_SQL = r"""
WITH tab AS (
  SELECT list_transform(range(256), lambda i: list_reduce([0, 1, 2, 3, 4, 5, 6, 7],
    lambda acc, k: CASE WHEN acc % 2 = 1 THEN xor(acc // 2, 3988292384) ELSE acc // 2 END, i)) AS t),
dw AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
bw AS (
  SELECT regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
dc AS (SELECT w, count(*) AS n FROM (SELECT unnest(ws) AS w FROM dw) GROUP BY 1),
bc AS (SELECT w, count(*) AS n FROM (SELECT unnest(ws) AS w FROM bw) GROUP BY 1),
b AS (
  SELECT w, (4294967295 - list_reduce(list_transform(range(strlen(w)), lambda i: ('0x' || substr(hex(encode(w)), (2 * i + 1)::INT, 2))::BIGINT),
    lambda acc, x: xor(acc // 256, t[(xor(acc % 256, x) + 1)::INT]), 4294967295::BIGINT)) % 10000 AS bucket
  FROM (SELECT w FROM dc UNION SELECT w FROM bc), tab),
sums AS (
  SELECT bucket, coalesce(sum(dc.n), 0) AS s, coalesce(sum(bc.n), 0) AS t FROM b LEFT JOIN dc USING (w) LEFT JOIN bc USING (w) GROUP BY 1),
tot AS (SELECT coalesce(sum(s), 0) AS ss, coalesce(sum(t), 0) AS tt FROM sums),
gain AS (
  SELECT bucket, floor(1000 * ln((t + 1)::DOUBLE * (ss + 10000)::DOUBLE / ((s + 1)::DOUBLE * (tt + 10000)::DOUBLE)))::BIGINT AS gain FROM sums, tot),
wt AS (
  SELECT doc_id, sum(gain) AS weight FROM (SELECT doc_id, unnest(ws) AS w FROM dw) JOIN b USING (w) JOIN gain USING (bucket) GROUP BY 1),
h AS (
  SELECT doc_id, len(ws) AS n, ('0x' || substr(sha256('2024:' || doc_id), 1, 8))::BIGINT AS h FROM dw),
sc AS (
  SELECT doc_id, n, coalesce(weight, 0)::BIGINT AS weight,
    (coalesce(weight, 0) + floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296::DOUBLE))))::BIGINT AS score FROM h LEFT JOIN wt USING (doc_id)),
r AS (
  SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank, count(*) OVER () AS total FROM sc WHERE n >= 20)
SELECT doc_id, n::BIGINT AS n_features, weight, score, CASE WHEN rank <= 10 * total // 100 THEN rank END::BIGINT AS rank
FROM sc LEFT JOIN r USING (doc_id)
"""
