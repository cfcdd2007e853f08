"""Quality rules: text statistics and robust multivariate outliers per language and source, in DataFrame functions only."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, materialize, small_side

SPACE = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"

#: The statistic vector: name and the least standard deviation it is given, in its transformed unit.
VECTOR = {
    "mean_word": 0.15,  # ln of code points per word
    "symbols": 0.50,  # ln(1 + 100 * symbols per character of words)
    "dup_lines": 0.12,  # square root of the share of lines that repeat an earlier one
    "repeats": 0.12,  # square root of the share of words in repeated windows
    "upper": 0.20,  # square root of the share of capital letters
    "marks": 0.50,  # ln(1 + 100 * exclamation and question marks per character of words)
}


@dataclass(frozen=True)
class QualityParams:
    """``subset`` is the share of a group that the minimum-covariance-determinant steps fit, ``cutoff`` the chance that a
    regular row lies inside the distance that is kept. A covariance needs rows: those of a language and source with fewer than
    ``min_group`` rows that meet the base rules are judged by the fit of their language, or of all rows. Steps end
    when no group's log determinant moves by ``tolerance``, or after ``steps``."""

    subset: float = 0.75
    steps: int = 12
    tolerance: float = 1e-3
    cutoff: float = 0.99999
    min_group: int = 60


def chi2_cdf(x: float, k: int) -> float:
    """Distribution function of chi-square by its series."""
    if x <= 0:
        return 0.0
    a, y = k / 2, x / 2
    term = total = 1 / a
    n = 0
    while term > total * 1e-15:
        n += 1
        term *= y / (a + n)
        total += term
    return total * math.exp(-y + a * math.log(y) - math.lgamma(a))


def chi2_quantile(p: float, k: int) -> float:
    low, high = 0.0, 1000.0
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if chi2_cdf(mid, k) < p else (low, mid)
    return low


def consistency(share: float, k: int) -> float:
    """Factor by which the covariance of a normal sample's nearest ``share`` falls short."""
    return share / chi2_cdf(chi2_quantile(share, k), k + 2)


def statistics(docs: DataFrame) -> DataFrame:
    """Adds the counts of :func:`quality` to ``docs`` (with a string column text), each row by itself.

    The five-word windows of a text are hashed to 64 bits; only in texts where a hash repeats, the places of repeated
    windows are sorted and the words they cover are counted.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    words = F.filter(F.split(text, SPACE), lambda w: w != "")
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    one = docs.withColumns({"_words": words, "_lines": lines})
    n = F.size("_words")
    windows = F.when(n >= 5, F.transform(F.sequence(F.lit(1), n - 4), lambda i: F.xxhash64(F.slice("_words", i, 5)))).otherwise(
        F.array().cast("array<bigint>")
    )
    two = one.select(
        *docs.columns, n.cast("long").alias("n_words"),
        F.char_length(F.array_join("_words", "")).cast("long").alias("word_chars"),
        F.size("_lines").cast("long").alias("n_lines"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.regexp_count(text, F.lit(f"[{SYMBOLS}]")).cast("long").alias("n_symbols"),
        F.regexp_count(text, F.lit(r"\p{Lu}")).alias("_upper"), F.regexp_count(text, F.lit("[!?]")).alias("_marks"),
        windows.alias("_windows"),
    )
    repeats = F.size("_windows") > F.size(F.array_distinct("_windows"))
    placed = F.when(repeats, F.array_sort(F.transform("_windows", lambda h, i: F.struct(h.alias("h"), i.alias("i")))))
    three = two.withColumn("_placed", placed).drop("_windows")
    same = F.filter("_placed", lambda e, k: (e["h"] == F.get("_placed", k - 1)["h"]) | (e["h"] == F.get("_placed", k + 1)["h"]))
    four = three.withColumn("_starts", F.array_sort(F.transform(same, lambda e: e["i"]))).drop("_placed")
    covered = F.aggregate(
        F.transform("_starts", lambda s, k: F.least(F.lit(5), F.coalesce(F.get("_starts", k + 1) - s, F.lit(5)))), F.lit(0), lambda a, b: a + b
    )
    return four.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long")).drop("_starts")


def _vector() -> dict[str, Column]:
    chars, n = F.greatest("word_chars", F.lit(1)), F.greatest("n_words", F.lit(1))
    return {
        "mean_word": F.log(chars / n),
        "symbols": F.log1p(100 * F.col("n_symbols") / chars),
        "dup_lines": F.sqrt(F.col("n_dup_lines") / F.greatest("n_lines", F.lit(1))),
        "repeats": F.sqrt(F.col("n_repeat_words") / n),
        "upper": F.sqrt(F.col("_upper") / chars),
        "marks": F.log1p(100 * F.col("_marks") / chars),
    }


def _grouped(rows: DataFrame, params: QualityParams) -> DataFrame:
    """Adds ``grp``, whose fit judges the row, and ``feeds``, the groups that the row is fitted in.

    Groups are a language and source, a language with all its sources, and all rows. A row is judged by the narrowest of its
    three that has ``min_group`` rows which meet the base rules, else by all rows. A null language or source is a
    value of its own. Levels are told apart by the number of parts.
    """
    part = lambda c, n: F.coalesce(F.col(c).cast("string"), F.lit("\0")).alias(n)
    rows = rows.withColumns({"_pair": F.to_json(F.struct(part("lang", "l"), part("source", "s"))), "_lang": F.to_json(F.struct(part("lang", "l")))})
    good = F.sum(F.when(F.col("base_failed"), 0).otherwise(1))
    pairs = materialize(rows.groupBy("_pair", "_lang").agg(good.alias("n")), "pairs")
    langs = pairs.groupBy("_lang").agg(F.sum("n").alias("n_lang"), F.min("n").alias("least"))
    known = pairs.join(langs, "_lang")
    few = lambda c: F.col(c) < params.min_group
    all_rows = not langs.filter(few("n_lang")).isEmpty()
    judge = F.when(~few("n"), F.col("_pair")).when(~few("n_lang"), F.col("_lang")).otherwise(F.lit("all"))
    feeds = [F.when(~few("n"), F.col("_pair")), F.when(few("least") & ~few("n_lang"), F.col("_lang")), F.lit("all" if all_rows else None).cast("string")]
    named = materialize(known.select("_pair", judge.alias("grp"), F.array_compact(F.array(*feeds)).alias("feeds")), "groups")
    return rows.join(small_side(named), "_pair").drop("_pair", "_lang")


def _fit(rows: DataFrame, inside: Column, factor: float) -> DataFrame:
    """Mean and Cholesky factor of the covariance of each group's rows that meet a condition, one row a group.

    The covariance is scaled by the consistency factor, and the squared floors of VECTOR are added to its diagonal,
    so that a statistic which is constant in the subset doesn't make every other value an outlier.
    """
    names = list(VECTOR)
    moments = [F.avg(F.when(inside, F.col(a))).alias(f"m_{a}") for a in names]
    moments += [F.avg(F.when(inside, F.col(a) * F.col(b))).alias(f"s_{a}_{b}") for i, a in enumerate(names) for b in names[: i + 1]]
    table = rows.groupBy("grp").agg(*moments)
    for i, a in enumerate(names):
        row = {}
        for j, b in enumerate(names[: i + 1]):
            cov = (F.col(f"s_{a}_{b}") - F.col(f"m_{a}") * F.col(f"m_{b}")) * factor
            if i == j:
                cov = F.greatest(cov, F.lit(0.0)) + VECTOR[a] ** 2
            for k in range(j):
                left = row[names[k]] if names[k] in row else F.col(f"l_{a}_{names[k]}")
                right = left if i == j else F.col(f"l_{b}_{names[k]}")
                cov = cov - left * right
            value = F.sqrt(F.greatest(cov, F.lit(1e-6))) if i == j else cov / F.col(f"l_{b}_{b}")
            table = table.withColumn(f"l_{a}_{b}", value)
    keep = ["grp", *(f"m_{a}" for a in names), *(f"l_{a}_{b}" for i, a in enumerate(names) for b in names[: i + 1])]
    return materialize(table.select(*keep), "fit")


def _distance(rows: DataFrame, fit: DataFrame) -> DataFrame:
    """Adds ``d2``, the squared Mahalanobis distance to the row's group, by forward substitution."""
    names = list(VECTOR)
    joined = rows.join(small_side(fit, 100_000), "grp")
    total = F.lit(0.0)
    for i, a in enumerate(names):
        value = F.col(a) - F.col(f"m_{a}")
        for b in names[:i]:
            value = value - F.col(f"l_{a}_{b}") * F.col(f"_z_{b}")
        joined = joined.withColumn(f"_z_{a}", value / F.col(f"l_{a}_{a}"))
        total = total + F.col(f"_z_{a}") * F.col(f"_z_{a}")
    return joined.withColumn("d2", total).drop(*(c for c in joined.columns if c.startswith(("m_", "l_", "_z_"))))


def _cut(rows: DataFrame, share: float) -> DataFrame:
    """Adds ``edge``, the distance within which ``share`` of the row's group lies."""
    edges = materialize(rows.groupBy("grp").agg(F.percentile_approx("d2", share, 10_000).alias("edge")), "edges")
    return rows.join(small_side(edges), "grp")


def quality(docs: DataFrame, params: QualityParams = QualityParams()) -> DataFrame:
    """Statistics and verdict of every row of ``docs`` (doc_id, text, lang, source).

    Returns doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, d2 and grp. base_failed
    holds the two fixed rules. The others are judged by distance: the transformed statistic vectors of each language and
    source, rows that failed left out, are fitted by minimum-covariance-determinant steps. They start from medians and
    median deviations, take the nearest ``subset`` of the group, refit until the determinants settle, and end with one fit of
    all rows inside the 97.5 % distance. A row is kept if it is inside the ``cutoff`` distance of the group that judges it
    (:class:`QualityParams`). All steps are aggregates with partial sums and joins with one row per group.

    Null and empty texts have no words, fail and have no distance. Null languages and sources are groups like others.
    Repeated rows and null doc_ids are judged row by row. An empty table gives no rows.
    """
    names = list(VECTOR)
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang", "source")
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    counted = statistics(own).drop("text").withColumns(_vector()).withColumn("base_failed", failed)
    rows = _grouped(materialize(counted, "statistics"), params)
    rows = materialize(rows, "grouped")
    good = rows.filter("not base_failed").select(F.explode("feeds").alias("grp"), *names)
    middle = good.groupBy("grp").agg(*[F.percentile_approx(a, 0.5, 10_000).alias(f"c_{a}") for a in names])
    middle = small_side(materialize(middle, "medians"))
    away = good.join(middle, "grp")
    spread = away.groupBy("grp").agg(*[F.percentile_approx(F.abs(F.col(a) - F.col(f"c_{a}")), 0.5, 10_000).alias(f"w_{a}") for a in names])
    spread = small_side(materialize(spread, "spreads"))
    scaled = [((F.col(a) - F.col(f"c_{a}")) / F.greatest(1.4826 * F.col(f"w_{a}"), F.lit(VECTOR[a]))) for a in names]
    start = away.join(spread, "grp").select("grp", *names, sum((s * s for s in scaled), F.lit(0.0)).alias("d2"))
    current, k, before = start, len(names), None
    size = sum((F.log(f"l_{a}_{a}") for a in names), F.lit(0.0)).alias("size")
    for _ in range(params.steps):
        current = _cut(current, params.subset)
        fit = _fit(current, F.col("d2") <= F.col("edge"), consistency(params.subset, k))
        current = _distance(good, fit).select("grp", *names, "d2")
        if before is not None:
            moved = fit.select("grp", size).join(before.select("grp", size.alias("old")), "grp").agg(F.max(F.abs(2 * (F.col("size") - F.col("old")))))
            if (moved.first()[0] or 0.0) < params.tolerance:
                break
        before = fit
    fit = _fit(current, F.col("d2") <= chi2_quantile(0.975, k), consistency(0.975, k))
    judged = _distance(rows.filter("not base_failed"), fit).withColumn("kept", F.col("d2") <= chi2_quantile(params.cutoff, k))
    rest = rows.filter("base_failed").withColumns({"d2": F.lit(None).cast("double"), "kept": F.lit(False)})
    out = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "d2", "grp"]
    return judged.select(*out).unionByName(rest.select(*out))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and verdict of every document by :func:`quality`; null and empty texts have no words and fail."""
    return quality(documents(spark, sf_dir))
