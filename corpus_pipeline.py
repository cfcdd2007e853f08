"""The corpus pipeline: toxicity, line dedup, near-duplicate dedup, personal data, packing.

Every stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame; all but the last return the columns of ``documents``.
:func:`run` writes each stage's rows as Parquet in the shared folder and reads them again for the next.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trellisway.llm import lines, minhash, packing, pii, toxicity
from trellisway.llm.common import documents, new_path, remove_path, scratch, written


def _columns(docs: DataFrame, like: DataFrame) -> DataFrame:
    """The columns of ``like``; n_chars is that of the text as it is now."""
    chars = F.char_length("text").cast(like.schema["n_chars"].dataType) if "n_chars" in like.columns else None
    return docs.select(*(chars.alias(c) if c == "n_chars" else F.col(c) for c in like.columns))


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below 0.5, with all their columns. Each row is scored once, beside its own columns; null
    and empty texts score by the intercept alone, and repeated rows and null doc_ids are judged row by row."""
    model, name = toxicity.fit_on_labels(spark, sf_dir), "_score"
    while name in docs.columns:
        name = f"_{name}"
    return toxicity.scored_rows(docs, model, name=name).filter(F.col(name) < 0.5).drop(name)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that stand elsewhere; a document that loses its last line with a word goes.

    Null, empty and blank texts have no line to lose and stay as they are; rows that repeat a doc_id are documents of their own.
    """
    return _columns(lines.dedup_lines(docs).filter("not _emptied"), docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates; those without a word and those without a doc_id stay.

    Rows that repeat a doc_id are one document, and go or stay together.
    """
    return minhash.near_dedup(docs)


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data replaced by the name of its kind; null and empty texts stay, and every row is searched by itself."""
    return _columns(pii.redact(docs), docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of 2048 tokens; null and empty texts are the end id alone."""
    return packing.pack(docs, public_tokenizers.path(packing.VOCABULARY))


STAGES = [
    ("toxicity", reject_toxic),
    ("line_dedup", drop_repeated_lines),
    ("near_dedup", drop_near_duplicates),
    ("pii", redact_personal_data),
    ("packing", pack_sequences),
]

#: SQL cannot express the stages; tests hold them against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over all ``documents``.

    What a stage writes on its way goes when its rows are written, and a stage's rows go when the next one's are; the last table stays.
    """
    docs, before = documents(spark, sf_dir), None
    for name, stage in STAGES:
        path = new_path(spark, f"stage-{name}")
        with scratch(spark):
            docs = written(stage(spark, docs, sf_dir), path)
        if before is not None:
            remove_path(spark, before)
        before = path
    return docs
