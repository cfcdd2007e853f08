"""The pipeline's stages: decisions take effect, columns stay, clean documents stay."""

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline", exc_type=ModuleNotFoundError)

from trellisway.llm.common import materialize  # noqa: E402

from .helpers import ODD, frame, prose  # noqa: E402


def test_stages_one_by_one(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, before = docs.columns, docs.count()
    seen = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"test-{name}")
        assert docs.columns == columns
        seen[name] = docs.count()
    assert before >= seen["toxicity"] >= seen["line_dedup"] >= seen["near_dedup"] == seen["pii"] > 0.5 * before
    texts = {r.doc_id: r for r in docs.collect()}
    assert all(r.text is None or r.n_chars == len(r.text) for r in texts.values())
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir)
    assert {r.doc_id for r in packed.select("doc_id").distinct().collect()} == set(texts)


def test_odd_rows_pass_through_every_stage(spark, sf_dir):
    rows = ODD + [(i, prose(i, 40)) for i in range(20)] + [(30, prose(3, 40) + " extra"), (31, "mail me at a.b@example.org about " + prose(9, 20))]
    docs = frame(spark, rows)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"odd-{name}")
        assert docs.columns == frame(spark, []).columns  # a column named toxicity among them
    left = {r.doc_id: r for r in docs.collect()}
    assert set(range(20)) <= set(left) and 31 in left and 30 not in left
    assert "[EMAIL]" in left[31].text and left[31].n_chars == len(left[31].text)
    assert 900 in left and 901 in left  # nothing to object to


def test_no_documents(spark, sf_dir):
    docs = frame(spark, [])
    for name, stage in corpus_pipeline.STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"none-{name}")
    assert docs.count() == 0
