"""Held-out accuracy on labelled rows, and the defined results of odd rows."""

import zlib

from trellisway.llm.toxicity import fit, ftrl, op7_toxicity, score, scored_rows, ToxicityParams

from .helpers import ODD, frame, prose

import numpy as np


def test_held_out_rows(spark):
    sf_dir = "/root/testdata/sf0.01"
    marks = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    found = op7_toxicity(spark, sf_dir).collect()
    assert len(found) == spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    for r in found:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5)
    held = [(marks[r.doc_id], r.predicted) for r in found if r.held_out and marks.get(r.doc_id) is not None]
    assert len(held) >= 20
    assert sum(a == b for a, b in held) >= 0.95 * len(held)
    clean = [b for a, b in held if a == 0]
    assert sum(clean) <= 0.02 * len(clean) + 1


def test_planted_words_and_odd_rows(spark):
    params = ToxicityParams(l1=1.0, min_rows=2)
    rows = [(i, prose(i, 20) + (" you vile horrid fool" if i % 4 == 0 else "")) for i in range(200)]
    docs = frame(spark, rows + ODD)
    labels = spark.createDataFrame([(i, int(i % 4 == 0), None) for i, _ in rows] + [(None, 1, 1), (901, None, 1)], "doc_id long, toxic int, quality int")
    model = fit(docs, labels, params)
    assert 0 < len(model[0]) < 1 << 12  # L1 leaves few weights
    found = score(docs, model, params).collect()
    assert len(found) == len(rows) + len(ODD)
    by = {r.doc_id: r.score for r in found}
    assert all((by[i] >= 0.5) == (i % 4 == 0) for i, _ in rows)
    assert by[900] == by[901] == by[909] < 0.5
    kept = scored_rows(docs, model, params)
    assert sorted(kept.columns) == sorted(docs.columns)


def test_without_labels(spark):
    docs = frame(spark, ODD)
    none = spark.createDataFrame([], "doc_id long, toxic int")
    model = fit(docs, none)
    assert len(model[0]) == 0
    assert all(r.score == 0.5 for r in score(docs, model).collect())
    assert score(frame(spark, []), model).count() == 0


def test_ftrl_is_sparse():
    draw = np.random.default_rng(0)
    rows = [np.unique(draw.integers(0, 200, 20)) for _ in range(400)]
    labels = np.array([float(7 in r) for r in rows])
    used = []
    for l1 in (0.5, 4.0, 16.0):
        w = ftrl(rows, labels, ToxicityParams(bits=8, l1=l1))
        assert w[7] == w.max() > 1
        used.append(np.count_nonzero(w))
    assert used[0] > used[1] > used[2] and used[2] < 40


def plain_ftrl(rows, labels, params):
    """The update rules one coordinate at a time."""
    z, n, share = {}, {}, sum(labels) / len(labels)
    last = 1 << params.bits

    def weight(i):
        l1 = 0.0 if i == last else params.l1
        v = z.get(i, 0.0)
        if abs(v) <= l1:
            return 0.0
        return -(v - (l1 if v > 0 else -l1)) / ((params.beta + n.get(i, 0.0) ** 0.5) / params.alpha + params.l2)

    order = np.random.default_rng(5)
    for _ in range(params.epochs):
        for k in order.permutation(len(rows)):
            at = [*rows[k].tolist(), last]
            w = {i: weight(i) for i in at}
            g = (1 / (1 + np.exp(-sum(w.values()))) - labels[k]) * (0.5 / share if labels[k] else 0.5 / (1 - share))
            for i in at:
                before = n.get(i, 0.0)
                n[i] = before + g * g
                z[i] = z.get(i, 0.0) + g - (n[i] ** 0.5 - before**0.5) / params.alpha * w[i]
    return {i: w for i in z if (w := weight(i))}


def test_ftrl_against_plain_updates():
    draw = np.random.default_rng(1)
    rows = [np.unique(draw.integers(0, 60, draw.integers(0, 15))) for _ in range(150)]
    labels = np.array([float(7 in r or draw.random() < 0.1) for r in rows])
    params = ToxicityParams(bits=6, l1=0.7)
    got, want = ftrl(rows, labels, params), plain_ftrl(rows, labels, params)
    assert set(np.flatnonzero(got).tolist()) == set(want) and 5 < len(want) < 60
    assert all(abs(got[i] - w) < 1e-9 for i, w in want.items())
