"""Importance resampling against plain counts."""

import hashlib
import math
import re
import zlib
from collections import Counter

import duckdb
import pytest

from trellisway.llm.importance import OP13_SQL, ResamplingParams, importance_resample, op13_importance_resampling

from .helpers import ODD, frame, prose


def features(text, least, most):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)
    return words, [" ".join(words[i : i + n]) for n in range(least, most + 1) for i in range(len(words) - n + 1)]


def expected(rows, target, p):
    def counts(texts):
        return Counter(zlib.crc32(f.encode()) % p.buckets for t in texts for f in features(t, p.least, p.most)[1])

    s, t = counts(t for _, t in rows), counts(target)
    total, wanted = sum(s.values()) + p.buckets, sum(t.values()) + p.buckets
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * total / ((s[b] + 1) * wanted))) for b in s}
    scored = []
    for doc_id, text in rows:
        words, own = features(text, p.least, p.most)
        weight = sum(gain[zlib.crc32(f.encode()) % p.buckets] for f in own)
        h = int(hashlib.sha256(f"{p.seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        scored.append((len(words) >= p.min_words, doc_id, len(own), weight, score))
    order = sorted((r for r in scored if r[0]), key=lambda r: (-r[4], math.inf if r[1] is None else r[1], r[2]))
    quota = p.percent * len(order) // 100
    drawn = [(*r[1:], i + 1 if i < quota else None) for i, r in enumerate(order)]
    return sorted(drawn + [(*r[1:], None) for r in scored if not r[0]], key=str)


ROWS = [*ODD, *((i, prose(i, 10 + i % 40)) for i in range(200)), (950, "İSTANBUL ÀB 12ab-cd_ef  ＡＢ " * 9), (951, "\x00a\x7fb " * 30)]


@pytest.mark.parametrize("params", [ResamplingParams(), ResamplingParams(least=1, most=2, buckets=97, percent=33, min_words=15, seed=5), ResamplingParams(least=3, most=3)])
def test_against_counts(spark, params):
    target = [prose(i, 30) for i in range(0, 40, 3)] + [None, "", "new words in here"]
    source = frame(spark, ROWS).repartition(5)
    found = importance_resample(source, spark.createDataFrame([(t,) for t in target], "text string"), params)
    assert sorted((tuple(r[c] for c in ("doc_id", "n_features", "weight", "score", "rank")) for r in found.collect()), key=str) == expected(ROWS, target, params)


def test_no_rows(spark):
    empty = frame(spark, [])
    assert importance_resample(empty, empty).count() == 0
    some = importance_resample(frame(spark, ROWS), empty).collect()
    assert sorted((tuple(r[c] for c in ("doc_id", "n_features", "weight", "score", "rank")) for r in some), key=str) == expected(ROWS, [], ResamplingParams())


def test_query_against_sql(spark, sf_dir):
    con = duckdb.connect()
    for name in ("documents", "benchmark"):
        con.execute(f"create view {name} as select * from read_parquet('{sf_dir}/{name}.parquet')")
    cur = con.execute(OP13_SQL)
    names = [d[0] for d in cur.description]
    want = sorted(map(str, cur.fetchall()))
    assert sorted(str(tuple(r[n] for n in names)) for r in op13_importance_resampling(spark, sf_dir).collect()) == want


def test_plan_has_no_python(spark, sf_dir):
    plan = op13_importance_resampling(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
