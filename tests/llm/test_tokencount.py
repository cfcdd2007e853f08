"""Counts of flat streams against the stream itself, with blocks that cut documents anywhere."""

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from trellisway.llm import tokencount as T

from .helpers import ODD, frame


def plain(tokens, end_id):
    out, at = [], 0
    for stop in np.flatnonzero(tokens == end_id).tolist():
        out.append((len(out), at, stop - at, True))
        at = stop + 1
    if at < len(tokens):
        out.append((len(out), at, len(tokens) - at, False))
    return out


@pytest.mark.parametrize("run", [2, 4096])
def test_streams(spark, monkeypatch, run):
    monkeypatch.setattr(T, "RUN", run)
    draw = np.random.default_rng(4)
    rows, want = [], set()
    for file in range(6):
        tokens = np.where(draw.random(700) < [0.1, 0.001, 0.5, 0, 1, 0.02][file], 9, draw.integers(10, 90, 700)).astype("<u2")
        want |= {(file, *x) for x in plain(tokens, 9)}
        cuts = [0, *sorted(draw.integers(0, 700, 12).tolist()), 700]  # equal cuts give empty blocks
        rows += [(file, i, tokens[a:b].tobytes()) for i, (a, b) in enumerate(zip(cuts, cuts[1:]))]
    blocks = spark.createDataFrame(rows, "file long, block long, payload binary").repartition(5)
    assert {tuple(r) for r in T.count_tokens(blocks, 9).collect()} == want


def test_no_blocks(spark):
    assert T.count_tokens(spark.createDataFrame([], "file long, block long, payload binary")).count() == 0


def test_raw_files(spark, tmp_path):
    tokens = np.array([5, 6, T.END_ID, T.END_ID, 7], "<u2")
    (tmp_path / "a.bin").write_bytes(tokens.tobytes())
    (tmp_path / "b.bin").write_bytes(b"")
    found = T.count_tokens(T.read_flat_files(spark, str(tmp_path), 4)).collect()
    assert sorted((r.ordinal, r.start, r.n_tokens, r.closed) for r in found) == [(0, 0, 2, True), (1, 3, 0, True), (2, 4, 1, False)]


def lib():
    t = Tokenizer.from_file(public_tokenizers.path(T.VOCABULARY))
    t.encode_special_tokens = True
    return t


def test_query(spark, sf_dir):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    found = T.op2_token_counts(spark, sf_dir).collect()
    assert len(found) == len(texts)
    encode = lib()
    for r in found:
        assert r.n_tokens == len(encode.encode(texts[r.doc_id], add_special_tokens=False).ids)


def test_odd_rows(spark, tmp_path):
    rows = [*ODD, (950, "a <|endoftext|> inside")]
    manifest = T.write_flat(frame(spark, rows).repartition(4), public_tokenizers.path(T.VOCABULARY), folder=f"file://{tmp_path}/own")
    counted = T.count_tokens(T.read_flat_files(spark, str(tmp_path / "own"), 1000))  # blocks that cut documents anywhere
    assert counted.filter("closed").count() == len(rows) == counted.count()
    encode = lib()
    assert sorted(r.n_tokens for r in counted.collect()) == sorted(len(encode.encode(t or "", add_special_tokens=False).ids) for _, t in rows)
    ids = [i for r in manifest.filter("ids is not null").collect() for i in r.ids]
    assert sorted(ids, key=str) == sorted((i for i, _ in rows), key=str)


def test_no_documents(spark):
    manifest = T.write_flat(frame(spark, []), public_tokenizers.path(T.VOCABULARY))
    assert manifest.count() == 0
    assert T.count_tokens(T.read_ranges(manifest.select("file", manifest["bytes"].alias("length")))).count() == 0
