"""Every id of every document in exactly one place, in windows without gaps."""

import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from trellisway.llm.packing import VOCABULARY, PackingParams, op9_packing, pack

from .helpers import ODD, frame, prose

PATH = public_tokenizers.path(VOCABULARY)


def ids_of(lib, text):
    return np.array([*lib.encode(text or "", add_special_tokens=False).ids, 1], "<u4")


def check(pieces, texts, window):
    lib = Tokenizer.from_file(PATH)
    by_doc, by_window = defaultdict(list), defaultdict(list)
    for p in pieces:
        by_doc[p.doc_id].append(p)
        by_window[p.sequence_id].append(p)
    assert set(by_doc) == set(texts)
    total = 0
    for doc_id, own in by_doc.items():
        ids, copies = ids_of(lib, texts[doc_id][0]), len(texts[doc_id])
        total += len(ids) * copies
        starts = sorted((p.start, p.length) for p in own)
        assert starts == sorted([(s, min(window, len(ids) - s)) for s in range(0, len(ids), window)] * copies)
        for p in own:
            assert p.doc_tokens == len(ids)
            assert p.ids_crc32 == zlib.crc32(ids[p.start : p.start + p.length].tobytes())
    for own in by_window.values():
        at = 0
        for p in sorted(own, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= window
    return total, len(by_window)


def test_odd_and_small_windows(spark):
    rows = ODD + [(i, prose(i, 5 + 7 * i % 300)) for i in range(200)]
    texts = defaultdict(list)
    for i, t in rows:
        texts[i].append(t)
    params = PackingParams(window=256, open_windows=4)
    total, windows = check(pack(frame(spark, rows).repartition(3), PATH, params).collect(), texts, 256)
    assert windows * 256 <= 1.25 * total


def test_query(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    total, windows = check(op9_packing(spark, sf_dir).collect(), {r.doc_id: [r.text] for r in docs}, 2048)
    assert (windows - 4) * 2048 <= 1.02 * total  # a few leftovers, however large the table


def test_empty_table(spark):
    assert pack(frame(spark, []), PATH).count() == 0
