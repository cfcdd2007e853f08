"""Alignment against plain offsets of the libraries' own tokens."""

import hashlib
import random
from collections import Counter, defaultdict

import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from trellisway.llm.alignment import BYTE_VOCABULARY, PIECE_VOCABULARY, Aligner, AlignmentParams, aligned, op12_token_alignment
from trellisway.llm.bytebpe import byte_alphabet

from .helpers import ODD, frame, prose

A, B = public_tokenizers.path(BYTE_VOCABULARY), public_tokenizers.path(PIECE_VOCABULARY)

ODD_TEXTS = [
    " leading", "trailing  ", "two  spaces   three", "line\nbreak \n and\t tab", "▁ piece ▁▁", "<s> </s> <unk> <|endoftext|>", "<0x41> byte",
    "漢字 かな 한국어", "é à ﬁ ½ ́‍", "\U0001f600\U0001f468‍\U0001f469", "a\x00b\x01", "     ", "\n \n  \n", "don't I'll 12345 ... !!!", "﻿　x",
    "ﷺ" * 40, "\x7f\x80\x85\xa0", "e" * 3000, " " * 500 + "x",
]


def library_tokens(lib, pieces, text):
    """(id, bytes) of both sides from the libraries, or nothing."""
    back = byte_alphabet()
    coded = lib.encode(" " + text, add_special_tokens=False)
    a = [(i, bytes(back[c] for c in lib.id_to_token(i))) for i in coded.ids]
    b = []
    for i in pieces.encode(text):
        p = pieces.id_to_piece(i)
        b.append((i, bytes([int(p[3:5], 16)]) if pieces.is_byte(i) else p.replace("▁", " ").encode()))
    want = (" " + text).encode()
    return (a, b) if b"".join(x for _, x in a) == want == b"".join(x for _, x in b) else ([], [])


@pytest.fixture(scope="module")
def libraries():
    lib = Tokenizer.from_file(A)
    lib.encode_special_tokens = True
    return lib, sentencepiece.SentencePieceProcessor(model_file=B)


def expected(rows, libraries):
    shapes, counts = [], Counter()
    for doc_id, text in rows:
        a, b = library_tokens(*libraries, text) if text else ([], [])
        groups, i, j = [], 0, 0
        while i < len(a):
            one, two = [a[i][0]], [b[j][0]]
            at_a, at_b = len(a[i][1]), len(b[j][1])
            i, j = i + 1, j + 1
            while at_a != at_b:
                if at_a < at_b:
                    one.append(a[i][0])
                    at_a += len(a[i][1])
                    i += 1
                else:
                    two.append(b[j][0])
                    at_b += len(b[j][1])
                    j += 1
            groups.append((one, two))
        linked = Counter((x, y) for one, two in groups for x in one for y in two)
        counts.update(set(linked))
        shapes.append((doc_id, len(a), len(b), groups, linked))
    highest = defaultdict(int)
    for (x, _), n in counts.items():
        highest[x] = max(highest[x], n)
    for doc_id, n_a, n_b, groups, linked in shapes:
        text = ";".join(",".join(map(str, one)) + "|" + ",".join(map(str, two)) for one, two in groups)
        digest = hashlib.sha256(text.encode()).hexdigest() if n_a else ""
        best = sum(n for p, n in linked.items() if counts[p] == highest[p[0]])
        yield doc_id, n_a, n_b, len(groups), sum(linked.values()), best, sum(n * counts[p] for p, n in linked.items()), digest


COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def compare(found, rows, libraries):
    key = lambda r: tuple(map(str, r))
    assert sorted((tuple(r[c] for c in COLUMNS) for r in found), key=key) == sorted(expected(rows, libraries), key=key)


@pytest.mark.parametrize("params", [AlignmentParams(), AlignmentParams(block_pairs=300, block_rows=7, batch_bytes=400)])
def test_against_offsets(spark, libraries, params):
    rows = [*ODD, *((1000 + i, t) for i, t in enumerate(ODD_TEXTS)), *((i, prose(i, 60)) for i in range(30))]
    compare(aligned(frame(spark, rows).repartition(3), A, B, params).collect(), rows, libraries)


def test_query(spark, sf_dir, libraries):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    compare(op12_token_alignment(spark, sf_dir).collect(), rows, libraries)


def test_tokens_equal_the_libraries(libraries):
    aligner, draw = Aligner(A, B), random.Random(5)
    alphabet = [*"abcdeé ß  \n\t.,'▁漢\U0001f600\x00\xa0​012", "the", " and", "ing", "<s>", "  "]
    for _ in range(3000):
        text = "".join(draw.choice(alphabet) for _ in range(draw.randrange(1, 30)))
        a, b = aligner.tokens(text)
        want = library_tokens(*libraries, text)
        assert [*memoryview(a).cast("I")] == [i for i, _ in want[0]] and [*memoryview(b).cast("I")] == [i for i, _ in want[1]], repr(text)


def test_empty_table(spark):
    assert aligned(frame(spark, []), A, B).count() == 0
