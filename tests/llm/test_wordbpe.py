"""Exact encodings and decodings against the tokenizers library."""

import hashlib
import random

import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from trellisway.llm.wordbpe import VOCABULARY, coder, op8_bpe

from .helpers import ODD

PATH = public_tokenizers.path(VOCABULARY)


def library():
    t = Tokenizer.from_file(PATH)
    t.no_truncation()
    t.no_padding()
    return t


def ids_of(data):
    return [int.from_bytes(data[i : i + 4], "little") for i in range(0, len(data), 4)]


def test_query_on_whole_texts(spark, sf_dir):
    lib = library()
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    found = op8_bpe(spark, sf_dir).collect()
    assert len(found) == len(texts)
    for r in found:
        ids = lib.encode(texts[r.doc_id], add_special_tokens=False).ids
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(lib.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_odd_texts():
    lib, own = library(), coder(PATH)
    more = ["a<|endoftext|>b", "<|startoftext|>", "it's we'll 'tis", "ΟΔΥΣΣΕΥΣ", "é ẛ̣", "\x1c\x1d a\x85b", "İstanbul ﬁ", "'" * 4000, "ab" * 30_000, ":\U0003d000", "\u1c89 \ua7cb", "!\u0558x", "\U00010d50a"]
    for text in [t or "" for _, t in ODD] + more:
        assert ids_of(own.encode(text)) == lib.encode(text, add_special_tokens=False).ids, text[:50]


@settings(max_examples=400, deadline=None)
@given(st.text(st.characters(exclude_categories=["Cs"]), max_size=60) | st.text("abtheisng ERS'<|endoftx>0", max_size=80))
def test_any_text(text):
    lib, own = library_once(), coder(PATH)
    ids = lib.encode(text, add_special_tokens=False).ids
    assert ids_of(own.encode(text)) == ids


_one = []


def library_once():
    if not _one:
        _one.append(library())
    return _one[0]


def test_marks_and_rare_letters():
    lib, own, draw = library(), coder(PATH), random.Random(1)
    marks = [chr(c) for c in [*range(0x300, 0x370), *range(0x93C, 0x94E), 0x130, 0x3A3, 0x3C2, 0x10238, 0x1E9B, 0x1AC3, 0x89F, 0x1C, 0xA0, 0x2028, 0x85, 0x200B, 0x1100, 0x1161]]

    def text():
        part = [lambda: draw.choice(marks), lambda: chr(draw.randrange(0x20, 0x7F)), lambda: chr(draw.randrange(0x80, 0x3000)), lambda: chr(draw.randrange(0xE000, 0x1FA00))]
        return "".join(draw.choices(part, [45, 30, 15, 10])[0]() for _ in range(draw.randrange(1, 9)))

    texts = ["\U00010238\u0130\u094d", *(text() for _ in range(100_000))]
    for x, e in zip(texts, lib.encode_batch(texts, add_special_tokens=False)):
        assert ids_of(own.encode(x)) == e.ids, [hex(ord(c)) for c in x]
