"""BPE encoding by backtracking over Aho-Corasick matches, and decoding by an offset table."""

from __future__ import annotations

import json
import re

import ahocorasick
import numpy as np
import pyarrow as pa
import public_tokenizers
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Regex, Tokenizer, pre_tokenizers

from .bytebpe import byte_alphabet
from .common import BoundedCache, documents, keep_only, sub_batches

VOCABULARY = "word_bpe_49k.json"

#: The pre-tokenisation pattern of this vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"

#: Characters that str.split() takes for white space and the pattern does not.
_SEPARATORS = re.compile("[\x1c-\x1f]")
_SPACES = re.compile(r"[^\S\x1c-\x1f]+")


class BacktrackingBpe:
    """Exact BPE merges of one pre-token in linear time.

    From each position the longest vocabulary entry is tried first, and shorter ones after it. An entry is taken if
    it can follow the previous one, which means that merging the two entries' own letters would never join across
    their border; otherwise the previous entry is taken back and shortened. A bit per position remembers dead ends,
    so no position is left twice.
    """

    def __init__(self, path: str, limit: int = 500_000):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.suffix = spec["model"]["end_of_word_suffix"] or ""
        vocab = spec["model"]["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        # An end-of-word letter is one symbol, so it is written as one private character: letter, then +0x10000.
        symbol = lambda token: self._symbols(token)
        self.ids = {symbol(token): i for token, i in vocab.items()}
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in spec["model"]["merges"]]
        self.rank: dict[int, int] = {}
        self.pair: dict[tuple[int, int], int] = {}
        self.parts: dict[int, tuple[int, int]] = {}
        for rank, (left, right) in enumerate(merges):
            a, b = vocab[left], vocab[right]
            made = vocab[left + right]
            self.pair.setdefault((a, b), rank)
            if made not in self.rank:
                self.rank[made], self.parts[made] = rank, (a, b)
        self.made = {pair: vocab_id for vocab_id, pair in self.parts.items()}
        self.fits = BoundedCache(lambda pair: self._compatible(*pair), 1_000_000)
        self.automaton = ahocorasick.Automaton()
        for token, i in self.ids.items():
            if i in self.special.values():
                continue
            if len(token) == 1 or self._merged(token) == [i]:
                self.automaton.add_word(token, (len(token), i))
        self.automaton.make_automaton()
        entry = {t: i for t, i in self.ids.items() if t in self.automaton}
        self.shorter: dict[int, tuple[int, int] | None] = {}
        for token, i in entry.items():
            cut = next((n for n in range(len(token) - 1, 0, -1) if token[:n] in entry), 0)
            self.shorter[i] = (cut, entry[token[:cut]]) if cut else None
        self.alphabet = {b: c for c, b in byte_alphabet().items()}
        self.by_byte = str.maketrans({chr(b): c for b, c in self.alphabet.items()})
        texts = [""] * (1 + max([*vocab.values(), *self.special.values()]))
        for token, i in [*vocab.items(), *self.special.items()]:
            texts[i] = token
        encoded = [t.encode() for t in texts]
        self.offsets = np.concatenate([[0], np.cumsum([len(t) + 1 for t in encoded])])
        self.buffer = b"".join(t + b" " for t in encoded)
        self.packed = [i.to_bytes(4, "little") for i in range(len(texts))]
        self.words = BoundedCache(self.word, limit)
        self.chunks = BoundedCache(self._chunk, limit)
        self.pattern = regex.compile(PATTERN)
        self.normalizer = Tokenizer.from_file(path).normalizer
        self.pieces = pre_tokenizers.Split(Regex(PATTERN), "removed", invert=True)
        self.split = re.compile("(" + "|".join(map(re.escape, self.special)) + ")")

    def _symbols(self, token: str) -> str:
        if self.suffix and token.endswith(self.suffix) and len(token) > len(self.suffix):
            letters = token[: -len(self.suffix)]
            return letters[:-1] + chr(ord(letters[-1]) + 0x10000)
        return token

    def _merged(self, symbols: str) -> list[int]:
        """Merge by rank until no pair is left: the definition, used once per vocabulary entry."""
        ids = [self.ids[s] for s in symbols]
        while len(ids) > 1:
            best = min(range(len(ids) - 1), key=lambda i: self.pair.get((ids[i], ids[i + 1]), 1 << 60))
            pair = ids[best], ids[best + 1]
            if pair not in self.pair:
                break
            ids[best : best + 2] = [self.made.get(pair) if pair in self.made else self._joined(pair)]
        return ids

    def _joined(self, pair: tuple[int, int]) -> int:
        by_id = {i: t for t, i in self.ids.items()}
        return self.ids[by_id[pair[0]] + by_id[pair[1]]]

    def _compatible(self, left: int, right: int) -> bool:
        """Whether merging never joins across the border of two entries, by undoing the later merge of the two."""
        limit = 1 << 60
        rank, pair, parts = self.rank, self.pair, self.parts
        while True:
            joined = pair.get((left, right))
            if joined is not None and joined < limit:
                return False
            rank_left, rank_right = rank.get(left, -1), rank.get(right, -1)
            if rank_left < 0 and rank_right < 0:
                return True
            if rank_left > rank_right:
                limit, left = rank_left, parts[left][1]
            else:
                limit, right = rank_right + 1, parts[right][0]

    def word(self, letters: str) -> bytes:
        """Little-endian unsigned 32-bit ids of one pre-token."""
        if letters.isascii() and letters.isalnum():
            symbols = letters
        else:
            symbols = letters.encode("utf-8", "surrogatepass").decode("latin-1").translate(self.by_byte)
        if self.suffix:
            symbols = symbols[:-1] + chr(ord(symbols[-1]) + 0x10000)
        longest = {end - match[0]: match for end, match in self.automaton.iter(symbols)}  # a later end is a longer match
        last, fits, shorter, dead = len(symbols) - 1, self.fits, self.shorter, set()
        taken: list[tuple[int, int]] = []
        at, match = -1, longest[-1]
        while True:
            length, token = match
            if at + length not in dead and (not taken or fits[taken[-1][1], token]):
                taken.append(match)
                at += length
                if at == last:
                    return b"".join([self.packed[t] for _, t in taken])
                match = longest[at]
                continue
            match = shorter[token]
            while match is None:  # no entry fits here: take the previous one back and shorten it
                dead.add(at)
                length, token = taken.pop()
                at -= length
                match = shorter[token]

    def _chunk(self, chunk: str) -> bytes:
        """Ids of what stands between white space. Composing and lower case don't reach across white space."""
        if not chunk.isascii():  # the library's own Unicode tables decide
            return b"".join([self.words[p] for p, _ in self.pieces.pre_tokenize_str(self.normalizer.normalize_str(chunk))])
        chunk = chunk.lower()
        if chunk.isalpha():
            return self.words[chunk]
        return b"".join(map(self.words.__getitem__, self.pattern.findall(chunk)))

    def encode(self, text: str) -> bytes:
        """Little-endian unsigned 32-bit ids of a whole text; strings of special tokens become their ids."""
        if "<|" in text and any(s in text for s in self.special):
            return b"".join(
                self.special[p].to_bytes(4, "little") if p in self.special else self._ordinary(p) for p in self.split.split(text)
            )
        return self._ordinary(text)

    def _ordinary(self, text: str) -> bytes:
        parts = filter(None, _SPACES.split(text)) if _SEPARATORS.search(text) else text.split()
        return b"".join(map(self.chunks.__getitem__, parts))

    def decode(self, ids: np.ndarray) -> bytes:
        """UTF-8 of the entries joined by one space, cut from one buffer by offsets."""
        if not len(ids):
            return b""
        start, end = self.offsets[ids], self.offsets[ids.astype(np.int64) + 1]
        length = end - start
        first = np.cumsum(length) - length
        index = np.arange(int(length.sum())) + np.repeat(start - first, length)
        return np.frombuffer(self.buffer, np.uint8)[index][:-1].tobytes()


_coders: dict[str, BacktrackingBpe] = {}


def coder(path: str) -> BacktrackingBpe:
    """One coder per worker process and file."""
    if path not in _coders:
        _coders[path] = BacktrackingBpe(path)
    return _coders[path]


def _encode(batches, path):
    bpe = coder(path)
    keep_only(bpe.words, bpe.chunks, bpe.fits)
    for batch in sub_batches(batches):
        packed = [bpe.encode(t) if t else b"" for t in batch.column(1).to_pylist()]
        ends = np.cumsum([0, *(len(p) // 4 for p in packed)]).astype(np.int32)
        ids = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(packed), "<i4")))
        yield pa.RecordBatch.from_arrays([batch.column(0), ids], names=["doc_id", "ids"])


def _decode(batches, path):
    bpe = coder(path)
    for batch in sub_batches(batches):
        lists = batch.column(1)
        flat, ends = lists.flatten().to_numpy(), np.cumsum(np.asarray(lists.value_lengths()))
        ends = np.concatenate([[0], ends])
        texts = [bpe.decode(flat[a:b]).decode("utf-8") for a, b in zip(ends[:-1], ends[1:], strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column(0), lists, pa.array(texts, pa.string())], names=["doc_id", "ids", "decoded"])


def encode(docs: DataFrame, path: str) -> DataFrame:
    """Token ids of every row's whole text: ``(doc_id, ids array<int>)`` from ``(doc_id, text)``.

    Null and empty texts give an empty list; a null doc_id and repeated rows are kept as they are; other columns are
    left out. The vocabulary file's path must be readable on every executor.
    """
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(
        lambda it: _encode(it, path), "doc_id long, ids array<int>"
    )


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """Adds the decoded text to ``(doc_id, ids)``; an empty list decodes to an empty text. ids must not be null."""
    return encoded.select("doc_id", "ids").mapInArrow(lambda it: _decode(it, path), "doc_id long, ids array<int>, decoded string")


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers and digests of every document's ids and of their decoded text; null and empty texts have no ids."""
    path = public_tokenizers.path(VOCABULARY)
    return decode(encode(documents(spark, sf_dir), path), path).select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join("ids", " ").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )
