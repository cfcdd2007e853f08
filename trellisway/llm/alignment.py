"""Alignment of two tokenizers' tokens by the bytes they own, and how often their ids are linked over a corpus."""

from __future__ import annotations

import hashlib
import re
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import public_tokenizers
import pyarrow as pa
import sentencepiece
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bytebpe import ByteBpe, encoder
from .common import BoundedCache, documents, keep_only, materialize, small_side, sub_batches

BYTE_VOCABULARY, PIECE_VOCABULARY = "byte_bpe_50k.json", "piece_bpe_32k.model"

#: An id of the first tokenizer is shifted by this in the code of a pair.
SHIFT = 32
_SPACE = "▁"
_CHUNK = re.compile(" +[^ ]*")


@dataclass(frozen=True)
class AlignmentParams:
    """A block of documents closes at so many distinct pairs of documents or rows; so many bytes are aligned at once."""

    block_pairs: int = 4_000_000
    block_rows: int = 65_536
    batch_bytes: int = 2_000_000


class PieceBpe:
    """Encoder for a ``sentencepiece`` model with byte fallback that writes a space in front of a text.

    No piece of the vocabulary holds a space behind another character, so no merge crosses from a word to the
    space after it: a text falls into runs of spaces, each with the word that follows, that are encoded one by one and kept.
    A vocabulary with such a piece is applied to whole texts.
    """

    def __init__(self, path: str, limit: int = 300_000):
        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        self.cut = not any(_SPACE in p.lstrip(_SPACE) for p in pieces)
        self.bytes = [bytes([int(p[3:5], 16)]) if self.model.is_byte(i) else p.replace(_SPACE, " ").encode() for i, p in enumerate(pieces)]
        space = [self.model.piece_to_id(_SPACE)]  # the model gives an empty text no space
        self.chunks = BoundedCache(lambda chunk: array("I", self.model.encode(chunk[1:]) or space).tobytes(), limit)

    def encode(self, text: str) -> bytes:
        """Ids of the space and the text as little-endian unsigned 32-bit numbers."""
        if not self.cut:
            return array("I", self.model.encode(text)).tobytes()
        return b"".join(map(self.chunks.__getitem__, _CHUNK.findall(f" {text}")))


_pieces: dict[str, PieceBpe] = {}


def piece_encoder(path: str) -> PieceBpe:
    """One encoder per worker process and file."""
    if path not in _pieces:
        _pieces[path] = PieceBpe(path)
    return _pieces[path]


def token_bytes(bpe: ByteBpe) -> list[bytes]:
    """The bytes of each id of a byte-level vocabulary."""
    return [bpe.plain.decode_single_token_bytes(i) for i in range(bpe.plain.max_token_value + 1)]


@dataclass
class Owners:
    """Tokens of two tokenizers over the same bytes: the group of each token, and the overlapping pairs of tokens."""

    group_a: np.ndarray
    group_b: np.ndarray
    overlap_a: np.ndarray
    overlap_b: np.ndarray


def align(len_a: np.ndarray, len_b: np.ndarray) -> Owners:
    """Align tokens by their byte lengths, which add up to the same number and hold no zero.

    Each byte is owned by one token of either side. Where the pair of owners changes from a byte to the next, a new overlap begins,
    and where both owners change at once, both sides have a token end: the bytes between two such cuts are a group.
    """
    owner_a = np.repeat(np.arange(len(len_a), dtype=np.int32), len_a)
    owner_b = np.repeat(np.arange(len(len_b), dtype=np.int32), len_b)
    moves_a, moves_b = owner_a[1:] != owner_a[:-1], owner_b[1:] != owner_b[:-1]
    first = np.flatnonzero(np.concatenate([np.ones(min(1, len(owner_a)), bool), moves_a | moves_b]))
    group = np.concatenate([np.zeros(min(1, len(owner_a)), np.int32), np.cumsum(moves_a & moves_b, dtype=np.int32)])
    return Owners(group[np.cumsum(len_a) - len_a], group[np.cumsum(len_b) - len_b], owner_a[first], owner_b[first])


def links(a: np.ndarray, b: np.ndarray, owners: Owners, doc_of_group: np.ndarray, large: int = 4096) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(doc, code, times)`` of the distinct id pairs of each document, in order, with the number of their links.

    All tokens of a group are linked with each other. A group of many links is counted by its distinct ids.
    """
    n = len(doc_of_group)
    n_a, n_b = np.bincount(owners.group_a, minlength=n), np.bincount(owners.group_b, minlength=n)
    crowded = n_a * n_b > large
    plain = np.flatnonzero(~crowded[owners.group_a])
    group = owners.group_a[plain]
    width = n_b[group]
    left = np.repeat(np.arange(len(plain)), width)
    step = np.arange(len(left)) - np.repeat(np.cumsum(width) - width, width)
    right = (np.cumsum(n_b) - n_b)[group][left] + step
    docs, codes, times = [doc_of_group[group][left]], [a[plain][left] << SHIFT | b[right]], [np.ones(len(left), np.int64)]
    at_a, at_b = np.cumsum(n_a) - n_a, np.cumsum(n_b) - n_b
    for g in np.flatnonzero(crowded).tolist():
        ids_a, times_a = np.unique(a[at_a[g] : at_a[g] + n_a[g]], return_counts=True)
        ids_b, times_b = np.unique(b[at_b[g] : at_b[g] + n_b[g]], return_counts=True)
        codes.append((ids_a[:, None] << SHIFT | ids_b).ravel())
        times.append(np.outer(times_a, times_b).ravel())
        docs.append(np.full(len(codes[-1]), doc_of_group[g]))
    doc, code, count = np.concatenate(docs), np.concatenate(codes), np.concatenate(times)
    order = np.lexsort((code, doc))
    doc, code, count = doc[order], code[order], count[order]
    starts = np.ones(len(code), bool)
    starts[1:] = (code[1:] != code[:-1]) | (doc[1:] != doc[:-1])
    at = np.flatnonzero(starts)
    return doc[at], code[at], np.add.reduceat(count, at) if len(at) else count


class Aligner:
    """Both encoders of a worker, the tables by id, and what a batch of documents gives."""

    def __init__(self, byte_path: str, piece_path: str):
        self.a, self.b = encoder(byte_path, special_as_text=True), piece_encoder(piece_path)
        keep_only(self.a.chunks, self.b.chunks)
        self.bytes_a, self.bytes_b = token_bytes(self.a), self.b.bytes
        self.len_a, self.len_b = (np.array([len(x) for x in t], np.int64) for t in (self.bytes_a, self.bytes_b))
        ends = (",", "|", ";")
        self.names = [f"{i}{end}" for i in range(max(len(self.bytes_a), len(self.bytes_b))) for end in ends]

    def tokens(self, text: str | None) -> tuple[bytes, bytes]:
        """Ids of both sides; none where the bytes of a side differ from the space and the text."""
        if not text:
            return b"", b""
        a, b, want = self.a.encode(f" {text}"), self.b.encode(text), f" {text}".encode()
        for ids, table in ((a, self.bytes_a), (b, self.bytes_b)):
            if b"".join(map(table.__getitem__, memoryview(ids).cast("I").tolist())) != want:
                return b"", b""
        return a, b

    def batch(self, pairs: list[tuple[bytes, bytes]]) -> Iterator[tuple]:
        """For each document: n_a, n_b, n_groups, n_links, n_overlaps, groups_sha256, codes of its id pairs, their numbers of links."""
        a, b = (np.frombuffer(b"".join(p[k] for p in pairs), "<u4").astype(np.int64) for k in (0, 1))
        n_a, n_b = (np.array([len(p[k]) // 4 for p in pairs], np.int64) for k in (0, 1))
        end_a, end_b = np.cumsum(n_a), np.cumsum(n_b)
        owners = align(self.len_a[a], self.len_b[b])
        n = int(owners.group_a[-1]) + 1 if len(a) else 0
        doc = np.repeat(np.arange(len(pairs)), n_a)
        doc_of_group = np.zeros(n, np.int64)
        doc_of_group[owners.group_a] = doc
        groups = np.bincount(doc_of_group, minlength=len(pairs))
        overlaps = np.bincount(doc[owners.overlap_a], minlength=len(pairs))
        in_a, in_b = np.bincount(owners.group_a, minlength=n), np.bincount(owners.group_b, minlength=n)
        n_links = np.zeros(len(pairs), np.int64)
        np.add.at(n_links, doc_of_group, in_a * in_b)
        # A group's tokens of A and then those of B, with what stands behind each.
        merged = np.empty(len(a) + len(b), np.int64)
        last_a, last_b = (np.concatenate([g[1:] != g[:-1], np.ones(min(1, len(g)), bool)]) for g in (owners.group_a, owners.group_b))
        merged[np.arange(len(a)) + (np.cumsum(in_b) - in_b)[owners.group_a]] = 3 * a + last_a
        merged[np.arange(len(b)) + np.cumsum(in_a)[owners.group_b]] = 3 * b + 2 * last_b
        docs, codes, times = links(a, b, owners, doc_of_group)
        at = np.searchsorted(docs, np.arange(len(pairs) + 1))
        for i in range(len(pairs)):
            if not n_a[i]:
                yield 0, 0, 0, 0, 0, "", codes[:0], times[:0]
                continue
            start, stop = end_a[i] - n_a[i] + end_b[i] - n_b[i], end_a[i] + end_b[i]
            text = "".join(map(self.names.__getitem__, merged[start:stop].tolist()))
            digest = hashlib.sha256(text[:-1].encode()).hexdigest()
            yield int(n_a[i]), int(n_b[i]), int(groups[i]), int(n_links[i]), int(overlaps[i]), digest, codes[at[i] : at[i + 1]], times[at[i] : at[i + 1]]


SHAPE = ["doc_id long", "n_a long", "n_b long", "n_groups long", "n_links long", "n_overlaps long", "groups_sha256 string"]
#: Rows of kind 0 are documents, whose pairs are numbers of their block's pairs; rows of kind 1 hold the block's pairs and their document counts.
BLOCK = ["kind int", "block long", *SHAPE, "pairs binary", "times binary", "codes array<long>", "docs array<int>"]
_PAIRS_A_ROW = 65_536


def _packed(numbers: np.ndarray) -> bytes:
    """Unsigned numbers in as few bytes each as the largest needs; the first byte says how many."""
    width = np.min_scalar_type(int(numbers.max(initial=0))).itemsize
    return bytes([width]) + numbers.astype(f"<u{width}").tobytes()


def _unpacked(payload: bytes) -> np.ndarray:
    return np.frombuffer(payload, f"<u{payload[0]}", offset=1)


class _Block:
    """Documents whose id pairs are numbered together."""

    def __init__(self, number: int):
        self.number, self.rows, self.pairs = number, [], 0

    def add(self, row: tuple) -> None:
        self.rows.append(row)
        self.pairs += len(row[-1])

    def batches(self) -> Iterator[pa.RecordBatch]:
        """The rows of the block: its documents, then its pairs."""
        schema = pa.schema([pa.field(f.split()[0], {"int": pa.int32(), "long": pa.int64(), "string": pa.string(), "binary": pa.binary(),
                                                     "array<long>": pa.list_(pa.int64()), "array<int>": pa.list_(pa.int32())}[f.split()[1]]) for f in BLOCK])
        codes, index, docs = np.unique(np.concatenate([r[-2] for r in self.rows]), return_inverse=True, return_counts=True)
        at = 0
        for start in range(0, len(self.rows), 1000):
            part = self.rows[start : start + 1000]
            packed = []
            for r in part:
                own = index[at : at + len(r[-1])]
                at += len(own)
                packed.append((_packed(np.diff(own, prepend=0)), _packed(r[-1])))
            columns = [[0] * len(part), [self.number] * len(part), *([r[k] for r in part] for k in range(len(SHAPE))), *([p[k] for p in packed] for k in (0, 1)), [None] * len(part), [None] * len(part)]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)
        for start in range(0, len(codes), _PAIRS_A_ROW):
            row = [1, self.number, *[None] * (len(SHAPE) + 2), codes[start : start + _PAIRS_A_ROW], docs[start : start + _PAIRS_A_ROW]]
            yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(row, schema, strict=True)], schema=schema)


def _blocks(batches, byte_path: str, piece_path: str, params: AlignmentParams):
    aligner, made = Aligner(byte_path, piece_path), TaskContext.get().partitionId() << 32
    block = _Block(made)
    for batch in sub_batches(batches):
        ids, texts = (c.to_pylist() for c in batch.columns[:2])
        start = 0
        while start < len(ids):
            held, size = [], 0
            while start + len(held) < len(ids) and size < params.batch_bytes:
                text = texts[start + len(held)]
                held.append(aligner.tokens(text))
                size += len(text or "")
            for doc_id, found in zip(ids[start:], aligner.batch(held), strict=False):
                block.add((doc_id, *found))
                if block.pairs >= params.block_pairs or len(block.rows) >= params.block_rows:
                    yield from block.batches()
                    made += 1
                    block = _Block(made)
            start += len(held)
    if block.rows:
        yield from block.batches()


def _sums(docs: pa.Table, pairs: pa.Table) -> pa.Table:
    """Best links and summed counts of a block's documents; ``pairs`` holds the corpus-wide counts of the block's pairs."""
    pairs = pairs.sort_by("code")
    count, top = pairs["n"].to_numpy(), pairs["top"].to_numpy(zero_copy_only=False)
    best, total = [], []
    for deltas, times in zip(docs["pairs"].to_pylist(), docs["times"].to_pylist(), strict=True):
        at, times = np.cumsum(_unpacked(deltas), dtype=np.int64), _unpacked(times).astype(np.int64)
        best.append(int(times[top[at]].sum()) if len(at) else 0)
        total.append(int((times * count[at]).sum()) if len(at) else 0)
    kept = docs.select([f.split()[0] for f in SHAPE])
    return kept.append_column("n_best", pa.array(best, pa.int64())).append_column("count_sum", pa.array(total, pa.int64()))


def aligned(docs: DataFrame, byte_path: str, piece_path: str, params: AlignmentParams = AlignmentParams()) -> DataFrame:
    """Alignment of the tokens of every text of ``docs`` (doc_id, text) by two tokenizers, with corpus-wide counts of linked ids.

    A is a byte-level vocabulary, applied to a space and the text, B a piece vocabulary, which writes that space itself. Returns doc_id,
    n_a, n_b, n_groups, n_links, n_overlaps, groups_sha256, n_best and count_sum: the byte offsets at which tokens of both end cut a
    text into groups; each A token of a group is linked with each of its B tokens; the count of a pair of ids is the number of
    documents (rows) that hold it linked; n_best are the links whose pair has its A id's highest count, and count_sum adds up the
    counts of all links. Overlaps are the pairs of tokens that share a byte.

    Null and empty texts, and those that B does not write back (U+2581), have zeros and an empty digest. Repeated rows and
    null doc_ids are documents of their own. An empty table gives no rows.

    Texts are tokenised once. The documents of a task form blocks of a bounded number of pairs, which number their pairs together, so that a
    pair travels once a block: to be summed over the corpus, and back with its count. No table of all pairs is broadcast.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    blocks = materialize(rows.mapInArrow(lambda it: _blocks(it, byte_path, piece_path, params), ", ".join(BLOCK)), "aligned")
    pairs = blocks.filter("kind = 1").select("block", F.explode(F.arrays_zip("codes", "docs")).alias("p"))
    pairs = pairs.select("block", F.col("p.codes").alias("code"), F.col("p.docs").alias("docs"))
    counts = materialize(pairs.groupBy("code").agg(F.sum("docs").alias("n")).withColumn("a", F.shiftright("code", SHIFT)), "pair-counts")
    highest = small_side(materialize(counts.groupBy("a").agg(F.max("n").alias("most")), "highest"))  # a row for each id of A
    known = counts.join(highest, "a").select("code", "n", (F.col("n") == F.col("most")).alias("top"))
    told = pairs.join(known, "code").select(F.col("block").alias("of_block"), "code", "n", "top")
    of_docs = blocks.filter("kind = 0").select("block", *(f.split()[0] for f in SHAPE), "pairs", "times")
    return of_docs.groupBy("block").cogroup(told.groupBy("of_block")).applyInArrow(_sums, ", ".join([*SHAPE, "n_best long", "count_sum long"]))


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Byte-level and piece tokens of every document, aligned by :func:`aligned`."""
    return aligned(documents(spark, sf_dir), public_tokenizers.path(BYTE_VOCABULARY), public_tokenizers.path(PIECE_VOCABULARY))
