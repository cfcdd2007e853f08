"""Fuzzy line deduplication: character-shingle MinHash, verified edges, and one line kept per component."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BoundedCache, documents, keep_only, materialize, small_lists, small_side, sub_batches
from .lsh import Bound, band_keys, linked_components, mix, odd_constants, one_permutation


@dataclass(frozen=True)
class LineParams:
    """Two lines are linked where ``den * overlap >= num * union`` on their sets of ``size``-character shingles.

    12 bands of 4 bins miss a pair at 80 % with a chance of 0.2 %, one at 90 % with 3e-6. Shingles of eight characters
    are rare enough in text that two unrelated lines hardly share any, so few bands need few rows each.
    """

    size: int = 8
    num: int = 80
    den: int = 100
    bands: int = 12
    rows: int = 4


def forms_of(text: str) -> list[str]:
    """What the lines of a text are compared by: lower case, white space runs as one space."""
    return [" ".join(line.split()) for line in text.lower().split("\n")]


def normalise(line: str) -> str:
    return forms_of(line)[0]


def shingle_hashes(lines: list[str], size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the character shingles of each line, with repeats, and the line of each.

    A line shorter than a shingle is one shingle. All lines are hashed in one pass over their joined code points;
    windows that cross lines are left out.
    """
    lengths = np.fromiter(map(len, lines), np.int64, len(lines))
    short = lengths < size
    padded = "".join(line if len(line) >= size else line.ljust(size, "\0") for line in lines)
    codes = np.frombuffer(padded.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    lengths = np.where(short, size, lengths)
    total, step, width, c = codes, 1, 1, 0x9E3779B97F4A7C15
    parts = []  # binary powers of the window: hash of 2n characters from two hashes of n
    while True:
        if size & step:
            parts.append((step, total))
        step *= 2
        if step > size:
            break
        total = total[:-width] * np.uint64(c) + total[width:]
        total ^= total >> np.uint64(29)
        c, width = (c * c | 1) & 0xFFFFFFFFFFFFFFFF, step
    n, at = len(codes) - size + 1, 0
    out = np.zeros(max(0, n), np.uint64)
    for step, part in parts:
        out = out * odd_constants(1)[0] + part[at : at + n]
        at += step
    owner = np.repeat(np.arange(len(lines)), lengths)
    last = np.repeat(np.cumsum(lengths), lengths)[: len(out)]
    inside = np.arange(len(out)) + size <= last
    return mix(out[inside]), owner[: len(out)][inside]


def _digest(form: str) -> bytes:
    return xxhash.xxh3_128_digest(form.encode("utf-8", "surrogatepass"))


def _lines(batches, params: LineParams):
    """Every line with a word: its place, two hashes of its normal form, and for its first place in a batch its bands."""
    keep_only()
    known = BoundedCache(_digest, 100_000)
    for batch in sub_batches(batches, 500):
        places, forms = [], []
        for doc_id, text in zip(*(c.to_pylist() for c in batch.columns[:2]), strict=True):
            if text:
                for i, form in enumerate(forms_of(text)):
                    if form:
                        places.append((doc_id, i))
                        forms.append(form)
        if not forms:
            continue
        digests = np.frombuffer(b"".join(map(known.__getitem__, forms)), np.int64).reshape(-1, 2)
        order, first = np.unique(digests[:, 0], return_index=True)
        texts = [forms[i] for i in first]
        keys = np.empty((len(texts), params.bands), np.int64)
        for cut in range(0, len(texts), 4000):
            some = texts[cut : cut + 4000]
            hashes, owner = shingle_hashes(some, params.size)
            sig = one_permutation(owner, hashes, len(some), params.bands * params.rows)
            keys[cut : cut + len(some)] = band_keys(sig, params.rows)
        row = np.full(len(forms), -1)
        row[first] = np.arange(len(first))
        has = row >= 0
        ends = np.concatenate([[0], np.cumsum(np.where(has, params.bands, 0))]).astype(np.int32)
        lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(keys[row[has]].reshape(-1)), mask=pa.array(~has))
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([p[0] for p in places], pa.int64()), pa.array([p[1] for p in places], pa.int32()),
                pa.array(digests[:, 0]), pa.array(digests[:, 1]), lists,
            ],
            names=["doc_id", "line", "h1", "h2", "keys"],
        )


def _texts_of(batches):
    """The compared form of each wanted line; a row that only shares the doc_id of the wanted one gives none."""
    for batch in sub_batches(batches):
        rows = []
        for text, wanted in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if text:
                parts = text.split("\n")
                for w in wanted:
                    if w["line"] < len(parts):
                        form = normalise(parts[w["line"]])
                        if np.frombuffer(_digest(form), np.int64)[0] == w["h1"]:
                            rows.append((w["id"], form))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.string())], names=["id", "text"])


def line_sets(lines: list[str], size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each line's character shingles, one line after the other, and their numbers."""
    hashes, owner = shingle_hashes(lines, size)
    return hashes, np.bincount(owner, minlength=len(lines))


def _grouped(lines: DataFrame) -> DataFrame:
    """Each different line once: ``(id, first (doc_id, line, h1), n, low, high)``, with the range of its second hash."""
    return lines.groupBy("id").agg(
        F.min(F.struct("doc_id", "line", "h1")).alias("first"), F.count("*").alias("n"), F.min("h2").alias("low"), F.max("h2").alias("high")
    )


def duplicate_lines(docs: DataFrame, params: LineParams = LineParams(), bound: Bound = Bound()) -> DataFrame:
    """Lines to drop, per document: ``(doc_id, dropped array<int>)``; documents that keep all their lines are left out.

    Of each component of linked lines the one first in order of (doc_id, line number) stays. Equal compared forms are one
    vertex, named by 64 bits of a 128-bit hash; the few names that two different lines share are found by
    the other half and replaced. The copies of a common line cost a partial minimum and no edge. The stars of band buckets
    give candidate clusters, within which links are verified on full shingle sets (:func:`lsh.linked_components`). Lines are
    split at ``\\n``; lines of white space are no lines.

    Null and empty texts have no lines. Lines of rows with a null doc_id are left as they are. Rows that repeat a doc_id
    share line numbers, so equal rows are deduplicated as one document and keep the same lines.
    """
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).filter("doc_id is not null")
    lines = materialize(
        own.mapInArrow(lambda it: _lines(it, params), "doc_id long, line int, h1 long, h2 long, keys array<long>"), "lines"
    ).withColumn("id", F.col("h1"))
    forms = materialize(_grouped(lines), "line-groups")
    clashes = forms.filter("low <> high").select("id", F.lit(True).alias("clash"))
    if not clashes.isEmpty():
        lines = lines.join(small_side(clashes), "id", "left").withColumn("id", F.when(F.col("clash"), F.xxhash64("h1", "h2")).otherwise(F.col("id"))).drop("clash")
        forms = materialize(_grouped(lines), "line-groups")

    def texts_of(ids: DataFrame) -> DataFrame:
        places = forms.join(small_side(ids), "id", "left_semi").select("id", "first.*")
        wanted = places.groupBy("doc_id").agg(F.collect_list(F.struct("id", "h1", "line")).alias("wanted"))
        wanted = small_lists(materialize(wanted, "line-places"), "wanted", 40)
        return own.join(wanted, "doc_id").select("text", "wanted").mapInArrow(_texts_of, "id long, text string")

    sketches = lines.filter("keys is not null").select("id", "keys")
    components = linked_components(sketches, texts_of, lambda texts: line_sets(texts, params.size), params.num, params.den, bound)
    # A line goes if its form or its component has more than one place and it is not the first of them.
    crowded = forms.select("id", "first", "n").join(small_side(components), "id", "left").filter("n > 1 or component is not null")
    crowded = materialize(crowded.select("id", F.coalesce("component", "id").alias("c"), "first"), "line-crowded")
    kept = crowded.groupBy("c").agg(F.min("first").alias("best")).select("best.doc_id", "best.line", F.lit(True).alias("kept"))
    kept = small_side(materialize(kept, "line-kept"))
    repeated = lines.select("doc_id", "line", "id").join(small_side(crowded.select("id")), "id", "left_semi")
    dropped = repeated.join(kept, ["doc_id", "line"], "left").filter("kept is null")
    return materialize(
        dropped.groupBy("doc_id").agg(F.array_sort(F.collect_set("line")).alias("dropped")), "line-dropped"
    )


def _without(batches, names):
    text_at, dropped_at = names.index("text"), len(names)
    for batch in sub_batches(batches):
        texts, empty = [], []
        for text, dropped in zip(batch.column(text_at).to_pylist(), batch.column(dropped_at).to_pylist(), strict=True):
            gone = False
            if dropped and text:
                skip = set(dropped)
                parts = [x for i, x in enumerate(text.split("\n")) if i not in skip]
                text = "\n".join(parts)
                gone = not text.strip()
            texts.append(text)
            empty.append(gone)
        columns = [*batch.columns[:-1], pa.array(empty)]
        columns[text_at] = pa.array(texts, pa.string())
        yield pa.RecordBatch.from_arrays(columns, names=[*names, "_emptied"])


def dedup_lines(docs: DataFrame, params: LineParams = LineParams()) -> DataFrame:
    """The rows of ``docs`` without the lines of :func:`duplicate_lines`, and ``_emptied`` where no line with a word is left."""
    dropped = small_lists(duplicate_lines(docs, params), "dropped", 4)
    joined = docs.join(dropped, docs["doc_id"] == dropped["doc_id"], "left").select(*(docs[c] for c in docs.columns), dropped["dropped"])
    names = docs.columns
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return joined.mapInArrow(lambda it: _without(it, names), f"{fields}, _emptied boolean")


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the lines it keeps: doc_id, text, n_lines kept, n_chars, emptied."""
    docs = documents(spark, sf_dir).select("doc_id", "text")
    found = dedup_lines(docs)
    return found.select(
        "doc_id", "text", F.size(F.split(F.coalesce("text", F.lit("")), "\n", -1)).cast("long").alias("n_lines"),
        F.char_length(F.coalesce("text", F.lit(""))).cast("long").alias("n_chars"), F.col("_emptied").alias("emptied"),
    )
