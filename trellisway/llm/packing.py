"""Bounded-space online packing of documents into fixed windows."""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from dataclasses import dataclass

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bytebpe import encoder
from .common import documents, keep_only, materialize, sub_batches

VOCABULARY = "byte_bpe_50k.json"

PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


@dataclass(frozen=True)
class PackingParams:
    """``open_windows`` are kept per partition; leftovers of ``merge_partitions`` partitions are merged in one group."""

    window: int = 2048
    open_windows: int = 64
    merge_partitions: int = 16
    end_id: int = 1


class OpenWindows:
    """At most ``limit`` windows, each with the room it has left; a piece goes where it leaves the least room."""

    def __init__(self, limit: int, window: int):
        self.limit, self.window = limit, window
        self.room: list[tuple[int, int]] = []
        self.made = 0

    def place(self, length: int) -> tuple[int, int, int | None]:
        """(window, offset, window closed for it or None) of a piece no longer than a window."""
        closed = None
        at = bisect_left(self.room, (length, -1))
        if at < len(self.room):
            room, window = self.room.pop(at)
        else:
            if len(self.room) >= self.limit:
                closed = self.room.pop(0)[1]
            room, window = self.window, self.made
            self.made += 1
        if room > length:
            insort(self.room, (room - length, window))
        return window, self.window - room, closed


def _pack(batches, path: str, params: PackingParams):
    """Pieces of a partition; ``open`` marks those of the windows still open at its end."""
    bpe, windows = encoder(path), OpenWindows(params.open_windows, params.window)
    keep_only(bpe.chunks)
    base = TaskContext.get().partitionId() << 33
    size, end = params.window, params.end_id.to_bytes(4, "little")
    waiting: dict[int, list[tuple]] = {}
    done: list[tuple] = []
    for batch in sub_batches(batches):
        for doc_id, text in zip(*(c.to_pylist() for c in batch.columns[:2]), strict=True):
            ids = (bpe.encode(text) if text else b"") + end
            n = len(ids) // 4
            for start in range(0, n, size):
                length = min(size, n - start)
                crc = zlib.crc32(ids[4 * start : 4 * (start + length)])
                window, offset, closed = windows.place(length)
                if closed is not None:
                    done += waiting.pop(closed)
                piece = (doc_id, start, length, crc, n, base + window, offset, False)
                if offset + length == size:
                    done += waiting.pop(window, [])
                    done.append(piece)
                else:
                    waiting.setdefault(window, []).append(piece)
        if done:
            yield _pieces(done)
            done = []
    left = [(*piece[:-1], True) for pieces in waiting.values() for piece in pieces]
    if left:
        yield _pieces(left)


def _pieces(rows: list[tuple]) -> pa.RecordBatch:
    names = [c.split()[0] for c in PIECE.split(", ")]
    columns = list(zip(*rows, strict=True))
    arrays = [pa.array(c, pa.int64()) for c in columns[:-1]] + [pa.array(columns[-1], pa.bool_())]
    return pa.RecordBatch.from_arrays(arrays, names=[*names, "open"])


def _merge(frame: pd.DataFrame, params: PackingParams) -> pd.DataFrame:
    """Join a group's leftover windows, the fullest first, each as one block into the window it fills best."""
    frame = frame.sort_values(["sequence_id", "offset"], kind="stable")
    filled = frame.groupby("sequence_id")["length"].sum().sort_values(ascending=False, kind="stable")
    windows = OpenWindows(len(filled) + 1, params.window)
    placed = {old: windows.place(int(n))[:2] for old, n in filled.items()}
    base = (1 << 62) + (int(frame["part"].iloc[0]) << 33)
    frame["offset"] += frame["sequence_id"].map(lambda s: placed[s][1])
    frame["sequence_id"] = frame["sequence_id"].map(lambda s: base + placed[s][0])
    return frame[[c.split()[0] for c in PIECE.split(", ")]]


def pack(docs: DataFrame, path: str, params: PackingParams = PackingParams()) -> DataFrame:
    """Pieces of every document of ``docs`` (doc_id, text) in sequences of at most ``window`` tokens.

    A document is its ids and the end id; null and empty texts are the end id alone. A document longer than a window
    is cut at whole windows. Per partition a fixed number of windows is open: a piece goes where it fits best, and
    when none has room, the fullest is closed. The windows left open are merged in groups of a fixed number of
    partitions, so neither step holds more than a bounded number of pieces. Window ids carry the partition's
    number; the pieces are written before the merge, so a retried task cannot mix two numberings.

    Repeated rows and null doc_ids are packed as documents of their own. An empty table gives no rows.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    pieces = materialize(rows.mapInArrow(lambda it: _pack(it, path, params), PIECE + ", open boolean"), "pieces")
    part = F.shiftright("sequence_id", 33)
    merged = (
        pieces.filter("open").withColumn("part", (part / params.merge_partitions).cast("long"))
        .groupBy("part").applyInPandas(lambda frame: _merge(frame, params), PIECE)
    )
    return pieces.filter("not open").drop("open").unionByName(merged)


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of at most 2048 tokens by :func:`pack`; null and empty texts are the end id alone."""
    return pack(documents(spark, sf_dir), public_tokenizers.path(VOCABULARY))
