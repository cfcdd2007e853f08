"""Token counts of documents in flat token streams, by a scan for the end-of-document id."""

from __future__ import annotations

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .bytebpe import encoder
from .common import documents, keep_only, materialize, new_path, sub_batches

VOCABULARY = "byte_bpe_50k.json"
END_ID = 50256
BLOCK_BYTES = 1 << 20
#: Blocks of a file whose running totals one window orders; a second window orders the totals of these runs.
RUN = 4096


def _flat(batches, path: str, folder: str, end_id: int):
    """Write a partition's token stream as one raw file, and hand on its doc_ids in order, then its size."""
    task = TaskContext.get()
    bpe = encoder(path, special_as_text=True)
    keep_only(bpe.chunks)
    part, end = task.partitionId(), np.array([end_id], "<u2").tobytes()
    where = f"{folder}/tokens-{part:06d}-{task.taskAttemptId()}.bin"  # attempts never share a file
    files, at = fs.FileSystem.from_uri(where)
    size = first = 0

    def row(ids: list | None, bytes_written: int | None) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array([part], pa.int64()), pa.array([where]), pa.array([first], pa.int64()), pa.array([ids], pa.list_(pa.int64())), pa.array([bytes_written], pa.int64())],
            names=[c.split()[0] for c in MANIFEST.split(", ")],
        )

    with files.open_output_stream(at) as out:
        for batch in sub_batches(batches):
            ids, texts = (c.to_pylist() for c in batch.columns[:2])
            stream = b"".join(np.frombuffer(bpe.encode(t), "<u4").astype("<u2").tobytes() + end if t else end for t in texts)
            out.write(stream)
            size += len(stream)
            yield row(ids, None)
            first += len(ids)
    if size:
        yield row(None, size)
    else:
        files.delete_file(at)


#: Rows of a writer: its doc_ids, numbered from ``first``, and at the end the bytes of its file.
MANIFEST = "part long, file string, first long, ids array<long>, bytes long"


def write_flat(docs: DataFrame, path: str, end_id: int = END_ID, folder: str | None = None) -> DataFrame:
    """Encode ``docs`` (doc_id, text) as raw files of 16-bit tokens, one per partition, in ``folder`` (a new one in the shared folder).

    A file is the tokens of its documents, each followed by ``end_id``, without any index. Returns the manifest, written after
    the files (:data:`MANIFEST`), which names the files of attempts that ended well and keeps the doc_ids in the files' order. Strings
    of special tokens in a text are ordinary text, so ``end_id`` only ends documents. Null and empty texts are the end
    id alone. The folder needs a scheme that ``pyarrow.fs`` can write. An empty table writes no file.
    """
    folder = folder or new_path(docs.sparkSession, "tokens")
    files, where = fs.FileSystem.from_uri(folder)
    files.create_dir(where, recursive=True)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return materialize(rows.mapInArrow(lambda it: _flat(it, path, folder, end_id), MANIFEST), "manifest")


def _ranges(batches):
    for batch in batches:
        for path, number, offset, length in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            files, where = fs.FileSystem.from_uri(path)
            with files.open_input_file(where) as file:
                payload = file.read_at(length, offset)
            yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([number], pa.int64()), pa.array([payload], pa.binary())], names=["file", "block", "payload"])


def read_ranges(files: DataFrame, block: int = BLOCK_BYTES) -> DataFrame:
    """Blocks ``(file, block, payload)`` of the raw files ``(file, length)``: ranges of ``block`` bytes, dealt over all tasks, that tasks read.

    A large file is no task of its own. Paths need a scheme that ``pyarrow.fs`` can read; files without bytes have no block.
    """
    starts = F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(length - 1) div {block}"))).alias("block")
    cut = files.filter("length > 0").select("file", "length", starts).select(
        "file", "block", (F.col("block") * block).alias("offset"), F.least(F.lit(block), F.col("length") - F.col("block") * block).cast("long").alias("size")
    )
    return cut.repartition("file", "block").mapInArrow(_ranges, "file string, block long, payload binary")


def read_flat_files(spark: SparkSession, path: str, block: int = BLOCK_BYTES) -> DataFrame:
    """The same of all raw token files under ``path``, which Spark lists."""
    files = spark.read.format("binaryFile").load(path).select(F.regexp_replace("path", "^file:/(?!/)", "file:///").alias("file"), "length")
    return read_ranges(files, block)  # the contents stay unread by the listing


def _scan(batches, end_id: int, dtype: str):
    for batch in batches:
        found, lengths = [], []
        for payload in batch.column(2).to_pylist():
            tokens = np.frombuffer(payload, dtype)
            found.append(np.flatnonzero(tokens == end_id))
            lengths.append(len(tokens))
        offsets = np.cumsum([0, *map(len, found)]).astype(np.int32)
        ends = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([*found, []]).astype(np.int32)))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(lengths, pa.int64()), ends], names=["file", "block", "n", "ends"]
        )


def count_tokens(blocks: DataFrame, end_id: int = END_ID, dtype: str = "<u2") -> DataFrame:
    """Documents of flat token streams: ``(file, ordinal, start, n_tokens, closed)``.

    blocks: ``(file, block, payload)``; the payloads of a file, ordered by block, are its bytes, and every payload holds
    whole tokens. Each block is searched for ``end_id`` by one vectorised comparison; a prefix scan over the blocks'
    counts then gives each block the number of documents and the last end before it, which stitches documents
    that cross blocks. The scan has two levels, so no window orders more than a fixed run of blocks of a file.

    n_tokens leaves out the end id. Tokens after the last end are a document with closed = false. Empty streams and
    tables give no rows; a document without tokens has n_tokens 0.
    """
    schema = f"file {blocks.schema['file'].dataType.simpleString()}, block long, n long, ends array<int>"
    scanned = materialize(
        blocks.select("file", F.col("block").cast("long").alias("block"), "payload")
        .mapInArrow(lambda it: _scan(it, end_id, dtype), schema).withColumn("run", (F.col("block") / RUN).cast("long")),
        "scan",
    )
    runs = scanned.groupBy("file", "run").agg(F.sum("n").alias("n"), F.sum(F.size("ends")).alias("docs"))
    upto = Window.partitionBy("file").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.select(
        "file", "run", F.coalesce(F.sum("n").over(upto), F.lit(0)).alias("run_start"),
        F.coalesce(F.sum("docs").over(upto), F.lit(0)).alias("run_docs"),
    )
    before = Window.partitionBy("file", "run").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    placed = scanned.select(
        "file", "run", "block", "ends",
        F.coalesce(F.sum("n").over(before), F.lit(0)).alias("at"),
        F.coalesce(F.sum(F.size("ends")).over(before), F.lit(0)).alias("docs"), "n",
    ).join(runs, ["file", "run"])
    placed = placed.select(
        "file", "run", "block", "ends", "n", (F.col("at") + F.col("run_start")).alias("at"), (F.col("docs") + F.col("run_docs")).alias("docs")
    ).withColumn("last", F.when(F.size("ends") > 0, F.col("at") + F.element_at("ends", -1)))
    lasts = placed.groupBy("file", "run").agg(F.max("last").alias("run_last"), F.max(F.col("at") + F.col("n")).alias("run_end"))
    lasts = lasts.select("file", "run", F.max("run_last").over(upto).alias("run_before"))
    placed = placed.join(lasts, ["file", "run"]).withColumn(
        "previous", F.coalesce(F.max("last").over(before), "run_before", F.lit(-1)) + 1
    )
    documents_in = placed.select("file", "docs", "at", "previous", "ends", F.posexplode("ends").alias("i", "end")).select(
        "file", (F.col("docs") + F.col("i")).alias("ordinal"),
        F.when(F.col("i") == 0, F.col("previous")).otherwise(F.col("at") + F.element_at("ends", F.greatest("i", F.lit(1))) + 1).alias("start"),
        (F.col("at") + F.col("end")).alias("stop"),
    )
    ended = documents_in.select("file", "ordinal", "start", (F.col("stop") - F.col("start")).alias("n_tokens"), F.lit(True).alias("closed"))
    totals = placed.groupBy("file").agg(
        F.max(F.col("docs") + F.size("ends")).alias("ordinal"), F.coalesce(F.max("last") + 1, F.lit(0)).alias("start"),
        F.max(F.col("at") + F.col("n")).alias("stop"),
    )
    open_end = totals.filter("stop > start").select(
        "file", "ordinal", "start", (F.col("stop") - F.col("start")).alias("n_tokens"), F.lit(False).alias("closed")
    )
    return ended.unionByName(open_end)


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document, counted in raw files of the tokens of all documents: doc_id, n_tokens, file, ordinal, start.

    file is the number of the writing partition, ordinal the place of the document in it, start its first token there. Null and empty
    texts have no tokens; repeated rows and null doc_ids are counted row by row.
    """
    manifest = write_flat(documents(spark, sf_dir), public_tokenizers.path(VOCABULARY))
    counted = count_tokens(read_ranges(manifest.filter("bytes is not null").select("file", F.col("bytes").alias("length"))))
    names = manifest.filter("ids is not null").select("part", "file", "first", F.posexplode("ids").alias("i", "doc_id"))
    names = names.select("doc_id", "part", "file", (F.col("first") + F.col("i")).alias("ordinal"))
    return names.join(counted, ["file", "ordinal"]).select("doc_id", "n_tokens", F.col("part").alias("file"), "ordinal", "start")
