"""Shared helpers: the shared folder, materialised tables, checked broadcasts and bounded caches."""

from __future__ import annotations

import contextlib
import contextvars
import ctypes
import tempfile
import uuid
import weakref
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A table is broadcast only if it was counted and has at most this many narrow rows (about 32 MB).
MAX_BROADCAST_ROWS = 400_000

#: Rows of a result batch sent back to Spark at once; texts make larger batches heavy.
OUT_ROWS = 1000


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors and the driver share: ``spark.checkpoint.dir`` of the session.

    Where it is unset a temporary folder is made once per application, with a local master only; executors on other machines
    would not see it, so a cluster without the setting is an error.
    """
    conf = spark.sparkContext.getConf()
    folder = conf.get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = f"file://{tempfile.mkdtemp(prefix='trellisway-')}"
        spark.conf.set("spark.checkpoint.dir", folder)
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    full = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(path).toString().rstrip("/")
    return f"file://{full[5:]}" if full.startswith("file:/") and not full.startswith("file://") else full


#: The folder of all intermediate tables starts with this.
TABLE_PREFIX = "llm-"

_scopes: contextvars.ContextVar[tuple[str, ...]] = contextvars.ContextVar("scopes", default=())


def _table_folder(spark: SparkSession) -> str:
    """One folder per application and scope, so that no application removes another one's tables."""
    return "/".join([shared_folder(spark), f"{TABLE_PREFIX}{spark.sparkContext.applicationId}", *_scopes.get()])


def new_path(spark: SparkSession, name: str) -> str:
    return f"{_table_folder(spark)}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write a table into the shared folder and read it again.

    This cuts the lineage and survives lost executors: a later failure rereads the table.
    """
    return written(df, new_path(df.sparkSession, name))


def written(df: DataFrame, path: str) -> DataFrame:
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove_tables(spark: SparkSession) -> None:
    """Delete this application's intermediate tables, those of the present scope only inside :func:`scratch`.

    Call it when the results that read them have been written.
    """
    remove_path(spark, _table_folder(spark))


def remove_path(spark: SparkSession, path: str) -> None:
    """Delete one table."""
    root = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(root, True)


@contextlib.contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables written inside go when the block ends; write what is to stay to a path named before it."""
    token = _scopes.set((*_scopes.get(), uuid.uuid4().hex))
    try:
        yield
    finally:
        remove_tables(spark)
        _scopes.reset(token)


def small_side(df: DataFrame, max_rows: int = MAX_BROADCAST_ROWS) -> DataFrame:
    """Broadcast a materialised table of narrow rows if its count is within the bound, else leave the join to shuffle."""
    return F.broadcast(df) if df.count() <= max_rows else df


def small_lists(df: DataFrame, column: str, item_bytes: int, max_bytes: int = 32 << 20) -> DataFrame:
    """The same for rows that hold a list: the size of rows (80 bytes each) and items is summed up first."""
    found = df.agg((F.count("*") * 80 + F.coalesce(F.sum(F.size(column)), F.lit(0)) * item_bytes).alias("n")).first()
    return F.broadcast(df) if found["n"] <= max_bytes else df


_caches: list[weakref.ref] = []


class BoundedCache(dict):
    """``cache[key]`` computes a missing value; at ``limit`` entries it starts afresh, which bounds its memory."""

    def __init__(self, compute: Callable, limit: int):
        super().__init__()
        self.compute, self.limit = compute, limit
        _caches.append(weakref.ref(self))

    def __missing__(self, key):
        if len(self) >= self.limit:
            self.clear()
        value = self[key] = self.compute(key)
        return value


def keep_only(*used: BoundedCache) -> None:
    """Empty the other caches of this worker process, which tasks of other operators have left behind.

    A worker serves many tasks; what the allocators hold of earlier ones goes back to the system.
    """
    live = [(ref, cache) for ref in _caches if (cache := ref()) is not None]
    _caches[:] = [ref for ref, _ in live]
    for _, cache in live:
        if not any(cache is u for u in used):
            cache.clear()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # not every C library has it
    if trim is not None:
        trim(0)


def sub_batches(batches: Iterable[pa.RecordBatch], rows: int = OUT_ROWS) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that what a step builds for one of them stays small."""
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def crc_bucket(doc_id: str, mod: int):
    """``crc32(doc_id as text) mod n``, the rule that holds rows out of training."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % F.lit(mod)
