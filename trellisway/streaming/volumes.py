"""Link volumes over an event stream, by the same counts as in batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def entries(spark: SparkSession, path: str, schema: T.StructType, files_per_trigger: int | None = None) -> DataFrame:
    """A stream of Parquet files of events under a folder or a pattern; a single file needs a pattern."""
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(path)


def hourly(stream: DataFrame, late: str = "1 hour", scale: float = 1.0) -> DataFrame:
    """A13 as a stream: ``(link, hour timestamp, car, truck)`` of ``(ts timestamp, link, type)`` by tumbling hours.

    Events more than ``late`` behind the latest seen are dropped by the watermark, which also closes hours and frees their
    state. Types other than car and truck are not counted. Works on a batch table as well.
    """
    k = int(1 / scale)
    seen = stream.filter(F.col("type").isin("car", "truck")).withWatermark("ts", late)
    counts = seen.groupBy(F.window("ts", "1 hour").alias("w"), "link").agg(
        (F.count_if(F.col("type") == "car") * k).alias("car"), (F.count_if(F.col("type") == "truck") * k).alias("truck")
    )
    return counts.select("link", F.col("w.start").alias("hour"), "car", "truck")


def run_once(result: DataFrame, path: str, checkpoint: str, keys: list[str]) -> DataFrame:
    """Process what is there and return the result's table, one row for each of ``keys``.

    A batch writes the rows that it has changed into a folder of its number, which a repeated batch writes anew; of a key's rows the last batch
    counts. So nothing is rewritten as the table grows, and the watermark frees the state of hours that it has closed.
    """
    spark = result.sparkSession
    spark.createDataFrame([], result.schema).write.parquet(f"{path}/batch=-1")
    sink = result.writeStream.foreachBatch(lambda batch, number: batch.write.mode("overwrite").parquet(f"{path}/batch={number}"))
    query = sink.outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    rows = spark.read.schema(T.StructType([*result.schema.fields, T.StructField("batch", T.LongType())])).parquet(path)
    values = F.struct(*(c for c in result.columns if c not in keys))
    return rows.groupBy(*keys).agg(F.max_by(values, "batch").alias("v")).select(*keys, "v.*").select(*result.columns)


def write_closed(result: DataFrame, path: str, checkpoint: str):
    """Append hours to a Parquet folder as the watermark closes them; returns the running query."""
    return result.writeStream.format("parquet").outputMode("append").option("path", path).option("checkpointLocation", checkpoint).start()
