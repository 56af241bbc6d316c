"""Structured Streaming: pages to upserts, run logs, windows over events."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from brindle.sources.bundle import EVENT


def file_stream(spark: SparkSession, path: str, schema: StructType | str, kind: str = "parquet", per_trigger: int = 10) -> DataFrame:
    """Files as a stream, at most per_trigger of them in flight."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).format(kind).load(path)


def upsert_stream(stream: DataFrame, target: str, key: str, order: str, checkpoint: str, last_wins: bool = True) -> StreamingQuery:
    """Keeps a Parquet table of one row a key: versions of the table alternate, so a batch that is run again starts from the same one.

    First wins: rows of known keys are dropped.
    """
    spark = stream.sparkSession

    def write(batch: DataFrame, epoch: int) -> None:
        from brindle.sources.listings import upsert_first, upsert_last

        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{target}/v{epoch - 1}")
        known = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path)
        table = spark.read.parquet(f"{target}/v{epoch - 1}") if known else batch.limit(0)
        merged = (upsert_last if last_wins else upsert_first)(table, batch, key, order)
        merged.write.mode("overwrite").parquet(f"{target}/v{epoch}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, ts: str, keys: list[str], length: str = "1 hour", slide: str | None = None, late: str = "10 minutes", value: str | None = None) -> DataFrame:
    """Counts (and sums) by event-time window and keys; works on streams and tables."""
    kind = dict(events.dtypes)[ts]
    events = events.withColumn(ts, F.col(ts).cast("timestamp"))  # watermarks need instants; the session's time zone applies
    if events.isStreaming:
        events = events.withWatermark(ts, late)
    aggs = [F.count("*").alias("n")] + ([F.sum(value).alias("total")] if value else [])
    window = F.window(ts, length, slide) if slide else F.window(ts, length)
    out = events.groupBy(window.alias("w"), *keys).agg(*aggs)
    return out.select(F.col("w.start").cast(kind).alias("start"), F.col("w.end").cast(kind).alias("end"), *keys, *(["n", "total"] if value else ["n"]))


def sessions(events: DataFrame, ts: str, key: str, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """(key, start, end, n): sessions that end after a gap without events."""
    kind = dict(events.dtypes)[ts]
    events = events.withColumn(ts, F.col(ts).cast("timestamp"))
    if events.isStreaming:
        events = events.withWatermark(ts, late)
    out = events.groupBy(F.session_window(ts, gap).alias("w"), key).agg(F.count("*").alias("n"))
    return out.select(key, F.col("w.start").cast(kind).alias("start"), F.col("w.end").cast(kind).alias("end"), "n")


def run_log_stream(spark: SparkSession, path: str) -> DataFrame:
    """The run log's events as a stream of JSON lines."""
    return spark.readStream.schema(EVENT).json(path)


def to_memory(stream: DataFrame, name: str, mode: str = "append") -> None:
    """Runs a stream over what is there into an in-memory table; for tests and small results."""
    stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start().awaitTermination()


def each_batch(stream: DataFrame, f: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    return stream.writeStream.foreachBatch(f).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
