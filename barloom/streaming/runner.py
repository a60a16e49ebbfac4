"""Running bounded streams to completion."""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schemas import EVENTS
from ..session import new_path

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def table_stream(spark: SparkSession, folder: str, name: str, schema: T.StructType | str,
                 bytes_per_batch: int = 1 << 30) -> DataFrame:
    """A table as a stream, be it one file or a folder of part files.

    A batch takes up to ``bytes_per_batch``, however many files that is; this also bounds what a key
    brings to one batch.
    """
    return (spark.readStream.schema(schema).option("maxBytesPerTrigger", bytes_per_batch)
            .parquet(f"{folder}/{name}.parque[t]"))  # a pattern may match a file as well as a folder


def event_stream(spark: SparkSession, folder: str, bytes_per_batch: int = 1 << 30) -> DataFrame:
    """The events as a stream; zone-free times become UTC timestamps for watermarks."""
    return table_stream(spark, folder, "events", EVENTS, bytes_per_batch) \
        .withColumn("ts", F.col("ts").cast("timestamp"))


def ticks(events: DataFrame) -> DataFrame:
    """(sym, ts, event_id, price, size)."""
    return events.select(F.col("event_type").alias("sym"), "ts", "event_id",
                         F.col("value").alias("price"), F.lit(1.0).alias("size"))


def to_table(stream: DataFrame, label: str, checkpoint: str | None = None,
             path: str | None = None, timeout: int | None = None) -> DataFrame:
    """Append the stream to a table in the shared folder until its input is used up, then read it.

    ``timeout`` in seconds, for callers that need a limit; without it a stream takes the time it takes.

    With a fixed checkpoint and path the next call continues where this one stopped.
    """
    spark = stream.sparkSession
    path = path or new_path(spark, label)
    checkpoint = checkpoint or new_path(spark, f"{label}-state")
    schema = stream.schema
    with state_settings(spark):
        query = (stream.writeStream.format("parquet").outputMode("append")
                 .option("checkpointLocation", checkpoint).option("path", path)
                 .trigger(availableNow=True).start())
    finish(query, label, timeout)
    return spark.read.schema(schema).parquet(path)


def finish(query, label: str, timeout: int | None) -> None:
    try:
        if timeout is None:
            query.awaitTermination()
        elif not query.awaitTermination(timeout):
            raise TimeoutError(f"stream {label} did not finish in {timeout}s")
    finally:
        query.stop()


@contextmanager
def state_settings(spark: SparkSession):
    """Settings a query keeps from its start: RocksDB state, one state partition per core."""
    wanted = {"spark.sql.streaming.stateStore.providerClass": ROCKSDB,
              "spark.sql.shuffle.partitions": str(spark.sparkContext.defaultParallelism)}
    before = {k: spark.conf.get(k, None) for k in wanted}
    try:
        for k, v in wanted.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
