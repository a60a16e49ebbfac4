"""Ranking refreshed by every arriving batch of lines."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import new_path
from .runner import finish


def refresh_on_arrival(stream: DataFrame, reduce: Callable[[DataFrame], DataFrame],
                       build: Callable[[DataFrame], DataFrame], label: str,
                       timeout: int | None = None) -> DataFrame:
    """Keep what ``reduce`` makes of every arriving batch and rebuild a result from it each time.

    ``reduce`` returns partial sums that ``build`` can sum up, so what is kept and read again follows
    the result's keys and not the rows that came.  Batches overwrite their own partition, so a
    replayed batch changes nothing.  Returns the result of the last batch.
    """
    spark: SparkSession = stream.sparkSession
    store, out = new_path(spark, f"{label}-sums"), new_path(spark, label)

    def handle(batch: DataFrame, epoch: int) -> None:
        sums = reduce(batch)
        sums.write.mode("overwrite").parquet(f"{store}/epoch={epoch}")
        seen = batch.sparkSession.read.schema(sums.schema).parquet(f"{store}/epoch=*")
        build(seen).write.mode("overwrite").parquet(f"{out}/epoch={epoch}")

    query = (stream.writeStream.foreachBatch(handle)
             .option("checkpointLocation", new_path(spark, f"{label}-state"))
             .trigger(availableNow=True).start())
    finish(query, label, timeout)
    results = spark.read.option("basePath", out).parquet(out)
    newest = results.agg(F.max("epoch")).scalar()
    return results.where(F.col("epoch") == newest).drop("epoch")
