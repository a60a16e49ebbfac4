"""Streaming ingest and aggregation of ticks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def each_bar_once(stream: DataFrame, delay: str = "1 hour") -> DataFrame:
    """First arrival of every (sym, ts) within the watermark."""
    return stream.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["sym", "ts"])


def to_bars(stream: DataFrame, size: str = "1 hour", slide: str | None = None,
            delay: str = "1 hour") -> DataFrame:
    """OHLCV bars per tumbling (or sliding) window, emitted once the watermark has passed."""
    span = F.window("ts", size, slide) if slide else F.window("ts", size)
    at = F.struct("ts", "event_id")
    return (stream.withWatermark("ts", delay).groupBy(span, "sym")
            .agg(F.min_by("price", at).alias("open"), F.max("price").alias("high"),
                 F.min("price").alias("low"), F.max_by("price", at).alias("close"),
                 F.sum("size").alias("volume"))
            .select("sym", F.col("window.start").alias("start"), F.col("window.end").alias("end"),
                    "open", "high", "low", "close", "volume"))


def session_vwap(stream: DataFrame, gap: str = "30 minutes", delay: str = "1 hour") -> DataFrame:
    """Volume-weighted price of every activity session.

    Prices are summed as cents, so a session merged from parts gives the same figure.
    """
    cents = F.round(F.col("price") * F.col("size") * 100).cast("bigint")
    return (stream.withWatermark("ts", delay).groupBy(F.session_window("ts", gap), "sym")
            .agg((F.sum(cents) / 100.0 / F.sum("size")).alias("vwap"),
                 F.count(F.lit(1)).alias("ticks"))
            .select("sym", F.col("session_window.start").alias("start"),
                    F.col("session_window.end").alias("end"), "vwap", "ticks"))


def prediction_outcomes(predictions: DataFrame, bars: DataFrame, within: str = "1 day",
                        delay: str = "1 hour") -> DataFrame:
    """Predictions matched with later bars of the same key inside a time bound.

    predictions: (key, pred_ts, last, pred_price); bars: (key, bar_ts, price).  Both watermarks and
    the bound let Spark drop state.
    """
    p = predictions.withWatermark("pred_ts", delay).withColumnRenamed("key", "_pk")
    b = bars.withWatermark("bar_ts", delay)
    on = F.expr(f"_pk = key AND bar_ts > pred_ts AND bar_ts <= pred_ts + INTERVAL {within}")
    hit = (F.col("pred_price") >= F.col("last")) == (F.col("price") >= F.col("last"))
    return p.join(b, on).select(
        "key", "pred_ts", "bar_ts", hit.alias("is_hit"),
        (F.abs(F.col("pred_price") - F.col("price")) / F.col("price") * 100).alias("mape"))
