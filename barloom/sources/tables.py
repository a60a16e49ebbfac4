"""Bars, benchmark and statement tables derived from line items.

Money is summed as whole cents and quantity as whole units, so every bar is bit-identical whatever
the partitioning or a task retry; ratios turn to double only after the sums.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.exprs import ratio

REPORT_LAG_DAYS = 90
PIECE_ROWS = 500_000


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def lines(spark: SparkSession, folder: str) -> DataFrame:
    return priced(table(spark, folder, "lineitem"))


def priced(lineitem: DataFrame) -> DataFrame:
    """Line items as priced quantities per day."""
    return lineitem.select(
        F.col("l_partkey"), F.col("l_suppkey"),
        F.to_date("l_shipdate").alias("day"),
        F.round(F.col("l_extendedprice") * 100).cast("bigint").alias("cents"),
        F.col("l_quantity").cast("bigint").alias("qty"),
        ratio("l_extendedprice", "l_quantity").alias("price"),
        F.when(F.col("l_linestatus") == "F", F.col("l_quantity").cast("bigint"))
        .otherwise(F.lit(0).cast("bigint")).alias("final_qty"),
    )


def brand_lines(spark: SparkSession, folder: str) -> DataFrame:
    part = table(spark, folder, "part").select("p_partkey", F.col("p_brand").alias("sym"))
    items = lines(spark, folder)
    return items.join(part, items.l_partkey == part.p_partkey).drop("p_partkey", "l_partkey")


def bars_from_lines(items: DataFrame, unit: str = "week") -> DataFrame:
    """OHLCV bars per (sym, period) from rows (sym, day, cents, qty, price, final_qty).

    The open is the volume-weighted price of the first day in the period.  A hot symbol shrinks to
    one row per day in the map-side half of the first aggregation; the daily rows, bounded by the
    calendar, then move once to their symbol, which serves the period aggregation and every window
    over the series after it.
    """
    return bars_from_daily(daily_sums(items).repartition("sym"), unit)


def daily_sums(items: DataFrame) -> DataFrame:
    """(sym, day, cents, qty, hi, lo, final_qty) of rows with a price or of such sums again."""
    hi, lo = ("hi", "lo") if "hi" in items.columns else ("price", "price")
    return items.groupBy("sym", "day").agg(
        F.sum("cents").alias("cents"), F.sum("qty").alias("qty"), F.max(hi).alias("hi"),
        F.min(lo).alias("lo"), F.sum("final_qty").alias("final_qty"))


def bars_from_daily(daily: DataFrame, unit: str = "week") -> DataFrame:
    period = F.col("day") if unit == "day" else F.trunc("day", unit)
    spot = F.col("cents") / 100.0 / F.col("qty")
    return (
        daily.groupBy("sym", period.alias("date"))
        .agg(F.min_by(spot, "day").alias("open"), F.max("hi").alias("high"),
             F.min("lo").alias("low"),
             (F.sum("cents") / 100.0 / F.sum("qty")).alias("close"),
             F.sum("qty").cast("double").alias("volume"),
             (100.0 * F.sum("final_qty") / F.sum("qty")).alias("deliv_pct"))
    )


def closes_from_lines(items: DataFrame, key: str, unit: str = "week") -> DataFrame:
    """(sym, date, close, volume, deliv_pct) as of ``bars_from_lines``, for symbols ``key``.

    These columns need no sums of days.  Each task sums its lines to periods, in pieces, before they move
    once to their symbol: a hot symbol shrinks, and what hardly repeats takes no memory for all keys of a
    task.  The sums are so short that Spark would join many partitions to one, too many rows for the sorts
    of the series behind; so their number is given.
    """
    period = F.col("day") if unit == "day" else F.trunc("day", unit)
    names = ("cents", "qty", "final_qty")
    rows = items.select(F.col(key).alias("sym"), period.alias("date"), *names)
    partitions = int(items.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    pieces = rows.mapInArrow(piece_sums, rows.schema).withColumn("sym", F.col("sym").cast("string"))
    sums = pieces.repartition(partitions, "sym").groupBy("sym", "date").agg(*[F.sum(x).alias(x) for x in names])
    return sums.select(
        "sym", "date", (F.col("cents") / 100.0 / F.col("qty")).alias("close"),
        F.col("qty").cast("double").alias("volume"),
        (100.0 * F.col("final_qty") / F.col("qty")).alias("deliv_pct"))


def piece_sums(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(sym, date, sums) of every PIECE_ROWS rows or so of a task."""
    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= PIECE_ROWS:
            yield from _summed(held)
            held, n = [], 0
    if held:
        yield from _summed(held)


def _summed(batches: list[pa.RecordBatch]) -> list[pa.RecordBatch]:
    rows = pa.Table.from_batches(batches)
    keys, sums = rows.column_names[:2], rows.column_names[2:]
    out = rows.group_by(keys, use_threads=False).aggregate([(x, "sum") for x in sums])
    return out.select([*keys, *[f"{x}_sum" for x in sums]]).rename_columns(rows.column_names).to_batches(PIECE_ROWS // 50)


def brand_bars(spark: SparkSession, folder: str, unit: str = "week") -> DataFrame:
    return bars_from_lines(brand_lines(spark, folder), unit)


def supplier_bars(spark: SparkSession, folder: str, unit: str = "week") -> DataFrame:
    items = lines(spark, folder).withColumn("sym", F.col("l_suppkey").cast("string"))
    return bars_from_lines(items, unit)


def supplier_closes(spark: SparkSession, folder: str, unit: str = "week") -> DataFrame:
    """The columns of ``supplier_bars`` that need no sums of days."""
    return closes_from_lines(lines(spark, folder), "l_suppkey", unit)


def benchmark(spark: SparkSession, folder: str, unit: str = "week") -> DataFrame:
    """Volume-weighted price of everything per period."""
    period = F.col("day") if unit == "day" else F.trunc("day", unit)
    return (lines(spark, folder).groupBy(period.alias("date"))
            .agg((F.sum("cents") / 100.0 / F.sum("qty")).alias("bench")))


def event_bars(spark: SparkSession, folder: str) -> DataFrame:
    """Hourly bars per event type; values are cents as well."""
    cents = F.round(F.col("value") * 100).cast("bigint")
    return (table(spark, folder, "events")
            .groupBy(F.col("event_type").alias("sym"),
                     F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("date"))
            .agg(F.max("value").alias("high"), F.min("value").alias("low"),
                 (F.sum(cents) / 100.0 / F.count("value")).alias("close"),
                 F.count("value").cast("double").alias("volume")))


def statement_lines(spark: SparkSession, folder: str, per: str = "brand") -> DataFrame:
    """Long statement table (sym, statement, item, period, value) per fiscal year.

    ``per`` is "brand" or "supplier".
    """
    li = table(spark, folder, "lineitem")
    if per == "brand":
        part = table(spark, folder, "part").select("p_partkey", F.col("p_brand").alias("sym"))
        li = li.join(part, li.l_partkey == part.p_partkey)
    else:
        li = li.withColumn("sym", F.col("l_suppkey").cast("string"))
    li = li.select(
        "sym", F.year("l_shipdate").alias("fy"),
        F.round(F.col("l_extendedprice") * 100).cast("bigint").alias("cents"),
        F.round(F.col("l_discount") * 100).cast("bigint").alias("disc"),
        F.col("l_quantity").cast("bigint").alias("qty"))
    yearly = (
        li.groupBy("sym", "fy")
        .agg((F.sum(F.col("cents") * (100 - F.col("disc"))) / 10000.0).alias("ni"),
             (F.sum("cents") / 100.0).alias("rev"), F.sum("qty").cast("double").alias("qty")))
    period = F.make_date("fy", F.lit(12), F.lit(31)).alias("period")
    def line(statement: str, item: str, value: Column) -> Column:
        return F.struct(F.lit(statement).alias("statement"), F.lit(item).alias("item"),
                        value.alias("value"))

    items = F.array(
        line("income", "Net Income Common Stockholders", F.col("ni")),
        line("income", "Operating Revenue", F.col("rev")),
        line("income", "Basic EPS", F.col("ni") / F.col("qty")),
        line("balance", "Common Stock Equity", F.col("rev") * 0.5))
    return yearly.select("sym", period, F.inline(items))
