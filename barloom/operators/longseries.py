"""Series that the calendar does not bound: raw ticks, where one symbol may hold most rows.

A series is numbered without sorting it as a whole, cut into blocks of rows, and every block gets a
run-up of the rows before it (and after it, for forward looking columns).  Any window expression
with a bounded reach then works block by block and is exact, and no task holds more than one block.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK_ROWS = 200_000


def _columns(order: str | Sequence[str]) -> list[str]:
    return [order] if isinstance(order, str) else list(order)


def numbered(df: DataFrame, key: str = "sym", order: str | Sequence[str] = "date",
             unit: str = "month", name: str = "row") -> DataFrame:
    """Row number per series, counted per calendar chunk.

    Chunk sizes are accumulated (a handful of rows per series) and added to the number inside the
    chunk, so only the rows of one chunk are ever sorted together.
    """
    order = _columns(order)
    df = df.withColumn("_at", F.date_trunc(unit, order[0]))
    sizes = df.groupBy(key, "_at").agg(F.count(F.lit(1)).alias("_rows"))
    before = F.coalesce(F.sum("_rows").over(
        Window.partitionBy(key).orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)),
        F.lit(0))
    starts = sizes.select(key, "_at", before.alias("_before"))
    local = F.row_number().over(Window.partitionBy(key, "_at").orderBy(*order))
    return (df.withColumn("_local", local).join(starts, [key, "_at"])
            .withColumn(name, F.col("_before") + F.col("_local"))
            .drop("_at", "_before", "_local"))


def cut(df: DataFrame, back: int, ahead: int = 0, block_rows: int = BLOCK_ROWS, key: str = "sym",
        order: str | Sequence[str] = "date", unit: str = "month") -> DataFrame:
    """Rows with ``_block`` and ``_home``; rows near a border also join the neighbouring block."""
    size = max(block_rows, back, ahead)
    rows = numbered(df, key, order, unit, "_row")
    at = F.col("_row") - 1
    home, place = F.floor(at / size), at % size
    places = F.array(home)
    if back:
        places = F.when(place >= size - back, F.concat(places, F.array(home + 1))).otherwise(places)
    if ahead:
        places = F.when((place < ahead) & (home > 0), F.concat(places, F.array(home - 1))) \
            .otherwise(places)
    return (rows.withColumn("_home", home).withColumn("_block", F.explode(places)))


def in_blocks(df: DataFrame, build: Callable[[DataFrame], DataFrame], back: int, ahead: int = 0,
              block_rows: int = BLOCK_ROWS, key: str = "sym",
              order: str | Sequence[str] = "date", unit: str = "month") -> DataFrame:
    """Apply a builder of windowed columns block by block.

    ``build`` sees the usual frame, with the key standing for one block of one series; it may look
    ``back`` rows back and ``ahead`` rows ahead.
    """
    pieces = cut(df, back, ahead, block_rows, key, order, unit)
    named = pieces.withColumn("_key", F.col(key)).withColumn(
        key, F.concat_ws("\u0001", F.col(key), F.col("_block")))
    built = build(named).where(F.col("_home") == F.col("_block"))
    return built.withColumn(key, F.col("_key")).drop("_key", "_home", "_block", "_row")


def running_total(df: DataFrame, x: Column, name: str, key: str = "sym",
                  order: str | Sequence[str] = "date", unit: str = "month") -> DataFrame:
    """Cumulative sum of a long series: totals per chunk carried forward, sums inside a chunk."""
    order = _columns(order)
    df = df.withColumns({"_at": F.date_trunc(unit, order[0]), "_x": x})
    totals = df.groupBy(key, "_at").agg(F.sum("_x").alias("_t"))
    before = F.coalesce(F.sum("_t").over(
        Window.partitionBy(key).orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)),
        F.lit(0))
    carried = totals.select(key, "_at", before.alias("_before"))
    inside = (Window.partitionBy(key, "_at").orderBy(*order)
              .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return (df.withColumn("_local", F.sum("_x").over(inside)).join(carried, [key, "_at"])
            .withColumn(name, F.col("_before") + F.col("_local"))
            .drop("_at", "_x", "_before", "_local"))
