"""Normalisation of raw bars."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import nan_to_null


def keep_last(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Last loaded row per key, as an aggregate: hot keys shrink before the shuffle."""
    rest = [x for x in df.columns if x not in keys]
    best = F.max_by(F.struct(*rest), F.struct(*order))
    return df.groupBy(*keys).agg(best.alias("_r")).select(*keys, "_r.*")


def normalise(raw: DataFrame, renames: dict[str, str], keys: Sequence[str] = ("sym", "date"),
              order: Sequence[str] = ("load_seq",)) -> DataFrame:
    """Rename, cast text to numbers (bad text is missing), keep the last load, drop missing closes."""
    cols = [F.col(src).try_cast("double").alias(out) for src, out in renames.items()]
    df = raw.select(*keys, *order, *[c for c in cols])
    return keep_last(df, keys, order).where(F.col("close").isNotNull()).drop(*order)


def weekend_to_friday(df: DataFrame, key: str = "sym", date: str = "date") -> DataFrame:
    """Weekend labels go back to Friday; of rows meeting on one day the later label stays."""
    day = F.weekday(date)
    moved = F.date_sub(date, F.when(day == 5, 1).when(day == 6, 2).otherwise(0))
    df = df.withColumn("_label", F.col(date)).withColumn(date, moved)
    return keep_last(df, [key, date], ["_label"]).drop("_label")


def ohlcv(df: DataFrame, columns: Sequence[str] = ("high", "low", "close", "volume"),
          time: str = "date") -> DataFrame:
    """Zone-free timestamps, NaN as missing, complete rows only."""
    out = df.select("sym", F.col(time).cast("timestamp_ntz").alias("timestamps"),
                    *[nan_to_null(x).alias(x) for x in columns])
    return out.na.drop(subset=list(columns))
