"""Row selection, reshaping and schema completion."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import windows as w
from ..functions.exprs import c


def with_missing_columns(df: DataFrame, names: Sequence[str], value: float = 0.0) -> DataFrame:
    """Add absent feature columns with a constant."""
    absent = [n for n in names if n not in df.columns]
    return df.withColumns({n: F.lit(value) for n in absent}) if absent else df


def bare_symbol(x: str = "sym") -> Column:
    """Symbol without the exchange suffix."""
    return F.regexp_replace(x, r"\.NS$", "")


def context_prefix(x: str = "sym") -> Column:
    """Column prefix of a context symbol: carets and equal signs dropped, dashes to underscores."""
    return F.translate(F.regexp_replace(x, r"[\^=]", ""), "-/", "__")


def since(df: DataFrame, days: int, date: str = "date") -> DataFrame:
    """The last ``days`` days before the newest date."""
    newest = df.agg(F.max(date)).scalar()
    return df.where(F.col(date) >= F.date_sub(newest, days))


def latest_per_symbol(df: DataFrame, n: int = 1, key: str = "sym", date: str = "date") -> DataFrame:
    """The newest n rows per symbol; one row needs no sort, only an aggregate."""
    if n == 1:
        rest = [x for x in df.columns if x != key]
        return (df.groupBy(key).agg(F.max_by(F.struct(*rest), date).alias("_r"))
                .select(key, "_r.*"))
    order = Window.partitionBy(key).orderBy(F.col(date).desc())
    return df.withColumn("_k", F.row_number().over(order)).where(F.col("_k") <= n).drop("_k")


def latest_price_card(df: DataFrame) -> DataFrame:
    """Latest close with 5- and 20-bar returns in percent; 0 while the history is too short."""
    df = df.withColumns({f"ret_{n}": F.coalesce(w.change("close", n) * 100, F.lit(0.0))
                         for n in (5, 20)})
    return latest_per_symbol(df.select("sym", "date", "close", "ret_5", "ret_20"))


def wide(df: DataFrame, value: str, columns: Sequence[str] | None = None, index: str = "date",
         key: str = "sym") -> DataFrame:
    """One column per symbol, for output only; give the symbols to save the pass that finds them.

    Found symbols become columns of the plan, so they must number at most
    ``spark.sql.pivotMaxValues``; Spark raises beyond it and drops none.
    """
    pivot = df.groupBy(index).pivot(key, list(columns)) if columns else df.groupBy(index).pivot(key)
    return pivot.agg(F.max(value))


def long(df: DataFrame, value: str, index: str = "date", key: str = "sym") -> DataFrame:
    names = [F.col(f"`{x}`") for x in df.columns if x != index]
    return df.unpivot([index], names, key, value).where(F.col(value).isNotNull())
