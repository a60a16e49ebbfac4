"""Symbol lists from ``SYMBOL, Name`` text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SUFFIXED = r"^(\^|INR=)|(\.NS|\.BO|=X)$"


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).withColumnRenamed("value", "line")


def _content(lines: DataFrame) -> DataFrame:
    """Trimmed lines that are neither blank nor comments."""
    text = F.trim("line")
    return lines.withColumn("line", text).where(
        (F.length("line") > 0) & ~F.startswith(F.col("line"), F.lit("#")))


def symbols(lines: DataFrame) -> DataFrame:
    """First field of every line that is an exchange symbol or an index."""
    first = F.trim(F.split("line", ",")[0]).alias("sym")
    return _content(lines).select(first).where(F.col("sym").rlike(r"\.NS$|^\^"))


def tickers(lines: DataFrame) -> DataFrame:
    """(sym, name), one row per symbol; bare symbols get the default suffix."""
    parts = F.filter(F.transform(F.split("line", ","), lambda p: F.trim(p)), lambda p: F.length(p) > 0)
    df = _content(lines).withColumn("p", parts).where(F.size("p") > 0)
    raw = F.col("p")[0]
    sym = F.when(raw.rlike(SUFFIXED), raw).otherwise(F.concat(raw, F.lit(".NS")))
    name = F.when(F.size("p") >= 2, F.get(F.col("p"), F.lit(1))).otherwise(raw)
    return df.select(sym.alias("sym"), name.alias("name")).groupBy("sym").agg(
        F.min("name").alias("name"))


def sample_first(syms: DataFrame, n: int) -> DataFrame:
    """The first n symbols that are not an index, in list order."""
    return syms.where(~F.startswith(F.col("sym"), F.lit("^"))).orderBy("sym").limit(n)


def sample_random(syms: DataFrame, n: int, seed: int = 42) -> DataFrame:
    """n symbols in an order fixed by a seeded hash, independent of partitioning."""
    return syms.orderBy(F.md5(F.concat("sym", F.lit(f"#{seed}"))), "sym").limit(n)


def stale_symbols(bars: DataFrame, wanted: DataFrame, start: str, end: str,
                  late: int = 5, early: int = 10) -> DataFrame:
    """Wanted symbols whose stored history does not reach both ends of the period."""
    have = bars.groupBy("sym").agg(F.min("date").alias("first"), F.max("date").alias("last"))
    covered = have.where((F.col("last") >= F.date_sub(F.lit(end).cast("date"), late))
                         & (F.col("first") <= F.date_add(F.lit(start).cast("date"), early)))
    return wanted.join(covered, "sym", "left_anti")


def with_history(bars: DataFrame, min_bars: int) -> DataFrame:
    """Bars of symbols with enough known closes."""
    n = F.count("close").over(Window.partitionBy("sym"))
    return bars.withColumn("_n", n).where(F.col("_n") >= min_bars).drop("_n")
