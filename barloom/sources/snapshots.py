"""Ranking snapshots: nested JSON documents, one per date."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.exprs import c
from ..operators import crosssection as xs
from ..schemas import SNAPSHOT


def read_snapshots(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SNAPSHOT).json(path)


def latest(snaps: DataFrame) -> DataFrame:
    """The newest document by its own date, not by file time."""
    return snaps.agg(F.max_by(F.struct(*snaps.columns), "as_of").alias("s")).select("s.*")


def rows(snaps: DataFrame, side: str = "top") -> DataFrame:
    return snaps.select("as_of", F.inline(side))


def by_symbol(snap: DataFrame, symbol: str) -> DataFrame:
    """Entries of one symbol in either list."""
    both = rows(snap, "top").unionByName(rows(snap, "bottom")).distinct()
    return both.where(c("symbol") == symbol)


def market_summary(snap: DataFrame, n: int = 5) -> DataFrame:
    return snap.select("as_of", "universe_size", F.slice("top", 1, n).alias("top_5"),
                       F.slice("bottom", 1, n).alias("bottom_5"), "fii_dii", "generated_at")


def history(scored: DataFrame, score: str, n: int = 20, model: str = "score") -> DataFrame:
    """One snapshot per date with its n best and n worst rows (worst first).

    Only n rows per side and date reach the lists, whatever the size of the cross-section.
    """
    best = xs.top_k(scored, score, n, name="_place").withColumn("_side", F.lit("top"))
    worst = (scored.where(c(score).isNotNull()).withColumn("_neg", -c(score)))
    worst = xs.top_k(worst, "_neg", n, tie="sym", name="_place").drop("_neg").withColumn(
        "_side", F.lit("bottom"))
    size = scored.where(c(score).isNotNull()).groupBy("date").agg(
        F.count(F.lit(1)).alias("universe_size"))
    entry = F.struct(
        c("_place").cast("int").alias("rank"), c("sym").alias("symbol"),
        F.bround("close", 1).alias("close"), F.lit(None).cast("double").alias("mom_12_1_pct"),
        F.lit(None).cast("double").alias("ret20_pct"), F.bround(c(score), 3).alias("score"),
        F.lit(False).alias("earnings_soon"))
    picked = best.unionByName(worst)
    lists = picked.groupBy("date").agg(
        F.array_sort(F.collect_list(F.when(c("_side") == "top", entry))).alias("top"),
        F.array_sort(F.collect_list(F.when(c("_side") == "bottom", entry))).alias("bottom"))
    empty = F.lit(None).cast(SNAPSHOT["fii_dii"].dataType)
    return lists.join(size, "date").select(
        c("date").cast("string").alias("generated_at"), c("date").cast("string").alias("as_of"),
        F.lit(model).alias("model"), "universe_size", empty.alias("fii_dii"), "top", "bottom")
