"""Weekly ranking of the latest cross-section."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import c
from ..operators import crosssection as xs
from ..operators import joins
from .factors import features

MODEL_NAME = "blend(mom_12_1 rank + reversal rank), v1"


def latest_rows(df: DataFrame, date: str = "date") -> DataFrame:
    """Rows at the newest date, found by a scalar subquery."""
    newest = df.agg(F.max(date)).scalar()
    return df.where(F.col(date) == newest)


def ranking(panel: DataFrame, calendar: DataFrame | None = None, bound: int | None = None,
            days: int = 12, lower: bool = False, **lookbacks: int) -> DataFrame:
    """Score, rank, raw factors in percent and the earnings flag for the newest date.

    The score is the mean of the momentum percentile and one minus the 20-bar return percentile.
    """
    df = features(panel, **lookbacks).where(
        c("mom_12_1").isNotNull() & c("ret_20").isNotNull() & c("liq").isNotNull())
    snap = xs.rank_pct(latest_rows(df), {"_m": "mom_12_1", "_r": "ret_20"}, bound=bound)
    snap = snap.withColumn("score_raw", (c("_m") + (1 - c("_r"))) / 2)
    snap = xs.ordinal(snap, "score_raw", "date", "sym", bound)
    if calendar is None:
        snap = snap.withColumn("earnings_soon", F.lit(False))
    else:
        snap = joins.soon(snap, calendar, days, "date", lower)
    return snap.select(
        c("rank").cast("int").alias("rank"), "sym",
        F.regexp_replace("sym", r"\.NS$", "").alias("symbol"), c("date").alias("as_of"),
        F.bround("close", 1).alias("close"), F.bround(c("mom_12_1") * 100, 1).alias("mom_12_1_pct"),
        F.bround(c("ret_20") * 100, 1).alias("ret20_pct"), F.bround("score_raw", 3).alias("score"),
        "earnings_soon")


def ends(ranked: DataFrame, n: int = 20) -> DataFrame:
    """The first n rows and the last n rows, the latter worst first, tagged by ``side``."""
    top = ranked.orderBy("rank").limit(n).withColumn("side", F.lit("top"))
    bottom = ranked.orderBy(F.col("rank").desc()).limit(n).withColumn("side", F.lit("bottom"))
    return top.unionByName(bottom)


def snapshot(ranked: DataFrame, flows: DataFrame | None = None, n: int = 20,
             generated_at: str | None = None) -> DataFrame:
    """One nested row: as_of, model, universe_size, flows, top and bottom arrays of n rows."""
    row = F.struct("rank", "symbol", "close", "mom_12_1_pct", "ret20_pct", "score",
                   "earnings_soon")
    picked = ends(ranked, n)
    lists = picked.agg(
        F.array_sort(F.collect_list(F.when(F.col("side") == "top", row))).alias("top"),
        F.reverse(F.array_sort(F.collect_list(F.when(F.col("side") == "bottom", row))))
        .alias("bottom"), F.max("as_of").cast("string").alias("as_of"))
    size = ranked.agg(F.count(F.lit(1))).scalar()
    flow = F.lit(None).cast("struct<source:string,date:string,fii_net_cr:double,dii_net_cr:double>")
    if flows is not None:
        flow = flows.select(F.struct("source", "date", "fii_net_cr", "dii_net_cr")).scalar()
    stamp = F.lit(generated_at) if generated_at else F.current_timestamp().cast("string")
    return lists.select(stamp.alias("generated_at"), "as_of", F.lit(MODEL_NAME).alias("model"),
                        size.alias("universe_size"), flow.alias("fii_dii"), "top", "bottom")
