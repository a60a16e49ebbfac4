"""Market-wide context: latest snapshots, flow proxies, interactions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import windows as w
from ..functions.exprs import c, clip, ratio


def macro_snapshot(df: DataFrame, lag_14: int = 13, lag_5: int = 4) -> DataFrame:
    """Latest close, returns and volatility per series.

    The 14 and 5 day returns look back 13 and 4 rows: the window is counted with both ends.
    """
    df = df.withColumn("_r1", w.change("close", 1))
    df = df.withColumns({
        "ret14d": F.coalesce(w.change("close", lag_14) * 100, F.lit(0.0)),
        "ret5d": F.coalesce(w.change("close", lag_5) * 100, F.lit(0.0)),
        "vol20": F.when(F.row_number().over(w.series()) >= 20, F.coalesce(
            w.std("_r1", 20, 5) * 100, F.lit(0.0))).otherwise(F.lit(0.0))})
    last = F.max_by(F.struct(c("close").alias("latest_close"), "ret14d", "ret5d", "vol20"), "date")
    return df.groupBy("sym").agg(last.alias("s")).select("sym", "s.*")


def flow_proxies(df: DataFrame, index: DataFrame, lag: int = 9) -> DataFrame:
    """Index momentum and relative momentum as flow proxies, blended 0.6 / 0.4 and bounded."""
    df = df.join(index.select("date", "bench"), "date").withColumn("_ratio", ratio("close", "bench"))
    df = df.select("sym", "date",
                   F.coalesce(w.change("bench", lag) * 100, F.lit(0.0)).alias("fii_flow_proxy"),
                   F.coalesce(w.change("_ratio", lag) * 100, F.lit(0.0)).alias("dii_flow_proxy"))
    blend = (c("fii_flow_proxy") * 0.6 + c("dii_flow_proxy") * 0.4) / 2.0
    return df.withColumn("fii_dii_sentiment", clip(blend, -1.0, 1.0))


def market_state(index: DataFrame) -> DataFrame:
    """One row: a volatility level, a 14-day trend, a rate level and a mood from the index."""
    order = Window.orderBy("date")
    moved = index.withColumn("m", (ratio("bench", F.lag("bench", 13).over(order)) - 1) * 100)
    return moved.agg(
        (F.max_by("bench", "date") / 100.0).alias("vix"), F.max_by("m", "date").alias("m14"),
        (F.max_by("bench", "date") / 20.0).alias("fx"),
        clip(F.max_by("m", "date") / 10, -1.0, 1.0).alias("mood"))


def attach_scalars(df: DataFrame, one_row: DataFrame) -> DataFrame:
    """The columns of a one-row table on every row, as one scalar subquery."""
    names = one_row.columns
    value = one_row.select(F.struct(*names).alias("s")).scalar()
    return df.withColumn("_s", value).withColumns(
        {n: F.col("_s")[n] for n in names}).drop("_s")


# Level and scale of each interaction.
VIX_LEVEL, VIX_SCALE, TREND_SCALE, FX_LEVEL, FX_SCALE = 12, 15, 5, 83, 2


def interactions(df: DataFrame, state: DataFrame) -> DataFrame:
    """Context values times the sign of a return of the row."""
    df = attach_scalars(df, state)
    return df.select(
        "sym", "date",
        (clip((c("vix") - VIX_LEVEL) / VIX_SCALE, -1.0, 1.0) * F.signum("ret_20"))
        .alias("vix_regime"),
        (clip(c("m14") / TREND_SCALE, -1.0, 1.0) * F.signum("ret_10")).alias("trend"),
        (clip((c("fx") - FX_LEVEL) / FX_SCALE, -1.0, 1.0) * F.signum("ret_5")).alias("fx_mom"),
        (c("mood") * F.signum("ret_10")).alias("mood_align"),
        (c("mood") * c("range_pct")).alias("mood_vol_align"))
