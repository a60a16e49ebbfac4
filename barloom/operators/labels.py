"""Targets built from later rows of the same series."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import windows as w
from ..functions.exprs import c, flag, ratio


def forward_returns(df: DataFrame, horizons: Sequence[int], prefix: str = "fwd_ret_",
                    scale: float = 1.0) -> DataFrame:
    return df.withColumns({f"{prefix}{h}": w.forward("close", h) * scale for h in horizons})


def binary(x: str = "fwd_excess") -> Column:
    return flag(c(x) > 0)


def above(x: str, move: float) -> Column:
    return flag(c(x) > move)


def majority(df: DataFrame, horizons: Sequence[int] = (5, 10, 20), need: int = 2) -> DataFrame:
    """1 when at least ``need`` forward returns are positive; rows without the longest are dropped."""
    votes = sum((flag(w.forward("close", h) > 0) for h in horizons), F.lit(0))
    df = df.withColumns({"majority_up": votes, "_far": w.forward("close", max(horizons))})
    return (df.where(c("_far").isNotNull()).drop("_far")
            .withColumn("majority_up", flag(c("majority_up") >= need)))


def triple_barrier(df: DataFrame, take: float = 0.03, stop: float = 0.02,
                   hold: int = 10) -> DataFrame:
    """1 profit barrier first, 0 stop barrier first, 2 neither within ``hold`` rows.

    The next rows of a series are a bounded frame (at most ``hold`` bars), so both barriers are
    looked up in one window; the profit barrier wins inside a bar.
    """
    ahead = w.series().rowsBetween(1, hold)
    df = df.withColumn("_bars", F.collect_list(F.struct("high", "low")).over(ahead))
    up, down = c("close") * (1 + take), c("close") * (1 - stop)
    hits = F.transform("_bars", lambda b: F.when(b["high"] >= up, F.lit(1))
                       .when(b["low"] <= down, F.lit(0)).otherwise(F.lit(2)))
    first = F.filter(hits, lambda h: h < 2)
    return df.withColumn("triple_label", F.when(F.size(first) > 0, first[0]).otherwise(F.lit(2))) \
        .drop("_bars")


def target_lags(df: DataFrame, horizon: int = 5, move: float = 0.02) -> DataFrame:
    """The label of 1 and 2 rows before, and the newest label that is known by then.

    Lags shorter than the horizon use prices from after the row: ``target_lag_1`` and
    ``target_lag_2`` leak and are kept for comparison only; ``target_known_<h>`` does not.
    """
    df = df.withColumn("_fwd", w.forward("close", horizon))
    df = df.withColumn("target", flag(c("_fwd") > move))
    df = df.withColumns({"target_lag_1": w.shift("target", 1), "target_lag_2": w.shift("target", 2),
                         f"target_known_{horizon}": w.shift("target", horizon)})
    return df.where(c("_fwd").isNotNull()).drop("_fwd")


def direction(x: Column) -> Column:
    return F.when(x >= 0, F.lit("UP")).when(x < 0, F.lit("DOWN"))


def direction_hits(df: DataFrame, horizon: int, predicted: str = "pred_dir") -> DataFrame:
    """Realised direction over the next rows and whether the prediction matched."""
    df = df.withColumn("actual_ret", w.forward("close", horizon))
    df = df.withColumn("actual_dir", direction(c("actual_ret")))
    return df.where(c("actual_ret").isNotNull()).withColumn(
        "is_hit", c(predicted) == c("actual_dir"))


def side_hits(df: DataFrame, signal: str = "sig", cut: float = 0.5) -> DataFrame:
    """LONG at or above the cut, else SHORT, judged against excess and absolute return."""
    long = c(signal) >= cut
    return df.withColumns({
        "direction": F.when(long, F.lit("LONG")).otherwise(F.lit("SHORT")),
        "hit_exc": long == (c("fwd_excess") > 0), "hit_abs": long == (c("fwd_ret") > 0)})


def meta_label(df: DataFrame, horizon: int = 10, predicted_up: str = "pred_up") -> DataFrame:
    """1 where the predicted direction was right (a flat outcome is never right)."""
    r = w.forward("close", horizon)
    right = ((c(predicted_up) == 1) & (r > 0)) | ((c(predicted_up) == 0) & (r < 0))
    return df.withColumns({"meta_label": flag(right), "fwd_ret": r})


def realised(df: DataFrame, horizon: int) -> Column:
    return ratio(w.shift("close", -horizon), "close") - 1
