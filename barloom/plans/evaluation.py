"""Comparison of models over out-of-sample predictions and parameter sweeps."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import windows as w
from ..functions.exprs import c, ratio, share
from ..operators import backtest as bt
from ..operators import crosssection as xs
from ..operators import metrics
from ..session import materialise


def compare_models(oos: DataFrame, horizon: int = 10, k: int = 5, cost_bps: float = 10,
                   bound: int | None = None) -> DataFrame:
    """One rounded metric row per model from (model, fold, date, sym, proba, label, fwd_excess).

    All models go through the same grouped passes; nothing loops over models or folds.  The
    predictions are stored once, since every metric reads them.
    """
    oos = materialise(oos)
    overall = oos.groupBy("model").agg(
        metrics.accuracy().alias("acc"), F.avg("label").alias("base"),
        F.count(F.lit(1)).alias("n_predictions"))
    area = metrics.auc(oos, by=["model"], bound=bound).select("model", "auc")
    folds = metrics.auc(oos, by=["model", "fold"], bound=bound).groupBy("model").agg(
        F.avg("auc").alias("fm"), F.stddev_pop("auc").alias("fs"),
        share(c("auc") > 0.5).alias("fp"))
    cut = xs.quantile_cut(oos, "proba", by=["model", "fold"], bound=bound)
    means = cut.groupBy("model", "bucket").agg(F.sum("fwd_excess").alias("s"),
                                               F.count("fwd_excess").alias("n"))
    ends = means.groupBy("model").agg(
        F.max_by(ratio("s", "n"), "bucket").alias("qt"),
        F.max(F.when(c("bucket") == 0, ratio("s", "n"))).alias("qb"))
    days = oos.select("model", "date").distinct()
    at = F.row_number().over(Window.partitionBy("model").orderBy("date")) - 1
    sizes = oos.groupBy("model", "date").agg(F.count(F.lit(1)).alias("_n"))
    grid = (days.withColumn("_i", at).where(c("_i") % horizon == 0)
            .join(sizes.where(c("_n") >= k), ["model", "date"]).select("model", "date"))
    held = bt.basket(oos, grid, "proba", k, cost_bps, by=["model"])
    year = bt.YEAR / horizon
    book = held.groupBy("model").agg(F.avg("pnl").alias("m"), F.stddev_samp("pnl").alias("s"),
                                     F.avg("hit").alias("h"), F.count(F.lit(1)).alias("n_rebalances"))
    out = overall
    for part in (area, folds, ends, book):
        out = out.join(part, "model")
    sharpe = F.coalesce(ratio(c("m") * year, c("s") * year ** 0.5), F.lit(0.0))
    r = lambda x, n: F.bround(c(x), n)
    return out.select(
        "model", r("auc", 4).alias("auc"), r("acc", 4).alias("accuracy"),
        r("base", 4).alias("baseline_up_rate"), r("fm", 4).alias("fold_auc_mean"),
        r("fs", 4).alias("fold_auc_std"), F.bround(c("fp") * 100, 0).alias("fold_auc_positive_pct"),
        r("qt", 4).alias("top_quintile_excess"),
        F.bround(c("qt") - c("qb"), 4).alias("quintile_spread"),
        F.bround(c("m") * year * 100, 1).alias("ann_excess_pct"), F.bround(sharpe, 2).alias("sharpe"),
        F.bround(c("h") * 100, 1).alias("avg_hit_rate_pct"), "n_rebalances", "n_predictions")


def parameter_sweep(bars: DataFrame, horizons: Sequence[int], moves: Sequence[float],
                    bound: int | None = None, cut: float = 0.6) -> DataFrame:
    """Label rate, precision, coverage and mean return per (horizon, move) in one pass."""
    df = bars.withColumn("rv", -w.change("close", 20)).where(c("rv").isNotNull())
    ahead = bars.select("sym", "date", *[w.forward("close", h).alias(f"f{h}") for h in horizons])
    df = xs.rank_pct(df.select("sym", "date", "rv"), {"p": "rv"}, bound=bound).join(
        ahead, ["sym", "date"])
    grid = F.array(*[F.struct(F.lit(h).alias("horizon"), F.lit(m).alias("move"),
                              c(f"f{h}").alias("f")) for h in horizons for m in moves])
    long = df.select("p", F.inline(grid)).where(c("f").isNotNull())
    said, true = c("p") >= cut, c("f") > c("move")
    return long.groupBy("horizon", "move").agg(
        F.count(F.lit(1)).alias("n"), F.avg(true.cast("double")).alias("positive_rate"),
        F.coalesce(ratio(F.count_if(said & true), F.count_if(said)), F.lit(0.0)).alias("precision"),
        F.avg(said.cast("double")).alias("coverage"),
        F.avg(F.when(said, c("f"))).alias("mean_ret"))
