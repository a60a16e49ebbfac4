"""Evaluation of predictions: classification, trading and bucket metrics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import c, flag, ratio, share
from . import crosssection as xs


def hit_rate(x: str) -> Column:
    return share(c(x) > 0)


def auc(df: DataFrame, score: str = "proba", label: str = "label", by: Sequence[str] = (),
        bound: int | None = None) -> DataFrame:
    """Exact area under the ROC curve per group, ties averaged; missing for a single class.

    Rows collapse to one cell per distinct score before anything is ordered.
    """
    by = list(by)
    one = F.col(label) == 1
    cells = df.where(c(score).isNotNull()).groupBy(*by, score).agg(
        F.count(F.when(one, 1)).alias("pos"), F.count(F.when(~one, 1)).alias("neg"))
    keyed = cells.withColumn("_all", F.lit(0))
    ordered = xs.below(keyed, [*by, "_all"], score, ["pos", "neg"], bound)
    wins = F.sum(F.col("pos") * (F.col("neg_below") + F.col("neg") / 2.0))
    pairs = F.max("pos_total") * F.max("neg_total")
    return ordered.groupBy(*by, "_all").agg(ratio(wins, pairs).alias("auc"),
                                            (F.max("pos_total") + F.max("neg_total")).alias("n")) \
        .drop("_all")


def accuracy(cut: float = 0.5, score: str = "proba", label: str = "label") -> Column:
    return F.avg((flag(c(score) > cut) == c(label)).cast("double"))


def classification(df: DataFrame, by: Sequence[str], pred: str = "pred",
                   label: str = "label") -> DataFrame:
    """Precision, recall and F1; zero where undefined."""
    tp = F.count(F.when((c(pred) == 1) & (c(label) == 1), 1))
    said = F.count(F.when(c(pred) == 1, 1))
    true = F.count(F.when(c(label) == 1, 1))
    out = df.groupBy(*by).agg(tp.alias("tp"), said.alias("said"), true.alias("true"))
    zero = F.lit(0.0)
    return out.select(*by, F.coalesce(ratio("tp", "said"), zero).alias("precision"),
                      F.coalesce(ratio("tp", "true"), zero).alias("recall"),
                      F.coalesce(ratio(2 * c("tp"), c("said") + c("true")), zero).alias("f1"))


def trading(df: DataFrame, by: Sequence[str]) -> DataFrame:
    """Coverage, trade counts, win rate and mean trade return from ``side`` and ``net``."""
    traded = c("side") != 0
    zero = F.lit(0.0)
    return df.groupBy(*by).agg(
        F.avg(traded.cast("double")).alias("coverage"), F.count(F.when(traded, 1)).alias("trades"),
        F.count(F.when(c("side") == 1, 1)).alias("longs"),
        F.count(F.when(c("side") == -1, 1)).alias("shorts"),
        F.coalesce(F.avg(F.when(traded, (c("net") > 0).cast("double"))), zero)
        .alias("trade_win_rate"),
        F.coalesce(F.avg(F.when(traded, c("net"))) * 100, zero).alias("avg_trade_ret_pct"))


def hit_statistics(df: DataFrame, top: Column, bottom: Column | None = None,
                   target: str = "fwd_excess", by: Sequence[str] = (),
                   date: str = "date") -> DataFrame:
    """Hit rate of the picks with binomial error, 95% interval, base rate, edge and spread."""
    win = (c(target) > 0).cast("double")
    cols = [F.avg(F.when(top, win)).alias("hit"), F.count(F.when(top, 1)).alias("n_picks"),
            F.avg(win).alias("base"), F.count_distinct(date).alias("n_rebalances"),
            F.avg(F.when(top, c(target))).alias("top_mean")]
    cols.append(F.avg(F.when(bottom, c(target))).alias("bottom_mean") if bottom is not None
                else F.lit(None).cast("double").alias("bottom_mean"))
    out = df.groupBy(*by).agg(*cols)
    se = F.sqrt(c("hit") * (1 - c("hit")) / F.greatest(c("n_picks"), F.lit(1)))
    out = out.withColumn("_se", se)
    return out.select(
        *by, (c("hit") * 100).alias("hit_rate"), (c("_se") * 100).alias("se"),
        ((c("hit") - 1.96 * c("_se")) * 100).alias("ci_lo"),
        ((c("hit") + 1.96 * c("_se")) * 100).alias("ci_hi"), (c("base") * 100).alias("base_rate"),
        ((c("hit") - c("base")) * 100).alias("edge_pp"),
        ((c("top_mean") - c("bottom_mean")) * 100).alias("spread_pp"), "n_picks", "n_rebalances",
        F.coalesce(c("hit") - 1.96 * c("_se") > c("base"), F.lit(False)).alias("beats_base"))


def fifths(df: DataFrame, score: str, by: str = "date", tie: str = "sym",
           bound: int | None = None, parts: int = 5) -> DataFrame:
    """Flags for the best and the worst max(n // 5, 1) rows of each date, ties by symbol."""
    df = xs.ordinal(df, score, by, tie, bound, "_top")
    df = xs.ordinal(df.withColumn("_neg", -c(score)), "_neg", by, tie, bound, "_bottom")
    sizes = df.groupBy(by).agg(F.greatest(F.floor(F.count(F.lit(1)) / parts), F.lit(1)).alias("_k"))
    df = df.join(sizes, by)
    return df.withColumns({"is_top": c("_top") <= c("_k"), "is_bottom": c("_bottom") <= c("_k")}) \
        .drop("_top", "_bottom", "_neg", "_k")


def monotonic(df: DataFrame, bucket: str, value: str) -> DataFrame:
    """Whether the value never falls from one bucket to the next; a handful of rows."""
    before = F.lag(value).over(Window.orderBy(bucket))
    return df.select((c(value) >= before).alias("_ok")).agg(
        F.coalesce(F.bool_and("_ok"), F.lit(True)).alias("monotonic"))
