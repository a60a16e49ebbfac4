"""Overlap-aware significance tests of per-date statistics.

Input is a long table (series, date, x).  A series holds one value per date, so it is bounded by the
calendar and windows per series stay small.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import c, ratio


def _dense(df: DataFrame, key: str, order: str, x: str) -> DataFrame:
    """Known values numbered per series with their count and deviation from the mean."""
    whole = Window.partitionBy(key)
    return (df.where(c(x).isNotNull())
            .select(key, order, c(x).alias("x"),
                    F.row_number().over(Window.partitionBy(key).orderBy(order)).alias("i"),
                    F.count(x).over(whole).alias("n"), F.avg(x).over(whole).alias("mu"))
            .withColumn("d", F.col("x") - F.col("mu")))


def autocovariance(df: DataFrame, key: str, order: str, x: str, lags: int) -> DataFrame:
    """Autocovariances (key, lag, autocov) at lags 1..lags, divided by n."""
    rows = _dense(df, key, order, x)
    at = Window.partitionBy(key).orderBy("i")
    rows = rows.withColumns({f"_p{k}": F.col("d") * F.lag("d", k).over(at)
                             for k in range(1, lags + 1)})
    products = F.array(*[F.struct(F.lit(k).alias("lag"), F.col(f"_p{k}").alias("p"))
                         for k in range(1, lags + 1)])
    long = rows.select(key, "n", F.inline(products)).where(F.col("p").isNotNull())
    return long.groupBy(key, "lag").agg((F.sum("p") / F.max("n")).alias("autocov"))


def _profile(df: DataFrame, key: str, order: str, x: str, horizon: int = 1) -> DataFrame:
    """One row per series: moments of all and of every horizon-th value, and the deviations.

    The array of deviations is as long as the calendar.
    """
    rows = _dense(df, key, order, x)
    sub = F.when((F.col("i") - 1) % horizon == 0, F.col("x"))
    return rows.groupBy(key).agg(
        F.max("n").alias("n"), F.max("mu").alias("mean"), F.stddev_samp("x").alias("sd"),
        F.avg(sub).alias("sub_mean"), F.count(sub).alias("sub_n"), F.stddev_samp(sub).alias("sub_sd"),
        F.avg((F.col("x") > 0).cast("double")).alias("positive"),
        F.transform(F.array_sort(F.collect_list(F.struct("i", "d"))), lambda s: s["d"]).alias("d"))


def _with_hac(profile: DataFrame, lags: int | None) -> DataFrame:
    """Append lags and hac_se; the deviation array is dropped."""
    rule = F.floor(4 * F.pow(F.col("n") / 100.0, F.lit(2.0 / 9.0))) if lags is None else F.lit(lags)
    capped = F.greatest(F.lit(0), F.least(rule, F.col("n") - 2)).cast("int")
    zero = F.lit(0.0)

    def gamma(k: Column) -> Column:
        length = F.greatest(F.col("n") - k, F.lit(0)).cast("int")
        pairs = F.zip_with(F.slice("d", k + 1, length), F.slice("d", F.lit(1), length),
                           lambda a, b: a * b)
        return F.aggregate(pairs, zero, lambda acc, v: acc + v) / F.col("n")

    ks = F.when(F.col("lags") >= 1, F.sequence(F.lit(1), F.col("lags"))) \
        .otherwise(F.array().cast("array<int>"))
    var = gamma(F.lit(0)) + F.aggregate(
        ks, zero, lambda acc, k: acc + 2.0 * (1.0 - k / (F.col("lags") + 1.0)) * gamma(k))
    se = F.when((F.col("n") >= 3) & (F.col("_var") > 0), F.sqrt(F.col("_var") / F.col("n")))
    return (profile.withColumn("lags", capped).withColumn("_var", var)
            .withColumn("hac_se", se).drop("d", "_var"))


def newey_west(df: DataFrame, key: str, order: str, x: str,
               lags: int | None = None) -> DataFrame:
    """(key, n, mean, lags, hac_se): Bartlett-weighted standard error of the mean.

    Without ``lags`` the rule floor(4 (n/100)^(2/9)) is used; lags are capped at n - 2.  The error
    is missing for fewer than three values or a non-positive variance.
    """
    return _with_hac(_profile(df, key, order, x), lags).select(key, "n", "mean", "lags", "hac_se")


def mean_tests(df: DataFrame, key: str, order: str, x: str, horizon: int) -> DataFrame:
    """Naive, HAC and non-overlapping t-statistics of the mean per series, in one pass.

    Columns: mean, n, n_effective, t_naive, t_hac, t_nonoverlap, inflation, positive (share of
    positive values).  The calibrated one is t_nonoverlap, taken on every horizon-th known value.
    """
    out = _with_hac(_profile(df, key, order, x, horizon), max(1, 2 * horizon - 1))
    enough = F.col("n") >= 3
    t_naive = F.when(enough, ratio("mean", ratio("sd", F.sqrt("n"))))
    t_hac = F.when(enough, ratio("mean", "hac_se"))
    t_sub = F.when(enough & (F.col("sub_n") >= 3),
                   ratio("sub_mean", ratio("sub_sd", F.sqrt("sub_n"))))
    return (out.select(key, "mean", "n", F.bround(F.col("n") / horizon, 1).alias("n_effective"),
                       t_naive.alias("t_naive"), t_hac.alias("t_hac"),
                       t_sub.alias("t_nonoverlap"), "positive")
            .withColumn("inflation", ratio("t_naive", "t_hac")))


# Two-sided normal thresholds of the verdict.
VERY, CLEAR, MARGINAL = 2.58, 1.96, 1.65


def verdict(t: str = "t_nonoverlap") -> Column:
    size = F.abs(c(t))
    return (F.when(c(t).isNull(), F.lit("inconclusive"))
            .when(size >= VERY, F.lit("significant p<0.01"))
            .when(size >= CLEAR, F.lit("significant p<0.05"))
            .when(size >= MARGINAL, F.lit("marginal p<0.10"))
            .otherwise(F.lit("NOT significant")))


def fragile(t: str = "t_nonoverlap", hac: str = "t_hac") -> Column:
    """The higher-powered test disagrees with the calibrated one."""
    return F.coalesce((F.abs(c(hac)) >= CLEAR) != (F.abs(c(t)) >= CLEAR), F.lit(False))


def date_grid_tests(ic: DataFrame, grid: DataFrame, key: str = "factor", date: str = "date",
                    x: str = "ic") -> DataFrame:
    """Mean, naive t and the t on the dates of a rebalance grid (a date may be missing there)."""
    marked = ic.join(grid.select(F.col(date), F.lit(1).alias("_grid")), date, "left")
    on = F.col("_grid").isNotNull()
    out = marked.groupBy(key).agg(
        F.avg(x).alias("ic_mean"), F.count(x).alias("n"), F.stddev_samp(x).alias("sd"),
        F.avg(F.when(on, c(x))).alias("g_mean"), F.count(F.when(on, c(x))).alias("n_indep"),
        F.stddev_samp(F.when(on, c(x))).alias("g_sd"))
    t = F.when(F.col("n_indep") > 2, ratio("g_mean", ratio("g_sd", F.sqrt("n_indep"))))
    return out.select(key, "ic_mean", ratio("ic_mean", ratio("sd", F.sqrt("n"))).alias("t_naive"),
                      t.alias("t_nonovlp"), "n_indep",
                      F.coalesce(F.abs(t) >= CLEAR, F.lit(False)).alias("significant"))
