"""Research tables over the factor panel: horizon sweep and volatility predictability."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import indicators as ind
from ..functions import windows as w
from ..functions.exprs import c, ratio
from ..operators import crosssection as xs
from ..operators import joins, stats
from .factors import features


def horizon_sweep(panel: DataFrame, bench: DataFrame, fund: DataFrame, horizons: Sequence[int],
                  bound: int | None = None) -> DataFrame:
    """Top-quintile hit rate of three composites for several holding periods.

    One pass: rows are exploded over the horizons, every later step is keyed by (h, date).
    """
    df = features(panel).join(bench.select("date", "bench"), "date", "left")
    df = df.withColumns({f"_e{h}": w.forward("close", h) - w.forward("bench", h)
                         for h in horizons})
    df = joins.attach_fundamentals(df, fund).withColumn("earn_yield", ratio("eps", "close"))
    cells = F.array(*[F.struct(F.lit(h).alias("h"), c(f"_e{h}").alias("fwd_excess"))
                      for h in horizons])
    long = df.select("sym", "date", "mom_12_1", "rev", "deliv_x_ret", "earn_yield",
                     F.inline(cells)).where(c("fwd_excess").isNotNull())
    dates = long.select("h", "date").distinct().withColumn(
        "_k", F.row_number().over(Window.partitionBy("h").orderBy("date")) - 1)
    grid = dates.where(c("_k") % c("h") == 0).select("h", "date")
    data = long.join(grid, ["h", "date"], "left_semi")
    ranks = {f"r_{x}": x for x in ("mom_12_1", "rev", "deliv_x_ret", "earn_yield")}
    data = xs.rank_pct(data, ranks, ["h", "date"], ["sym", "h", "date"], bound)
    scores = F.array(
        F.struct(F.lit("shipped").alias("model"),
                 xs.composite_mr("r_mom_12_1", "r_rev").alias("score")),
        F.struct(F.lit("newcore").alias("model"),
                 F.round((c("r_rev") + (1 - c("r_deliv_x_ret"))) / 2, xs.TIE_DIGITS)
                 .alias("score")),
        F.struct(F.lit("fund3").alias("model"),
                 xs.composite_fund3("r_rev", "r_deliv_x_ret", "r_earn_yield").alias("score")))
    scored = data.select("h", "date", "sym", "fwd_excess", F.inline(scores)).where(
        c("score").isNotNull())
    top = xs.with_quantiles(scored, "score", {"_q": 0.8}, ["h", "model", "date"], bound).where(
        c("score") >= c("_q"))
    hit = top.groupBy("h", "model").agg(F.avg((c("fwd_excess") > 0).cast("double")).alias("hr"),
                                        F.count(F.lit(1)).alias("n_picks"))
    size = grid.groupBy("h").agg(F.count(F.lit(1)).alias("rebalances"))
    se = F.sqrt(c("hr") * (1 - c("hr")) / F.greatest(c("n_picks"), F.lit(1)))
    return hit.join(size, "h").select(
        c("h").alias("horizon"), "model", F.bround(c("hr") * 100, 2).alias("hit_rate"),
        F.bround(se * 100, 2).alias("se_pp"), "n_picks", "rebalances")


def volatility_features(panel: DataFrame, horizon: int) -> DataFrame:
    """Trailing volatility and range features with the volatility realised afterwards."""
    year = F.sqrt(F.lit(float(ind.TRADING_DAYS)))
    df = panel.withColumn("lr", ind.log_return())
    df = df.withColumns({
        "vol20": w.std("lr", 20) * year, "vol60": w.std("lr", 60) * year,
        "fwd_vol": ind.forward_volatility("lr", horizon) * year,
        "range20": w.mean(ratio(c("high") - c("low"), "close"), 20),
        "deliv_inv": -c("deliv_pct")})
    return df.where(c("fwd_vol").isNotNull())


def volatility_tests(panel: DataFrame, horizon: int, bound: int | None = None) -> DataFrame:
    df = volatility_features(panel, horizon)
    ic = xs.information_coefficient(df, ["vol20", "vol60", "range20", "deliv_inv"], "fwd_vol",
                                    bound=bound)
    return stats.date_grid_tests(ic, joins.every_hth_date(df, horizon))


def volatility_quintiles(panel: DataFrame, horizon: int, bound: int | None = None) -> DataFrame:
    """Realised volatility by quintile of the trailing one, on non-overlapping dates."""
    df = volatility_features(panel, horizon)
    df = df.join(joins.every_hth_date(df, horizon), "date", "left_semi").where(
        c("vol20").isNotNull())
    cut = xs.quantile_cut(df, "vol20", bound=bound)
    return cut.groupBy("bucket").agg(F.avg("fwd_vol").alias("fwd_vol"),
                                     F.count(F.lit(1)).alias("n"))
