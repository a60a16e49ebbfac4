"""The factor table: features, target, point-in-time fundamentals, ranks and composites."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import indicators as ind
from ..functions import windows as w
from ..functions.exprs import c, ratio
from ..operators import crosssection as xs
from ..operators import joins
from ..session import materialise, stored  # noqa: F401  (stored: for callers that read a panel twice)

# Ranked factors of the released table, and the default horizon.
RANKED = ("rev", "mom_12_1", "mom_6m", "liq", "deliv_pct", "deliv_chg20", "deliv_x_ret",
          "earn_yield", "roe", "earn_growth", "profit_margin")
FUNDAMENTAL = ("earn_yield", "roe", "earn_growth", "profit_margin")
HORIZON = 30


def features(panel: DataFrame, skip: int = 21, back: int = 252, half: int = 126) -> DataFrame:
    """Per-symbol factors; one shuffle and one sort serve all windows."""
    df = panel.withColumns({
        "ret_20": w.change("close", 20), "mom_12_1": ind.skip_momentum("close", skip, back),
        "mom_6m": w.change("close", half), "liq": w.mean(c("volume") * c("close"), 20)})
    return ind.delivery(df).withColumn("rev", -c("ret_20"))


def factor_table(panel: DataFrame, bench: DataFrame, fund: DataFrame, horizon: int = HORIZON,
                 bound: int | None = None, narrow: bool = False, **lookbacks: int) -> DataFrame:
    """Two series shuffles (features, as-of) and one by date (ranks).

    With ``narrow``, for many names a date, no task sorts whole rows by date, and what follows from other
    columns of a row is built again behind the shuffle by date.  The benchmark, a row for each date, is
    sent to all tasks: whether Spark finds out in time that it is small would else decide if all rows move
    by date and back.
    """
    bench = F.broadcast(bench) if narrow else bench
    df = features(panel, **lookbacks)
    df = joins.excess_by_symbol_calendar(df, bench, horizon).drop("bench", "bench_fwd", "fwd_ret")
    df = joins.attach_fundamentals(df, fund).withColumn("earn_yield", ratio("eps", "close"))
    ranks = {f"rank_{f}": f for f in RANKED}
    if not narrow:
        return with_composites(xs.rank_pct(df, ranks, bound=bound), bound)
    moved = df.drop("rev", "deliv_x_ret", "earn_yield").repartition("date").withColumns({
        "rev": -c("ret_20"), "deliv_x_ret": c("deliv_pct") * c("ret_20"), "earn_yield": ratio("eps", "close")})
    return xs.narrow_ranks(moved.select(*df.columns), ranks, "date", xs.COMPOSITES)


def with_composites(df: DataFrame, bound: int | None) -> DataFrame:
    df = df.withColumns({"score_mr": xs.composite_mr(), "score_fund3": xs.composite_fund3()})
    return xs.rank_pct(df, {"rank_score_mr": "score_mr", "rank_score_fund3": "score_fund3"},
                       bound=bound)


def dataset(bars: DataFrame, bench: DataFrame, horizons: tuple[int, ...] = (10,),
            min_bars: int = 300, **lookbacks: int) -> DataFrame:
    """Rows with every lookback known, with forward excess returns on the benchmark calendar.

    Columns: sym, date, close, ret_20, mom_12_1, mom_6m, liq and per horizon fwd_<h>, exc_<h>.
    """
    df = features(bars, **lookbacks).withColumn(
        "_bars", F.count("close").over(Window.partitionBy("sym")))
    df = df.withColumns({f"fwd_{h}": w.forward("close", h) for h in horizons})
    df = df.where((c("_bars") >= min_bars) & c("mom_12_1").isNotNull() & c("mom_6m").isNotNull()
                  & c("ret_20").isNotNull() & c("liq").isNotNull())
    b = bench.select("date", *[
        (ratio(F.lead("bench", h).over(Window.orderBy("date")), "bench") - 1).alias(f"_b{h}")
        for h in horizons])
    df = df.join(b, "date", "left")
    return df.select("sym", "date", "close", "ret_20", "mom_12_1", "mom_6m", "liq",
                     *[f"fwd_{h}" for h in horizons],
                     *[(c(f"fwd_{h}") - c(f"_b{h}")).alias(f"exc_{h}") for h in horizons])


def signals(bars: DataFrame, bench: DataFrame, horizon: int = 10,
            bound: int | None = None) -> DataFrame:
    """Out-of-sample style predictions: reversal percentile as probability, one fold per year."""
    df = joins.excess_by_benchmark_calendar(bars.withColumn("rev", -w.change("close", 20)), bench,
                                            horizon)
    df = df.where(c("rev").isNotNull() & c("fwd_excess").isNotNull())
    df = xs.rank_pct(df, {"proba": "rev"}, bound=bound)
    return df.select("sym", "date", "close", "fwd_ret", "fwd_excess", "proba",
                     (c("fwd_excess") > 0).cast("int").alias("label"),
                     F.year("date").alias("fold"))


MODELS = ("composite", "momentum", "reversal", "liquidity")


def signal_percentiles(df: DataFrame, bound: int | None = None) -> DataFrame:
    """Four model signals as percentiles of the date: sig_composite, sig_momentum, ..."""
    df = xs.rank_pct(df, {"sig_momentum": "mom_12_1", "_ret": "ret_20", "sig_liquidity": "liq"},
                     bound=bound)
    df = df.withColumn("sig_reversal", 1 - c("_ret"))
    df = df.withColumn("_comp", c("sig_momentum") + c("sig_reversal"))
    return xs.rank_pct(df, {"sig_composite": "_comp"}, bound=bound).drop("_ret", "_comp")


def model_bench(df: DataFrame, horizons: tuple[int, ...], bound: int | None = None) -> DataFrame:
    """Per symbol, model and horizon: accuracy, up rate, count, latest direction and rank."""
    df = signal_percentiles(df, bound)
    # Every column is built over the exploded row, so the cells share one pass over the table.
    cells = F.array(*[F.struct(F.lit(m).alias("model"), F.lit(h).alias("horizon"),
                               c(f"sig_{m}").alias("sig"), c(f"fwd_{h}").alias("fwd"),
                               c(f"exc_{h}").alias("exc"))
                      for m in MODELS for h in horizons])
    long = df.select("sym", "date", F.inline(cells))
    scored = F.col("fwd").isNotNull() & F.col("exc").isNotNull()
    is_long = F.col("sig") >= 0.5
    hit = lambda x: F.avg(F.when(scored, (is_long == (F.col(x) > 0)).cast("double")))
    per = long.groupBy("sym", "model", "horizon").agg(
        hit("exc").alias("acc_excess"), hit("fwd").alias("acc_abs"),
        F.avg(F.when(scored, (F.col("fwd") > 0).cast("double"))).alias("up_rate"),
        F.count(F.when(scored, F.lit(1))).alias("n"),
        F.max_by("sig", "date").alias("sig"), F.max("date").alias("_last"))
    per = materialise(per)  # one row per symbol, model and horizon; read three times below
    per = per.where(F.col("_last") == per.agg(F.max("_last")).scalar()).drop("_last")
    ranked = xs.ordinal(per, "sig", ["model", "horizon"], "sym", bound)
    size = per.groupBy("model", "horizon").agg(F.count(F.lit(1)).alias("universe"))
    pct = lambda x: F.bround(F.col(x) * 100, 1)
    return ranked.join(size, ["model", "horizon"]).select(
        "sym", "model", "horizon",
        F.when(F.col("sig") >= 0.5, F.lit("LONG")).otherwise(F.lit("SHORT")).alias("direction"),
        F.bround("sig", 3).alias("score_pctile"), "rank", "universe",
        pct("acc_excess").alias("acc_excess_pct"), pct("acc_abs").alias("acc_abs_pct"),
        pct("up_rate").alias("up_rate_pct"), "n")
