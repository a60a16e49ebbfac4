"""Basket backtests, signal P&L, threshold search and evaluation tables.

Everything after basket selection has one row per rebalance date, so ordered windows over it are
bounded by the calendar.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import windows as w
from ..functions.exprs import c, ratio, share
from . import crosssection as xs
from . import longseries

YEAR = 252


# ---- schedules -----------------------------------------------------------------------------
def fixed_schedule(df: DataFrame, step: int, k: int, date: str = "date") -> DataFrame:
    """Every step-th date; dates with fewer than k names are passed over without moving the grid."""
    counts = df.groupBy(date).agg(F.count(F.lit(1)).alias("_n"))
    at = F.row_number().over(Window.orderBy(date))
    return (counts.withColumn("_i", at).where(((F.col("_i") - 1) % step == 0) & (F.col("_n") >= k))
            .select(date))


def greedy_schedule(df: DataFrame, step: int, k: int, by: Sequence[str] = (),
                    date: str = "date", block: int = 4096) -> DataFrame:
    """First date with k names, then ``step`` dates on; thin dates are retried the next date.

    Dates are numbered and cut into blocks, all blocks at once.  What a walk does in a block depends
    only on how many of its first dates it has to pass over, at most ``step``; so each block becomes a
    table from that number to the one for the next block.  The tables, one row a block, are followed
    in order, and then every block is walked once from its known start.  Rows without a date are
    left out.
    """
    by, block = list(by), max(block, step)
    counts = df.where(c(date).isNotNull()).groupBy(*by, date).agg(F.count(F.lit(1)).alias("_n"))
    keyed = counts.withColumn("_key", F.struct(*by) if by else F.struct(F.lit(0).alias("_all")))
    rows = longseries.numbered(keyed, "_key", date, name="_row")
    days = rows.groupBy("_key", F.floor((c("_row") - 1) / block).alias("_block")).agg(
        F.array_sort(F.collect_list(F.struct("_row", date, "_n"))).alias("_days"))

    def free_after(free: Column) -> Column:
        walked = F.aggregate(
            "_days", F.struct(F.lit(0).alias("i"), free.cast("int").alias("free")),
            lambda acc, day: F.struct(
                (acc["i"] + 1).alias("i"),
                F.when((acc["i"] >= acc["free"]) & (day["_n"] >= k), acc["i"] + step)
                .otherwise(acc["free"]).alias("free")))
        return F.greatest(walked["free"] - F.size("_days"), F.lit(0))

    tables = days.select("_key", "_block", F.transform(
        F.sequence(F.lit(0), F.lit(step - 1)), free_after).alias("_after"))
    start = F.struct(F.lit(0).alias("free"),
                     F.array().cast("array<struct<_block:bigint,_free:int>>").alias("out"))
    followed = F.aggregate(
        F.array_sort(F.collect_list(F.struct("_block", "_after"))), start,
        lambda acc, x: F.struct(
            F.get(x["_after"], acc["free"]).alias("free"),
            F.concat(acc["out"], F.array(F.struct(x["_block"].alias("_block"), acc["free"].alias("_free"))))
            .alias("out")))
    starts = tables.groupBy("_key").agg(followed.alias("_w")).select("_key", F.explode("_w.out").alias("_x")) \
        .select("_key", "_x._block", "_x._free")

    kind = counts.schema[date].dataType.simpleString()
    begin = F.struct(F.lit(0).alias("i"), c("_free").alias("free"), F.array().cast(f"array<{kind}>").alias("out"))

    def walk(acc: Column, day: Column) -> Column:
        take = (acc["i"] >= acc["free"]) & (day["_n"] >= k)
        return F.struct(
            (acc["i"] + 1).alias("i"),
            F.when(take, acc["i"] + step).otherwise(acc["free"]).alias("free"),
            F.when(take, F.concat(acc["out"], F.array(day[date]))).otherwise(acc["out"]).alias("out"))

    picked = days.join(starts, ["_key", "_block"]).select(
        "_key", F.explode(F.aggregate("_days", begin, walk)["out"]).alias(date))
    return picked.select(*[c("_key")[x].alias(x) for x in by], date)


# ---- baskets -------------------------------------------------------------------------------
def basket(df: DataFrame, schedule: DataFrame, score: str, k: int, cost_bps: float = 10,
           target: str = "fwd_excess", by: Sequence[str] = ()) -> DataFrame:
    """Mean target of the k best names per scheduled date, less two-sided costs."""
    by = list(by)
    rows = df.join(schedule, [*by, "date"], "left_semi")
    picks = xs.top_k(rows, score, k, [*by, "date"])
    return picks.groupBy(*by, "date").agg(
        (F.avg(target) - 2 * cost_bps / 1e4).alias("pnl"),
        F.avg((c("label") == 1).cast("double")).alias("hit"), F.count(F.lit(1)).alias("picks"))


def equity_curve(trades: DataFrame, by: Sequence[str] = (), pnl: str = "pnl") -> DataFrame:
    at = Window.partitionBy(*by).orderBy("date")
    so_far = at.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    df = trades.withColumn("equity", F.product(1 + c(pnl)).over(so_far))
    return df.withColumn("drawdown", ratio("equity", F.max("equity").over(so_far)) - 1)


def summary(curve: DataFrame, horizon: int, by: Sequence[str] = (), pnl: str = "pnl") -> DataFrame:
    """Total and annualised return, volatility, Sharpe, worst drawdown and hit rate."""
    per_year = YEAR / horizon
    out = curve.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_rebalances"), (F.max_by("equity", "date") - 1).alias("total_return"),
        (F.avg(pnl) * per_year).alias("ann_return"),
        (F.stddev_samp(pnl) * per_year ** 0.5).alias("ann_vol"),
        F.min("drawdown").alias("max_drawdown"), F.avg("hit").alias("hit_rate"))
    return out.withColumn("sharpe", F.coalesce(
        F.when(c("ann_vol") > 0, c("ann_return") / c("ann_vol")), F.lit(0.0)))


def against_universe(df: DataFrame, score: str, k: int = 5, horizon: int = 10,
                     cost_bps: float = 10, bound: int | None = None) -> DataFrame:
    """Basket and equal-weight universe per greedy rebalance, in percent."""
    schedule = greedy_schedule(df, horizon, k)
    rows = df.join(schedule, "date", "left_semi")
    picks = xs.top_k(rows, score, k)
    fee = 2 * cost_bps / 1e4
    mine = picks.groupBy("date").agg(
        (F.avg("fwd_ret") - fee).alias("_s"),
        F.concat_ws(", ", F.transform(F.array_sort(F.collect_list(F.struct("pick", "sym"))),
                                      lambda x: x["sym"])).alias("picks"),
        F.bround(F.avg((c("label") == 1).cast("double")) * 100, 0).alias("hit_rate"))
    all_ = rows.groupBy("date").agg((F.avg("fwd_ret") - fee).alias("_b"))
    return mine.join(all_, "date").select(
        "date", "picks", F.bround(c("_s") * 100, 2).alias("strat_ret"),
        F.bround(c("_b") * 100, 2).alias("bench_ret"),
        F.bround((c("_s") - c("_b")) * 100, 2).alias("excess"), "hit_rate")


def synthetic_benchmark(bars: DataFrame) -> DataFrame:
    """Equal-weight mean return per date and its running product."""
    moved = bars.withColumn("_r", w.change("close", 1))
    daily = moved.groupBy("date").agg(F.avg("_r").alias("mean_ret"))
    so_far = Window.orderBy("date").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return daily.withColumn(
        "level", F.product(1 + F.coalesce(c("mean_ret"), F.lit(0.0))).over(so_far))


def score_rotation(df: DataFrame, score: str = "score", k: int = 5, step: int = 14,
                   capital: float = 100000.0) -> DataFrame:
    """Every ``step`` dates hold the k best scores until the next date of the grid.

    Grid dates need at least k names; a name counts when it has a bar on both ends.  Returns one row
    per rebalance with basket and universe return in percent and both equity curves.
    """
    counts = df.groupBy("date").agg(F.count(F.lit(1)).alias("_n")).where(c("_n") >= k)
    grid = counts.withColumn("_i", F.row_number().over(Window.orderBy("date")) - 1)
    ends = grid.where(c("_i") % step == 0).withColumn(
        "_next", F.lead("date").over(Window.orderBy("date"))).where(c("_next").isNotNull())
    starts = df.join(ends.select("date", "_next"), "date")
    later = df.select("sym", c("date").alias("_next"), c("close").alias("_exit"))
    held = starts.join(later, ["sym", "_next"]).withColumn(
        "ret", ratio(c("_exit") - c("close"), "close") * 100)
    chosen = xs.top_k(held, score, k).groupBy("date").agg(F.avg("ret").alias("top_ret"))
    universe = held.groupBy("date").agg(F.avg("ret").alias("bench_ret"),
                                        F.count(F.lit(1)).alias("names"))
    out = universe.where(c("names") >= k).join(chosen, "date")
    so_far = Window.orderBy("date").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = out.withColumns({
        "portfolio": capital * F.product(1 + c("top_ret") / 100).over(so_far),
        "benchmark": capital * F.product(1 + c("bench_ret") / 100).over(so_far)})
    peak = F.greatest(F.max("portfolio").over(so_far), F.lit(capital))
    return out.withColumn("drawdown", c("portfolio") / peak - 1)


def rotation_summary(curve: DataFrame, step: int = 14, capital: float = 100000.0) -> DataFrame:
    r = c("top_ret") / 100
    out = curve.agg(
        F.max_by("portfolio", "date").alias("p"), F.max_by("benchmark", "date").alias("b"),
        F.least(F.min("drawdown"), F.lit(0.0)).alias("dd"), F.avg(r).alias("m"),
        F.stddev_pop(r).alias("s"), F.count(F.lit(1)).alias("rebalance_count"))
    up = lambda x: (c(x) / capital - 1) * 100
    sharpe = F.coalesce(F.when(c("s") > 0, c("m") / c("s") * (YEAR / step) ** 0.5), F.lit(0.0))
    return out.select(
        F.bround("p", 2).alias("final_capital"), F.bround(up("p"), 2).alias("strategy_total_return"),
        F.bround(up("b"), 2).alias("benchmark_total_return"),
        F.bround(up("p") - up("b"), 2).alias("alpha"), F.bround(c("dd") * 100, 2)
        .alias("max_drawdown"), F.bround(sharpe, 2).alias("sharpe_ratio"), "rebalance_count")


# ---- signals -------------------------------------------------------------------------------
def side(score: Column, threshold: Column) -> Column:
    return (F.when(score >= threshold, F.lit(1)).when(score <= 1 - threshold, F.lit(-1))
            .otherwise(F.lit(0)))


def signal_pnl(df: DataFrame, threshold: float | Column, cost_bps: float = 10,
               score: str = "proba", ret: str = "fwd_ret") -> DataFrame:
    """Side +1 / -1 / 0, gross and net return per prediction."""
    thr = threshold if isinstance(threshold, Column) else F.lit(threshold)
    df = df.withColumn("side", side(c(score), thr))
    cost = F.when(c("side") != 0, F.lit(cost_bps / 10000.0)).otherwise(F.lit(0.0))
    df = df.withColumn("gross", c("side") * c(ret))
    return df.withColumn("net", c("gross") - cost)


def fold_equity(df: DataFrame, by: Sequence[str] = ("fold",), order: Sequence[str] = ("date", "sym"),
                net: str = "net") -> DataFrame:
    """Running equity and drawdown over the predictions of a fold.

    Net returns are first multiplied up per date, so only one row per fold and date is ordered.
    """
    daily = df.groupBy(*by, "date").agg(F.product(1 + c(net)).alias("growth"),
                                        F.count(F.lit(1)).alias("n"))
    so_far = (Window.partitionBy(*by).orderBy("date")
              .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    out = daily.withColumn("equity", F.product("growth").over(so_far))
    return out.withColumn("drawdown", ratio("equity", F.max("equity").over(so_far)) - 1)


# The searched grid of probability thresholds.
THRESHOLDS = tuple(round(0.50 + 0.01 * i, 2) for i in range(46))


def threshold_search(df: DataFrame, by: Sequence[str], min_coverage: float = 0.05,
                     min_trades: int = 5, target_precision: float = 0.55, cost_bps: float = 10,
                     score: str = "proba", label: str = "label", ret: str = "fwd_ret") -> DataFrame:
    """Best threshold per group: precision target first, then precision, coverage and return.

    A prediction is long for all thresholds up to its score and else short for all up to one minus
    it, so it belongs to one band of each kind.  Rows are summed map-side to one row per group and
    band; the at most 92 bands of a group give its 46 thresholds.  Groups where no threshold
    qualifies get 0.50.
    """
    by = list(by)
    grid = F.array(*[F.lit(v) for v in THRESHOLDS])
    cost = F.lit(cost_bps / 10000.0)
    longs = F.size(F.filter(grid, lambda t: c(score) >= t))
    shorts = F.when(c("_long") == 0, F.size(F.filter(grid, lambda t: c(score) <= 1 - t))).otherwise(0)
    rows = df.select(*by, score, label, ret, longs.alias("_long")).withColumn("_short", shorts)
    bands = rows.groupBy(*by, "_long", "_short").agg(
        F.count(score).alias("n"), F.count_if((c("_long") > 0) & (c(label) == 1)).alias("tp"),
        F.product(F.when(c("_long") > 0, 1.0 + (c(ret) - cost))).alias("up"),
        F.product(F.when(c("_short") > 0, 1.0 + (-c(ret) - cost))).alias("down"))
    groups = bands.groupBy(*by).agg(F.collect_list(F.struct("_long", "_short", "n", "tp", "up", "down")).alias("_bands"),
                                    F.sum("n").alias("_n"))
    per = groups.select("*", F.posexplode(grid).alias("_k", "threshold"))

    def over(part, start, step):
        return F.aggregate(F.filter("_bands", lambda b: b[part] > c("_k")), start, step)

    none = F.lit(0).cast("bigint")
    total = over("_long", F.lit(1.0), lambda a, b: a * F.coalesce(b["up"], F.lit(1.0))) \
        * over("_short", F.lit(1.0), lambda a, b: a * F.coalesce(b["down"], F.lit(1.0))) - 1
    cells = per.select(
        *by, "threshold", "_n", over("_long", none, lambda a, b: a + b["n"]).alias("trades"),
        over("_long", none, lambda a, b: a + b["tp"]).alias("_tp"), total.alias("_total"))
    cells = cells.withColumn("coverage", ratio("trades", "_n"))
    precision = F.coalesce(ratio("_tp", "trades"), F.lit(0.0))
    cells = cells.withColumn("precision", precision)
    points = F.when(c("precision") >= target_precision, 10.0 + c("coverage") + c("_total")) \
        .otherwise(c("precision") + 0.05 * c("coverage") + c("_total"))
    ok = (c("coverage") >= min_coverage) & (c("trades") >= min_trades)
    cells = cells.withColumn("_points", F.when(ok, F.round(points, 9)))
    best = F.max_by(F.struct("threshold", "precision", "trades"),
                    F.when(ok, F.struct("_points", (-c("threshold")).alias("_first"))))
    out = cells.groupBy(*by).agg(best.alias("b"))
    return out.select(*by, F.coalesce("b.threshold", F.lit(0.50)).alias("threshold"),
                      F.coalesce("b.precision", F.lit(0.0)).alias("precision"),
                      F.coalesce("b.trades", F.lit(0)).alias("trades"))


# ---- tables --------------------------------------------------------------------------------
# Upper edges and names of the score tiers.
TIERS = ((45, "Bearish (0-45)"), (60, "Caution (45-60)"), (75, "Neutral (60-75)"),
         (85, "Bullish (75-85)"), (100, "Top Tier (85-100)"))


def tier(score: str) -> Column:
    out = F.when(c(score) <= 0, F.lit(None).cast("string"))
    for edge, name in TIERS:
        out = out.when(c(score) <= edge, F.lit(name))
    return out


def tier_table(df: DataFrame, score: str = "score", near: str = "fwd_10d",
               far: str = "fwd_21d") -> DataFrame:
    """Counts, win rates, mean returns and payoff ratio per score tier."""
    loss = F.coalesce(F.abs(F.avg(F.when(c(far) < 0, c(far)))), F.lit(1.0))
    gain = F.coalesce(F.avg(F.when(c(far) > 0, c(far))), F.lit(0.0))
    pct = lambda x: F.bround(share(c(x) > 0) * 100, 1)
    return df.withColumn("tier", tier(score)).where(c("tier").isNotNull()).groupBy("tier").agg(
        F.count(F.lit(1)).alias("n"), pct(near).alias("win_rate_10d"),
        F.bround(F.avg(near), 2).alias("avg_ret_10d"), pct(far).alias("win_rate_21d"),
        F.bround(F.avg(far), 2).alias("avg_ret_21d"),
        F.bround(F.coalesce(ratio(gain, loss), F.lit(0.0)), 2).alias("payoff_ratio"))


# Distance from one half and its label.
CONFIDENCE = ((0.02, "0-2%"), (0.05, "2-5%"), (0.10, "5-10%"), (0.15, "10-15%"))


def confidence_bucket(score: str) -> Column:
    away = F.abs(c(score) - 0.5)
    out = None
    for edge, name in CONFIDENCE:
        out = F.when(away < edge, F.lit(name)) if out is None else out.when(away < edge, F.lit(name))
    return out.otherwise(F.lit("15%+"))


def confidence_gate(df: DataFrame, score: str, hit: str = "is_hit", cut: float = 0.6) -> DataFrame:
    """Accuracy above minus below the median confidence, and accuracy above a fixed cut."""
    median = xs.quantile_table(df, score, (0.5,), ()).select(F.col("q")[0]).scalar()
    good = c(hit).cast("double")
    df = df.withColumn("_md", median)
    return df.agg(
        F.coalesce((F.avg(F.when(c(score) > c("_md"), good))
                    - F.avg(F.when(c(score) <= c("_md"), good))) * 100, F.lit(0.0))
        .alias("gate_added_value"),
        F.coalesce(F.avg(F.when(c(score) > cut, good)) * 100, F.lit(0.0)).alias("filtered_accuracy"),
        F.count_if(c(score) > cut).alias("filtered_count"))
