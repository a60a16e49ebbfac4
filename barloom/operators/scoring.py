"""Rule-based scores: technical health, mood, decision gates, forecast summaries."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import indicators as ind
from ..functions import windows as w
from ..functions.exprs import c, clip, ratio
from .labels import direction

# ---- health score: fixed values -------------------------------------------------------------
TREND_POINTS = {"above_sma20": 12.0, "sma20_above_sma50": 13.0, "above_ema20": 10.0}
MACD_POINTS = 5.0
RSI_POINTS = {"from 50 to 68": (50.0, 68.0, 20.0), "over 68 to 75": (68.0, 75.0, 15.0), "from 40 under 50": (40.0, 50.0, 10.0),
              "under 30": (None, 30.0, 12.0), "else": (None, None, 5.0)}
MONTH_POINTS = ((10.0, 15.0), (5.0, 12.0), (0.0, 8.0))     # return above -> points
LONG_POINTS = ((15.0, 10.0), (5.0, 7.0), (0.0, 4.0))       # return above -> points
SCORE_RANGE = (5.0, 100.0)
SIGNALS = ((80, "STRONG BUY (Top Performer)"), (65, "BULLISH (Uptrend Momentum)"),
           (50, "NEUTRAL / ACCUMULATE"), (35, "CAUTION / CONSOLIDATION"))
WEAKEST = "BEARISH (Downtrend / Exit)"


def _points(cond: Column, points: float) -> Column:
    return F.when(cond, F.lit(points)).otherwise(F.lit(0.0))


def rsi_points(rsi: Column) -> Column:
    best, strong, weak, sold, rest = RSI_POINTS.values()
    return (F.when(rsi.between(best[0], best[1]), F.lit(best[2]))
            .when((rsi > strong[0]) & (rsi <= strong[1]), F.lit(strong[2]))
            .when((rsi >= weak[0]) & (rsi < weak[1]), F.lit(weak[2]))
            .when(rsi < sold[1], F.lit(sold[2])).otherwise(F.lit(rest[2])))


def _ladder(x: Column, steps: Sequence[tuple[float, float]], otherwise: Column) -> Column:
    out = None
    for edge, points in steps:
        out = F.when(x > edge, F.lit(points)) if out is None else out.when(x > edge, F.lit(points))
    return out.otherwise(otherwise)


def health_inputs(df: DataFrame, history: bool = True) -> DataFrame:
    """Averages, RSI, MACD, returns and volume ratio the health score is built from.

    ``history`` asks for full averages and a 63-bar return; otherwise averages start with the first
    bar and the long return is measured from the first bar of the series.
    """
    mp = None if history else 1
    df = ind.smoothed(df, ["ema_20", "ema_12", "ema_26", "macd_signal", "avg_gain", "avg_loss"])
    base = F.first("close", ignorenulls=True).over(w.running())
    long = w.change("close", 63) * 100 if history else (ratio("close", base) - 1) * 100
    return df.withColumns({
        "sma_20": w.mean("close", 20, mp), "sma_50": w.mean("close", 50, mp), "rsi": ind.rsi(),
        "macd": ind.macd(), "ret_1w": F.coalesce(w.change("close", 5) * 100, F.lit(0.0)),
        "ret_1m": F.coalesce(w.change("close", 21) * 100, F.lit(0.0)),
        "ret_long": F.coalesce(long, F.lit(0.0)),
        "vol_ratio": F.coalesce(ratio("volume", w.mean("volume", 20, 1)), F.lit(1.0)),
        "prev_close": w.shift("close", 1)})


def health_score() -> Column:
    """0..100 points: trend 35, momentum 25, returns 25, volume 15."""
    trend = (_points(c("close") > c("sma_20"), TREND_POINTS["above_sma20"])
             + _points(c("sma_20") > c("sma_50"), TREND_POINTS["sma20_above_sma50"])
             + _points(c("close") > c("ema_20"), TREND_POINTS["above_ema20"]))
    momentum = rsi_points(c("rsi")) + _points(c("macd") > c("macd_signal"), MACD_POINTS)
    falling = F.greatest(F.lit(0.0), 8.0 + c("ret_1m") * 0.5)
    returns = _ladder(c("ret_1m"), MONTH_POINTS, falling) \
        + _ladder(c("ret_long"), LONG_POINTS, F.lit(0.0))
    volume = (F.when((c("vol_ratio") >= 1.5) & (c("close") > c("prev_close")), F.lit(15.0))
              .when(c("vol_ratio") >= 1.0, F.lit(10.0)).otherwise(F.lit(5.0)))
    return F.bround(clip(trend + momentum + returns + volume, *SCORE_RANGE), 1)


def signal_class(score: str = "score") -> Column:
    out = None
    for edge, name in SIGNALS:
        out = F.when(c(score) >= edge, F.lit(name)) if out is None \
            else out.when(c(score) >= edge, F.lit(name))
    return out.otherwise(F.lit(WEAKEST))


def health_history(df: DataFrame) -> DataFrame:
    """Score of every bar with a full 50-bar average and its later returns in percent."""
    df = health_inputs(df).withColumn("score", health_score())
    df = df.withColumns({f"fwd_{h}d": w.forward("close", h) * 100 for h in (5, 10, 21)})
    return df.where(c("sma_50").isNotNull())


def screener(df: DataFrame, min_bars: int = 30) -> DataFrame:
    """One rounded row per symbol for its latest bar."""
    df = health_inputs(df, history=False).withColumn("score", health_score())
    df = df.withColumn("_r1", w.change("close", 1) * 100)
    df = ind.support_resistance(df).withColumns({
        "volatility": F.coalesce(w.std("_r1", 20, 5) * F.sqrt(F.lit(252.0)), F.lit(0.0)),
        "_n": F.count(F.lit(1)).over(Window.partitionBy("sym"))})
    names = {"close_price": "close", "support": "support", "resistance": "resistance", "rsi": "rsi",
             "sma_20": "sma_20", "sma_50": "sma_50", "return_1w": "ret_1w", "return_1m": "ret_1m",
             "return_period": "ret_long", "vol_ratio": "vol_ratio", "volatility": "volatility"}
    row = F.struct(*[F.bround(src, 2).alias(out) for out, src in names.items()], "score", "_n")
    last = df.groupBy("sym").agg(F.max_by(row, "date").alias("s")).select("sym", "s.*")
    return last.where(c("_n") >= min_bars).drop("_n").withColumn("signal", signal_class())


def breadth(rows: DataFrame) -> DataFrame:
    """Bullish, bearish and neutral counts, mean score and return, top gainer."""
    bull = c("signal").contains("BUY") | c("signal").contains("BULLISH")
    bear = c("signal").contains("BEARISH") | c("signal").contains("CAUTION")
    return rows.agg(
        F.count(F.lit(1)).alias("total"), F.count_if(bull).alias("bullish"),
        F.count_if(bear).alias("bearish"), F.bround(F.avg("score"), 1).alias("avg_score"),
        F.bround(F.avg("return_1m"), 2).alias("avg_1m_return"),
        F.max_by("sym", F.struct("return_1m", "sym")).alias("top_gainer")) \
        .withColumn("neutral", c("total") - c("bullish") - c("bearish"))


def leaders(rows: DataFrame, n: int = 5) -> DataFrame:
    """Best rows by score, then 1-month return, then period return, then symbol."""
    order = [c("score").desc(), c("return_1m").desc(), c("return_period").desc(), c("sym").asc()]
    top = rows.orderBy(*order).limit(n)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(*order)))


# ---- mood -----------------------------------------------------------------------------------
@dataclass(frozen=True)
class MoodWeights:
    """Weights of the seven mood terms in one trend regime."""

    rsi: float
    macd: float
    ema_fast: float
    ema_slow: float
    ret_5: float
    ret_14: float
    vwap: float


def even_weights(base: float, minor: float = 0.67) -> MoodWeights:
    return MoodWeights(base, base * minor, base, base, base, base, base * minor)


# Regimes below and from ADX 20, label thresholds, volume boost.
EVEN = (even_weights(0.10), even_weights(0.15))
LISTED = (MoodWeights(0.10, 0.05, 0.10, 0.10, 0.10, 0.10, 0.05),
          MoodWeights(0.15, 0.10, 0.15, 0.15, 0.10, 0.15, 0.10))
TREND_ADX, VOLUME_CONFIRM, BOOST, MOOD_CUT = 20, 1.2, 1.1, 0.25


def mood_inputs(df: DataFrame) -> DataFrame:
    df = ind.smoothed(df, ["ema_9", "ema_21", "ema_50", "ema_12", "ema_26", "macd_signal",
                           "avg_gain", "avg_loss", "adx_mood"])
    df = ind.vwap(df)
    return df.withColumns({
        "rsi": ind.rsi(), "macd_hist": ind.macd() - c("macd_signal"),
        "ret_5d": F.coalesce(w.change("close", 5), F.lit(0.0)) * 100,
        "ret_14d": F.coalesce(w.change("close", 14), F.lit(0.0)) * 100,
        "vol_ratio": F.coalesce(ratio("volume", w.mean("volume", 20, 5)), F.lit(1.0)),
        "bars": F.row_number().over(w.series())})


def mood_score(regimes: tuple[MoodWeights, MoodWeights] = EVEN) -> Column:
    """-1..1 from RSI, MACD, EMA order, returns and VWAP, weighted by trend strength."""

    def total(m: MoodWeights) -> Column:
        near = lambda x, mid, scale: clip((c(x) - mid) / scale, -1.0, 1.0)
        return (m.rsi * near("rsi", 50, 50) + m.macd * F.signum("macd_hist")
                + m.ema_fast * F.signum(c("ema_9") - c("ema_21"))
                + m.ema_slow * F.signum(c("ema_21") - c("ema_50"))
                + m.ret_5 * near("ret_5d", 0, 3) + m.ret_14 * near("ret_14d", 0, 5)
                + m.vwap * (c("above_vwap") * 2 - 1))

    strong = total(regimes[1])
    boosted = F.when(c("vol_ratio") > VOLUME_CONFIRM, strong * BOOST).otherwise(strong)
    return clip(F.when(c("adx_mood") < TREND_ADX, total(regimes[0])).otherwise(boosted), -1.0, 1.0)


def mood_label(score: str = "score") -> Column:
    return (F.when(c(score) >= MOOD_CUT, F.lit("BULLISH"))
            .when(c(score) <= -MOOD_CUT, F.lit("BEARISH")).otherwise(F.lit("NEUTRAL")))


def mood(df: DataFrame, regimes: tuple[MoodWeights, MoodWeights] = EVEN,
         min_bars: int = 20) -> DataFrame:
    """Mood of every bar; neutral until ``min_bars`` bars exist."""
    df = mood_inputs(df)
    ready = c("bars") >= min_bars
    df = df.withColumn("score", F.round(F.when(ready, mood_score(regimes))
                                        .otherwise(F.lit(0.0)), 9))
    return df.withColumns({
        "label": mood_label(), "adx": F.when(ready, c("adx_mood")).otherwise(F.lit(25.0))})


# ---- decisions ------------------------------------------------------------------------------
# Mood opposition and the confidence thresholds of the gate and of its variant.
OPPOSE = 0.4
GATE = {"agree": 0.50, "weak": 0.48, "override": 0.55, "strong": 0.60}
GATE_VARIANT = {"agree": 0.50, "weak": 0.50, "override": 0.55, "strong": 0.60}


def opposed(mood_: str, dir_: str) -> Column:
    return (((c(mood_) < -OPPOSE) & (c(dir_) == "UP"))
            | ((c(mood_) > OPPOSE) & (c(dir_) == "DOWN")))


def decision_gate(df: DataFrame, limits: dict[str, float] = GATE) -> DataFrame:
    """Combine a forecast (a_ret, a_conf 50..100) and a probability (b_prob) under a mood score.

    Adds dir_a, dir_b, direction, confidence (percent), tradeable and gate.
    """
    df = df.withColumns({"dir_a": direction(c("a_ret")),
                         "dir_b": F.when(c("b_prob") >= 0.5, F.lit("UP")).otherwise(F.lit("DOWN")),
                         "_b": F.greatest(c("b_prob"), 1 - c("b_prob")), "_a": c("a_conf") / 100.0})
    against_a, against_b = opposed("mood", "dir_a"), opposed("mood", "dir_b")
    agree = c("dir_a") == c("dir_b")
    confirmed = agree & ~against_a & (c("_b") >= limits["agree"])
    weak = agree & ~confirmed & (c("_b") >= limits["weak"])
    override = ~agree & (c("_b") >= limits["override"]) & ~against_b & (c("_a") < c("_b"))
    strong = ~agree & ~override & (c("_a") >= limits["strong"]) & (c("_a") > c("_b")) & ~against_a
    follow_b = ~agree & ~strong & (override | (c("_b") > c("_a")))
    return df.withColumns({
        "gate": F.when(confirmed, F.lit("A+B CONFIRMED")).when(weak, F.lit("WEAK CONFIRM"))
        .when(override, F.lit("B OVERRIDE")).when(strong, F.lit("A STRONG"))
        .otherwise(F.lit("NO TRADE")),
        "tradeable": confirmed | weak | override | strong,
        "direction": F.when(follow_b, c("dir_b")).otherwise(c("dir_a")),
        "confidence": F.bround(F.when(confirmed | weak | follow_b, c("_b") * 100)
                               .otherwise(c("a_conf")), 1)}).drop("_a", "_b")


def simple_gate(df: DataFrame, least: float = 0.55) -> DataFrame:
    """Trade only when both directions agree, mood does not oppose and the probability is high."""
    df = df.withColumns({"dir_a": direction(c("a_ret")),
                         "dir_b": F.when(c("b_prob") >= 0.5, F.lit("UP")).otherwise(F.lit("DOWN"))})
    return df.withColumns({
        "direction": c("dir_a"),
        "tradeable": (c("dir_a") == c("dir_b")) & ~opposed("mood", "dir_a")
        & (c("b_prob") >= least)})


def forecast_summary(forecast: DataFrame, per_percent: float = 10.0) -> DataFrame:
    """One row per (sym, origin) from forecast bars (sym, origin, last_close, step, close, ...)."""
    agg = forecast.groupBy("sym", "origin").agg(
        F.max("last_close").alias("last"), F.max_by("close", "step").alias("proj"),
        F.max("high").alias("hi"), F.min("low").alias("lo"), F.stddev_samp("close").alias("sd"))
    ret = ratio(c("proj") - c("last"), "last") * 100
    agg = agg.withColumn("proj_return", ret)
    return agg.select(
        "sym", "origin", "proj_return",
        F.when(c("proj_return") >= 0, F.lit(1.0)).otherwise(F.lit(0.0)).alias("proj_direction"),
        (ratio(c("hi") - c("lo"), "last") * 100).alias("proj_range_pct"),
        (ratio("sd", "last") * 100).alias("proj_std_pct"),
        clip(50.0 + F.abs("proj_return") * per_percent, 50.0, 100.0).alias("confidence"))


def trend_bucket(ret_pct: Column, cut: float = 0.5) -> Column:
    return (F.when(ret_pct >= cut, F.lit("Bullish")).when(ret_pct <= -cut, F.lit("Bearish"))
            .otherwise(F.lit("Neutral")))


def tradeable_only(results: DataFrame, field: str = "prediction") -> DataFrame:
    """Rows whose nested prediction is marked tradeable."""
    return results.where(F.coalesce(F.col(f"{field}.tradeable"), F.lit(False)))


def error_tracker(pred: DataFrame) -> DataFrame:
    """Error of each one-bar forecast and the running hit rate and MAPE per symbol.

    Input columns: sym, date, last_close, pred_close, pred_high, pred_low, close, high, low.
    """
    act = ratio(c("close") - c("last_close"), "last_close") * 100
    word = lambda x: F.when(x >= 0, F.lit("UP")).otherwise(F.lit("DOWN"))
    span = c("high") - c("low")
    miss = span - (c("pred_high") - c("pred_low"))
    df = pred.withColumns({
        "act_ret": act, "act_dir": word(act), "pred_dir": word(c("pred_close") - c("last_close")),
        "mape": ratio(F.abs(c("pred_close") - c("close")), "close") * 100,
        "range_class": F.when(miss > 0.15 * span, F.lit("under"))
        .when(miss < -0.15 * span, F.lit("over")).otherwise(F.lit("ok"))})
    df = df.withColumn("is_hit", c("pred_dir") == c("act_dir"))
    return df.withColumns({
        "running_winrate": F.avg(c("is_hit").cast("double")).over(w.running()) * 100,
        "running_mape": F.avg("mape").over(w.running())})
