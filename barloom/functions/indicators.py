"""Technical indicators as column builders over one bar series per symbol.

Plain indicators are built from window expressions only.  The exponentially smoothed ones list the
means they need (``_steps``) and combine them with ordinary expressions afterwards.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.ewm import Derived, Ewm, ewm, span, wilder
from . import windows as w
from .exprs import c, clip, flag, ratio, zero_to_null

TRADING_DAYS = 252


# ---- returns -------------------------------------------------------------------------------
def returns(df: DataFrame, lags: Sequence[int], prefix: str = "ret_", x: str = "close",
            scale: float = 1.0) -> DataFrame:
    return df.withColumns({f"{prefix}{n}": w.change(x, n) * scale for n in lags})


def skip_momentum(x: str = "close", skip: int = 21, back: int = 252) -> Column:
    """Return from ``back`` rows ago to ``skip`` rows ago."""
    return ratio(w.shift(x, skip), w.shift(x, back)) - 1


def log_return(x: str = "close") -> Column:
    return F.ln(ratio(x, w.shift(x, 1)))


# ---- volatility ----------------------------------------------------------------------------
VOL_MIN_OBS = {5: 3, 10: 5, 20: 8, 60: 60}


def volatility(df: DataFrame, x: str = "ret_1", min_obs: dict[int, int] = VOL_MIN_OBS,
               prefix: str = "volatility_") -> DataFrame:
    return df.withColumns({f"{prefix}{n}": w.std(x, n, mp) for n, mp in min_obs.items()})


def forward_volatility(x: str, n: int) -> Column:
    ahead = w.series().rowsBetween(1, n)
    return F.when(F.count(c(x)).over(ahead) == n, F.stddev_samp(c(x)).over(ahead))


def volatility_regime(df: DataFrame, x: str = "volatility_20") -> DataFrame:
    return df.withColumn("vol_regime", F.coalesce(ratio(x, w.median(x, 60, 20)), F.lit(1.0)))


def high_volatility(df: DataFrame, x: str = "volatility_20") -> DataFrame:
    return df.withColumn("high_volatility", flag(c(x) > w.mean(x, 30, 5)).cast("double"))


# ---- averages, ranges ----------------------------------------------------------------------
def sma_distance(n: int, min_obs: int | None = None, x: str = "close") -> Column:
    return ratio(x, w.mean(x, n, min_obs)) - 1


def true_range() -> Column:
    prev = w.shift("close", 1)
    return F.greatest(c("high") - c("low"), F.abs(c("high") - prev), F.abs(c("low") - prev))


def atr_family(df: DataFrame) -> DataFrame:
    """True range, its 14-row mean, the share of the close, slope and regime."""
    df = df.withColumn("tr", true_range())
    df = df.withColumn("atr", w.mean("tr", 14, 3))
    df = df.withColumns({"atr_pct": F.coalesce(ratio("atr", "close"), F.lit(0.0)),
                         "atr_regime": F.coalesce(ratio("atr", w.mean("atr", 30, 5)),
                                                  F.lit(1.0))})
    return df.withColumn("atr_slope_5", w.diff("atr_pct", 5))


def range_family(df: DataFrame) -> DataFrame:
    df = df.withColumn("range_pct", ratio(c("high") - c("low"), "close"))
    df = df.withColumn("range_10", w.mean("range_pct", 10, 3))
    return df.withColumn("range_ratio_10", ratio("range_pct", "range_10"))


def bollinger(df: DataFrame) -> DataFrame:
    sigma = F.coalesce(w.std("close", 20, 1), F.lit(1.0))
    df = df.withColumns({"bb_mid": w.mean("close", 20, 1), "bb_sigma": sigma})
    up, down = c("bb_mid") + 2 * c("bb_sigma"), c("bb_mid") - 2 * c("bb_sigma")
    df = df.withColumns({"dist_bb_upper": ratio(up - c("close"), "close"),
                         "dist_bb_lower": ratio(c("close") - down, "close"),
                         "bb_width": ratio(up - down, "bb_mid")})
    return df.withColumn("bb_squeeze",
                         F.coalesce(ratio("bb_width", w.mean("bb_width", 20)), F.lit(1.0)))


def stochastic(df: DataFrame) -> DataFrame:
    """%K, %D and Williams %R over 14 rows."""
    lo, hi = w.low("low", 14, 3), w.high("high", 14, 3)
    df = df.withColumns({
        "stoch_k": F.coalesce(100 * ratio(c("close") - lo, hi - lo), F.lit(50.0)),
        "williams_r": F.coalesce(-100 * ratio(hi - c("close"), hi - lo), F.lit(-50.0))})
    return df.withColumn("stoch_d", F.coalesce(w.mean("stoch_k", 3), F.lit(50.0)))


# ---- volume --------------------------------------------------------------------------------
def traded(df: DataFrame) -> DataFrame:
    """Volume with zero as missing."""
    return df.withColumn("vol", zero_to_null("volume"))


def volume_ratio(n: int = 20, min_obs: int | None = None, x: str = "volume") -> Column:
    return ratio(x, w.mean(x, n, min_obs))


def volume_change(df: DataFrame) -> DataFrame:
    """Relative change of the last known volume (gaps are filled before dividing)."""
    df = df.withColumn("vol_known", w.filled(zero_to_null("volume")))
    return df.withColumn("volume_change_1", w.change("vol_known", 1))


def volume_trend(df: DataFrame, n: int = 10) -> DataFrame:
    from pyspark.sql.functions import row_number
    df = df.withColumn("row", row_number().over(w.series()))
    return df.withColumn(f"volume_trend_{n}", w.slope(zero_to_null("volume"), n))


def on_balance(df: DataFrame) -> DataFrame:
    v = F.coalesce(zero_to_null("volume"), F.lit(0.0))
    df = df.withColumn("signed_volume", F.signum(w.diff("close", 1)) * v)
    df = df.withColumn("obv", F.when(F.col("signed_volume").isNotNull(),
                                     F.sum("signed_volume").over(w.running())))
    return df.withColumn("obv_slope_5",
                         ratio(w.diff("obv", 5), w.mean(zero_to_null("volume"), 5, 1)))


def money_flow(df: DataFrame) -> DataFrame:
    v = zero_to_null("volume")
    span_ = c("high") - c("low")
    flow = ratio((c("close") - c("low")) - (c("high") - c("close")), span_) \
        * F.coalesce(v, F.lit(0.0))
    df = df.withColumn("money_flow", flow)
    return df.withColumn("cmf_20", ratio(w.total("money_flow", 20, 5), w.total(v, 20, 5)))


def vwap(df: DataFrame, n: int = 14) -> DataFrame:
    """Rolling and cumulative volume-weighted typical price."""
    v = F.when(c("volume") == 0, F.lit(1.0)).otherwise(c("volume"))
    typical = (c("high") + c("low") + c("close")) / 3
    df = df.withColumns({"vw_price": typical * v, "vw_volume": v})
    df = df.withColumns({
        f"vwap_{n}": w.total("vw_price", n, 1) / w.total("vw_volume", n, 1),
        "vwap_all": F.sum("vw_price").over(w.running()) / F.sum("vw_volume").over(w.running())})
    return df.withColumn("above_vwap", flag(c("close") > c(f"vwap_{n}")).cast("double"))


# ---- candles, gaps, pivots, calendar -------------------------------------------------------
def candles(df: DataFrame) -> DataFrame:
    span_ = zero_to_null(c("high") - c("low"))
    body = F.abs(c("close") - c("open"))
    df = df.withColumns({
        "body_pct": body / span_,
        "upper_wick": (c("high") - F.greatest("close", "open")) / span_,
        "lower_wick": (F.least("close", "open") - c("low")) / span_,
        "close_location": (c("close") - c("low")) / span_})
    return df.withColumns({
        "doji": flag(c("body_pct") < 0.1).cast("double"),
        "hammer": flag((c("lower_wick") > 0.6) & (c("upper_wick") < 0.2)).cast("double"),
        "shooting_star": flag((c("upper_wick") > 0.6) & (c("lower_wick") < 0.2)).cast("double")})


def gaps(df: DataFrame) -> DataFrame:
    return df.withColumns({
        "gap_up": F.coalesce(ratio("open", w.shift("close", 1)) - 1, F.lit(0.0)),
        "opening_range": ratio(c("high") - c("low"), "open")})


FIBONACCI = 0.382


def fibonacci(df: DataFrame) -> DataFrame:
    h, lo, cl = w.shift("high", 1), w.shift("low", 1), w.shift("close", 1)
    df = df.withColumns({"pivot": (h + lo + cl) / 3, "prev_range": h - lo})
    reach = FIBONACCI * c("prev_range")
    return df.withColumns({"dist_fib_r1": ratio(c("pivot") + reach - c("close"), "close"),
                           "dist_fib_s1": ratio(c("close") - (c("pivot") - reach), "close")})


def seasonality(df: DataFrame, date: str = "date") -> DataFrame:
    return df.withColumns({"day_of_week": F.weekday(date), "month": F.month(date),
                           "quarter": F.quarter(date), "week_of_year": F.weekofyear(date)})


def risk_levels(df: DataFrame, move: float = 0.02) -> DataFrame:
    return df.withColumns({"stop_loss_pct": c("atr_pct") * 2.0,
                           "risk_reward_ratio": ratio(F.lit(move), c("atr_pct") * 2.0)})


def support_resistance(df: DataFrame, n: int = 20) -> DataFrame:
    return df.withColumns({"support": w.low("low", n, 1), "resistance": w.high("high", n, 1)})


def delivery(df: DataFrame, min_obs: int | None = 5) -> DataFrame:
    return df.withColumns({"deliv_chg20": c("deliv_pct") - w.mean("deliv_pct", 20, min_obs),
                           "deliv_x_ret": c("deliv_pct") * w.change("close", 20)})


# ---- exponentially smoothed ----------------------------------------------------------------
def smoothing_inputs(df: DataFrame) -> DataFrame:
    """Price moves, true range and directional moves that get smoothed."""
    step = w.diff("close", 1)
    up = F.greatest(w.diff("high", 1), F.lit(0.0))
    down = F.greatest(-w.diff("low", 1), F.lit(0.0))
    known = w.shift("close", 1).isNotNull()
    df = df.withColumns({
        "gain_in": clip(step, lower=0.0), "loss_in": clip(-step, lower=0.0),
        "tr": true_range(),
        "plus_in": F.when(known & (up > down), up).otherwise(F.lit(0.0)),
        "minus_in": F.when(known & (down > up), down).otherwise(F.lit(0.0))})
    return df.withColumn("atr", w.mean("tr", 14, 3))


def _directional_index(plus: str, minus: str, base: str) -> Column:
    p, m = 100 * ratio(plus, base), 100 * ratio(minus, base)
    return F.coalesce(100 * F.abs(p - m) / F.nullif(p + m, F.lit(0.0)), F.lit(0.0))


EMA_SPANS = (5, 9, 10, 12, 20, 21, 26, 50, 100, 200)
def _steps() -> tuple[Ewm | Derived, ...]:
    return (
        *(span(f"ema_{n}", "close", n) for n in EMA_SPANS),
        wilder("avg_gain", "gain_in"), wilder("avg_loss", "loss_in"),
        span("atr_ewm", "tr", 14), span("plus_ewm", "plus_in", 14), span("minus_ewm", "minus_in", 14),
        Derived("macd_line", macd()), span("macd_signal", "macd_line", 9),
        Derived("dx", _directional_index("plus_ewm", "minus_ewm", "atr")),
        Derived("dx_ewm", _directional_index("plus_ewm", "minus_ewm", "atr_ewm")),
        span("adx_14", "dx", 14), span("adx_mood", "dx_ewm", 14),
    )


def smoothed(df: DataFrame, needed: Sequence[str] | None = None,
             block_rows: int | None = None) -> DataFrame:
    """Append exponential means; only the ``needed`` ones (and what they build on)."""
    if needed is None:
        steps = _steps()
    else:
        builds_on = {"macd_signal": {"ema_12", "ema_26", "macd_line"},
                     "adx_14": {"plus_ewm", "minus_ewm", "dx"},
                     "adx_mood": {"plus_ewm", "minus_ewm", "atr_ewm", "dx_ewm"}}
        keep = set(needed)
        for name in needed:
            keep |= builds_on.get(name, set())
        steps = tuple(s for s in _steps() if s.out in keep)
    return ewm(smoothing_inputs(df), steps, drop=["macd_line"], block_rows=block_rows)


def rsi() -> Column:
    """0..100, 50 while undecided or without any loss."""
    strength = ratio("avg_gain", "avg_loss")
    return F.coalesce(100 - 100 / (1 + strength), F.lit(50.0))


def macd() -> Column:
    return c("ema_12") - c("ema_26")


def directional(base: str = "atr") -> tuple[Column, Column]:
    """+DI and -DI."""
    return 100 * ratio("plus_ewm", base), 100 * ratio("minus_ewm", base)


def ema_gaps(df: DataFrame) -> DataFrame:
    pairs = ((5, 10), (10, 20), (20, 50), (50, 200))
    df = df.withColumns({f"ema_gap_{a}_{b}": ratio(f"ema_{a}", f"ema_{b}") - 1 for a, b in pairs})
    df = df.withColumns({f"close_vs_ema{n}": ratio("close", f"ema_{n}") - 1 for n in (10, 20, 50)})
    aligned = (c("ema_20") > c("ema_50")) & (c("ema_50") > c("ema_200"))
    return df.withColumn("bullish_ema_alignment", flag(aligned).cast("double"))
