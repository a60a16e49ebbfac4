"""Window functions and time-series features (WIN-*, TS-*), without exponential smoothing."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import indicators as ind
from ..functions import windows as w
from ..functions.exprs import c, clip, flag, ratio, rounded, zero_to_null
from .base import W, block, div, fwd, lag, query, r, ret, roll, rows, sql

LAGS = (1, 3, 5, 10, 14, 20, 21, 63, 126)


def bar_sql(cols: str, digits: int = 6, keys: str = "sym, date", src: str = "bars",
            needs: str = "") -> str:
    return sql(needs or src, f"SELECT {keys}, {r(cols, digits)} FROM {src}")


def keep(df, *cols, keys=("sym", "date"), digits=6, **per):
    return rounded(df.select(*keys, *cols), digits, **per)


# ---- WIN ------------------------------------------------------------------------------------
@query("WIN-1_shift", bar_sql(f"prev={lag('close', 1)}; prev_21={lag('close', 21)}; "
                              f"next_10={lag('close', -10)}"))
def _(t):
    return keep(t.bars.withColumns({"prev": w.shift("close", 1), "prev_21": w.shift("close", 21),
                                    "next_10": w.shift("close", -10)}),
                "prev", "prev_21", "next_10")


@query("WIN-2_pct_change_diff", bar_sql(f"chg_1={ret(1)}; chg_5={ret(5)}; "
                                        f"diff_3=close - {lag('close', 3)}"))
def _(t):
    return keep(t.bars.withColumns({"chg_1": w.change("close", 1), "chg_5": w.change("close", 5),
                                    "diff_3": w.diff("close", 3)}), "chg_1", "chg_5", "diff_3")


@query("WIN-3_rolling_aggregates", bar_sql(
    f"avg_20={roll('avg', 'close', 20)}; std_20={roll('stddev_samp', 'close', 20)}; "
    f"sum_5={roll('sum', 'volume', 5, 3)}; min_14={roll('min', 'low', 14, 3)}; "
    f"max_14={roll('max', 'high', 14, 3)}"))
def _(t):
    return keep(t.bars.withColumns({
        "avg_20": w.mean("close", 20), "std_20": w.std("close", 20),
        "sum_5": w.total("volume", 5, 3), "min_14": w.low("low", 14, 3),
        "max_14": w.high("high", 14, 3)}), "avg_20", "std_20", "sum_5", "min_14", "max_14")


block("rets", "bars", f"SELECT *, {ret(1)} AS ret_1, {ret(5)} AS ret_5, {ret(10)} AS ret_10, "
                      f"{ret(20)} AS ret_20 FROM bars")
block("vols", "rets", f"""SELECT *, {roll('stddev_samp', 'ret_1', 5, 3)} AS volatility_5,
  {roll('stddev_samp', 'ret_1', 10, 5)} AS volatility_10,
  {roll('stddev_samp', 'ret_1', 20, 8)} AS volatility_20,
  {roll('stddev_samp', 'ret_1', 60)} AS volatility_60 FROM rets""")


def _vols(t):
    return ind.volatility(ind.returns(t.bars, (1,)))


TICKS = "PARTITION BY event_type ORDER BY ts, event_id"
T20 = f"({TICKS} ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)"


def tick_rows(t):
    return t.table("events").select(c("event_type").alias("sym"), "ts", "event_id", c("value").alias("close"))


@query("WIN-3_rolling_on_ticks", sql("", f"""SELECT event_id, round(CASE WHEN count(value) OVER {T20} >= 20 THEN avg(value) OVER {T20} END, 6) + 0.0 AS avg_20,
  round(max(value) OVER {T20}, 6) + 0.0 AS max_20, round(lead(value, 3) OVER ({TICKS}), 6) + 0.0 AS next_3 FROM events"""))
def _(t):
    """Windows over raw ticks: a series is cut into blocks, so a hot symbol is no hot task."""
    from ..operators.longseries import in_blocks

    def build(df):
        kw = dict(order="_row")
        return df.withColumns({"avg_20": w.mean("close", 20, **kw), "max_20": w.high("close", 20, 1, **kw),
                               "next_3": w.shift("close", -3, **kw)})

    df = in_blocks(tick_rows(t), build, back=19, ahead=3, block_rows=500, order=["ts", "event_id"], unit="day")
    return rounded(df.select("event_id", "avg_20", "max_20", "next_3"))


@query("WIN-7_cumulative_sum_on_ticks", sql("", f"""SELECT event_id, CAST(sum(CAST(round(value * 100) AS BIGINT)) OVER ({TICKS}) AS BIGINT) AS cents FROM events"""))
def _(t):
    from ..operators.longseries import running_total
    df = running_total(tick_rows(t), F.round(c("close") * 100).cast("bigint"), "cents", order=["ts", "event_id"], unit="day")
    return df.select("event_id", "cents")


@query("WIN-4_rolling_median", bar_sql(f"med_60={roll('median', 'volatility_20', 60, 20)}",
                                       src="vols"))
def _(t):
    return keep(_vols(t).withColumn("med_60", w.median("volatility_20", 60, 20)), "med_60")


@query("WIN-5_rolling_slope", sql("bars", f"""
SELECT sym, date, round(CASE WHEN count(volume) OVER {rows(10)} = 10
    THEN regr_slope(volume, rn) OVER {rows(10)} END, 6) + 0.0 AS slope_10
FROM (SELECT *, row_number() OVER ({W}) AS rn FROM bars)"""))
def _(t):
    df = t.bars.withColumn("row", F.row_number().over(w.series()))
    return keep(df.withColumn("slope_10", w.slope("volume", 10)), "slope_10")


@query("WIN-7_cumulative_sum", bar_sql(f"cum_volume=sum(volume) OVER ({W})"))
def _(t):
    return keep(t.bars.withColumn("cum_volume", F.sum("volume").over(w.running())), "cum_volume")


@query("WIN-8_cumulative_product", bar_sql(f"equity=product(1 + coalesce(ret_1, 0)) OVER ({W})",
                                           src="rets"))
def _(t):
    df = ind.returns(t.bars, (1,))
    growth = F.product(1 + F.coalesce(c("ret_1"), F.lit(0.0))).over(w.running())
    return keep(df.withColumn("equity", growth), "equity")


@query("WIN-9_drawdown", bar_sql(f"peak=max(close) OVER ({W}); "
                                 f"drawdown=close / max(close) OVER ({W}) - 1"))
def _(t):
    df = t.bars.withColumn("peak", F.max("close").over(w.running()))
    return keep(df.withColumn("drawdown", ratio("close", "peak") - 1), "peak", "drawdown")


@query("WIN-14_dense_row_numbering", sql("rets", """
SELECT sym, date, CAST(row_number() OVER (PARTITION BY date ORDER BY ret_5 DESC, sym) AS INTEGER)
  AS rank FROM rets WHERE ret_5 IS NOT NULL"""))
def _(t):
    from ..operators.crosssection import ordinal
    df = ind.returns(t.bars, (5,)).where(c("ret_5").isNotNull())
    return ordinal(df, "ret_5", bound=t.bound).select("sym", "date", c("rank").cast("int"))


@query("WIN-15_every_hth_date", sql("bars", """
SELECT date FROM (SELECT DISTINCT date, dense_rank() OVER (ORDER BY date) AS k FROM bars)
WHERE (k - 1) % 10 = 0"""))
def _(t):
    from ..operators.joins import every_hth_date
    return every_hth_date(t.bars, 10)


@query("WIN-16_every_hth_observation", sql("rets", f"""
SELECT sym, date, round(ret_5, 6) + 0.0 AS ret_5
FROM (SELECT *, row_number() OVER ({W}) AS k FROM rets WHERE ret_5 IS NOT NULL)
WHERE (k - 1) % 10 = 0"""))
def _(t):
    df = ind.returns(t.bars, (5,)).where(c("ret_5").isNotNull())
    df = df.withColumn("k", F.row_number().over(w.series())).where((c("k") - 1) % 10 == 0)
    return keep(df, "ret_5")


block("dirs", "bars", f"""SELECT sym, date, rn, CASE WHEN d >= 0 THEN 1 WHEN d < 0 THEN 0 END AS up
FROM (SELECT *, close - {lag('close', 1)} AS d, row_number() OVER ({W}) AS rn FROM bars)""")


@query("WIN-17_direction_streak", sql("dirs", f"""
SELECT sym, date, up, CAST(CASE up WHEN 1 THEN n_up WHEN 0 THEN n - n_up END AS BIGINT) AS matches_5,
  CAST(CASE WHEN up IS NOT NULL THEN rn - coalesce(max(CASE WHEN prev IS DISTINCT FROM up THEN rn END)
    OVER ({W}), 1) + 1 END AS INTEGER) AS run_length
FROM (SELECT *, sum(up) OVER {rows(5)} AS n_up, count(up) OVER {rows(5)} AS n,
        {lag('up', 1)} AS prev FROM dirs)"""))
def _(t):
    from ..operators.streaks import direction_streak
    return direction_streak(t.bars, 5).select("sym", "date", "up", "matches_5", "run_length")


@query("WIN-18_first_valid_baseline", bar_sql(
    f"period_ret=close / first_value(close) OVER ({W}) - 1"))
def _(t):
    base = F.first("close", ignorenulls=True).over(w.running())
    return keep(t.bars.withColumn("period_ret", ratio("close", base) - 1), "period_ret")


block("dev", "rets", """SELECT sym, row_number() OVER (PARTITION BY sym ORDER BY date) AS i,
  ret_1 - avg(ret_1) OVER (PARTITION BY sym) AS d, count(*) OVER (PARTITION BY sym) AS n
  FROM rets WHERE ret_1 IS NOT NULL""")


@query("WIN-19_autocovariance", sql("dev", """
SELECT a.sym, CAST(b.i - a.i AS INTEGER) AS lag, round(sum(b.d * a.d) / max(a.n), 10) + 0.0 AS autocov
FROM dev a JOIN dev b ON a.sym = b.sym AND b.i - a.i BETWEEN 1 AND 5 GROUP BY 1, 2"""))
def _(t):
    from ..operators.stats import autocovariance
    df = ind.returns(t.bars, (1,))
    return rounded(autocovariance(df, "sym", "date", "ret_1", 5), 10)


# ---- TS -------------------------------------------------------------------------------------
@query("TS-1_simple_returns", bar_sql("; ".join(f"ret_{n}={ret(n)}" for n in LAGS)))
def _(t):
    return keep(ind.returns(t.bars, LAGS), *[f"ret_{n}" for n in LAGS])


@query("TS-2_momentum", bar_sql("; ".join(f"momentum_{n}={ret(n)}" for n in (5, 10, 20, 60))))
def _(t):
    return keep(ind.returns(t.bars, (5, 10, 20, 60), prefix="momentum_"),
                *[f"momentum_{n}" for n in (5, 10, 20, 60)])


MOM = div(lag("close", 21), lag("close", 252)) + " - 1"


@query("TS-3_momentum_12_1", bar_sql(
    f"mom_12_1={MOM}; mom_short={div(lag('close', 4), lag('close', 52))} - 1"))
def _(t):
    return keep(t.bars.withColumns({"mom_12_1": ind.skip_momentum(),
                                    "mom_short": ind.skip_momentum("close", 4, 52)}),
                "mom_12_1", "mom_short")


@query("TS-4_reversal", bar_sql(f"rev=-{ret(20)}"))
def _(t):
    return keep(t.bars.withColumn("rev", -w.change("close", 20)), "rev")


@query("TS-5_log_return", bar_sql(f"log_ret=ln({div('close', lag('close', 1))})"))
def _(t):
    return keep(t.bars.withColumn("log_ret", ind.log_return()), "log_ret")


@query("TS-6_rolling_volatility", bar_sql(
    "volatility_5; volatility_10; volatility_20; volatility_60; "
    "annual_20=volatility_20 * sqrt(252)", src="vols"))
def _(t):
    df = _vols(t).withColumn("annual_20", c("volatility_20") * F.sqrt(F.lit(252.0)))
    return keep(df, "volatility_5", "volatility_10", "volatility_20", "volatility_60", "annual_20")


block("lrets", "bars", f"SELECT *, ln({div('close', lag('close', 1))}) AS lr FROM bars")
AHEAD = f"({W} ROWS BETWEEN 1 FOLLOWING AND 10 FOLLOWING)"


@query("TS-7_forward_realised_volatility", bar_sql(
    f"fwd_vol=CASE WHEN count(lr) OVER {AHEAD} = 10 THEN stddev_samp(lr) OVER {AHEAD} END",
    src="lrets"))
def _(t):
    df = t.bars.withColumn("lr", ind.log_return())
    return keep(df.withColumn("fwd_vol", ind.forward_volatility("lr", 10)), "fwd_vol")


@query("TS-8_volatility_regime", bar_sql(
    f"vol_regime=coalesce({div('volatility_20', roll('median', 'volatility_20', 60, 20))}, 1)",
    src="vols"))
def _(t):
    return keep(ind.volatility_regime(_vols(t)), "vol_regime")


@query("TS-9_high_volatility_flag", bar_sql(
    f"high_volatility=coalesce(CAST(volatility_20 > {roll('avg', 'volatility_20', 30, 5)}"
    " AS INTEGER), 0)::DOUBLE", src="vols"))
def _(t):
    return keep(ind.high_volatility(_vols(t)), "high_volatility")


@query("TS-10_sma_distance", bar_sql(
    "; ".join(f"dist_sma{n}={div('close', roll('avg', 'close', n))} - 1" for n in (20, 50, 200))
    + f"; dist_sma20_any={div('close', roll('avg', 'close', 20, 1))} - 1"))
def _(t):
    df = t.bars.withColumns({f"dist_sma{n}": ind.sma_distance(n) for n in (20, 50, 200)})
    return keep(df.withColumn("dist_sma20_any", ind.sma_distance(20, 1)),
                "dist_sma20", "dist_sma50", "dist_sma200", "dist_sma20_any")


TR = (f"greatest(high - low, abs(high - {lag('close', 1)}), abs(low - {lag('close', 1)}))")
block("trs", "bars", f"SELECT *, {TR} AS tr FROM bars")
block("atrs", "trs", f"SELECT *, {roll('avg', 'tr', 14, 3)} AS atr FROM trs")


@query("TS-16_true_range", bar_sql("tr", src="trs"))
def _(t):
    return keep(t.bars.withColumn("tr", ind.true_range()), "tr")


@query("TS-18_atr_family", sql("atrs", f"""
SELECT sym, date, {r('atr', 4)}, {r(f"atr_pct; atr_regime; atr_slope_5=atr_pct - {lag('atr_pct', 5)}")}
FROM (SELECT *, coalesce({div('atr', 'close')}, 0) AS atr_pct,
        coalesce({div('atr', roll('avg', 'atr', 30, 5))}, 1) AS atr_regime FROM atrs)"""))
def _(t):
    return keep(ind.atr_family(t.bars), "atr", "atr_pct", "atr_regime", "atr_slope_5", atr=4)


block("rngs", "bars", "SELECT *, (high - low) / nullif(close, 0) AS range_pct FROM bars")


@query("TS-19_range_family", bar_sql(
    f"range_pct; range_10={roll('avg', 'range_pct', 10, 3)}; "
    f"range_ratio_10={div('range_pct', roll('avg', 'range_pct', 10, 3))}", src="rngs"))
def _(t):
    return keep(ind.range_family(t.bars), "range_pct", "range_10", "range_ratio_10")


block("bbs", "bars", f"""SELECT *, coalesce({roll('stddev_samp', 'close', 20, 1)}, 1.0) AS sg,
  {roll('avg', 'close', 20, 1)} AS mid FROM bars""")
block("bbw", "bbs", """SELECT *, (mid + 2 * sg - close) / close AS dist_bb_upper,
  (close - (mid - 2 * sg)) / close AS dist_bb_lower,
  ((mid + 2 * sg) - (mid - 2 * sg)) / nullif(mid, 0) AS bb_width FROM bbs""")


@query("TS-21_bollinger", bar_sql(
    "dist_bb_upper; dist_bb_lower; bb_width; "
    f"bb_squeeze=coalesce({div('bb_width', roll('avg', 'bb_width', 20))}, 1)", src="bbw"))
def _(t):
    return keep(ind.bollinger(t.bars), "dist_bb_upper", "dist_bb_lower", "bb_width", "bb_squeeze")


block("hl14", "bars", f"""SELECT *, {roll('min', 'low', 14, 3)} AS lo,
  {roll('max', 'high', 14, 3)} AS hi FROM bars""")
block("stoch", "hl14", f"""SELECT *, coalesce(100 * {div('close - lo', 'hi - lo')}, 50) AS stoch_k,
  coalesce(-100 * {div('hi - close', 'hi - lo')}, -50) AS williams_r FROM hl14""")


@query("TS-22_stochastic", bar_sql(f"stoch_k; stoch_d=coalesce({roll('avg', 'stoch_k', 3)}, 50)",
                                   src="stoch"))
def _(t):
    return keep(ind.stochastic(t.bars), "stoch_k", "stoch_d")


@query("TS-23_williams_r", bar_sql("williams_r", src="stoch"))
def _(t):
    return keep(ind.stochastic(t.bars), "williams_r")


VR = div("volume", roll("avg", "volume", 20))


@query("TS-24_volume_ratio", bar_sql(
    f"volume_ratio=least({VR}, CASE WHEN {VR} IS NOT NULL THEN 10 END); "
    f"vol_ratio_any=coalesce({div('volume', roll('avg', 'volume', 20, 1))}, 1)"))
def _(t):
    df = t.bars.withColumns({
        "volume_ratio": clip(ind.volume_ratio(), upper=10.0),
        "vol_ratio_any": F.coalesce(ind.volume_ratio(20, 1), F.lit(1.0))})
    return keep(df, "volume_ratio", "vol_ratio_any")


@query("TS-25_volume_change", sql("bars", f"""
SELECT sym, date, {r("volume_change_1=v / nullif(" + lag('v', 1) + ", 0) - 1")}
FROM (SELECT *, last_value(nullif(volume, 0) IGNORE NULLS) OVER ({W}) AS v FROM bars)"""))
def _(t):
    return keep(ind.volume_change(t.bars), "volume_change_1")


@query("TS-26_volume_trend", sql("bars", f"""
SELECT sym, date, round(CASE WHEN count(v) OVER {rows(10)} = 10 THEN regr_slope(v, rn)
  OVER {rows(10)} END, 6) + 0.0 AS volume_trend_10
FROM (SELECT *, nullif(volume, 0) AS v, row_number() OVER ({W}) AS rn FROM bars)"""))
def _(t):
    return keep(ind.volume_trend(t.bars), "volume_trend_10")


block("vc", "bars", "SELECT *, volume * close AS vc FROM bars")


@query("TS-27_dollar_volume_liquidity", bar_sql(f"liq={roll('avg', 'vc', 20)}", src="vc"))
def _(t):
    return keep(t.bars.withColumn("liq", w.mean(c("volume") * c("close"), 20)), "liq")


block("sv", "bars", f"SELECT *, sign(close - {lag('close', 1)}) * coalesce(nullif(volume, 0), 0) "
                    "AS sv FROM bars")
block("obvs", "sv", f"SELECT *, CASE WHEN sv IS NOT NULL THEN sum(sv) OVER ({W}) END AS obv FROM sv")


@query("TS-28_on_balance_volume", bar_sql(
    f"obv; obv_slope_5={div('obv - ' + lag('obv', 5), roll('avg', 'nullif(volume, 0)', 5, 1))}",
    src="obvs"))
def _(t):
    return keep(ind.on_balance(t.bars), "obv", "obv_slope_5")


block("mf", "bars", """SELECT *, nullif(volume, 0) AS v, ((close - low) - (high - close))
  / nullif(high - low, 0) * coalesce(nullif(volume, 0), 0) AS mf FROM bars""")


@query("TS-29_chaikin_money_flow", bar_sql(
    f"cmf_20={div(roll('sum', 'mf', 20, 5), roll('sum', 'v', 20, 5))}", src="mf"))
def _(t):
    return keep(ind.money_flow(t.bars), "cmf_20")


block("tp", "bars", """SELECT *, CASE WHEN volume = 0 THEN 1 ELSE volume END AS v,
  (high + low + close) / 3 * (CASE WHEN volume = 0 THEN 1 ELSE volume END) AS pv FROM bars""")
block("vw", "tp", f"""SELECT *, {roll('sum', 'pv', 14, 1)} / {roll('sum', 'v', 14, 1)} AS vwap_14,
  sum(pv) OVER ({W}) / sum(v) OVER ({W}) AS vwap_all FROM tp""")


@query("TS-30_vwap", bar_sql("vwap_14; vwap_all; above_vwap=CAST(close > vwap_14 AS INTEGER)"
                             "::DOUBLE", 4, src="vw"))
def _(t):
    return keep(ind.vwap(t.bars), "vwap_14", "vwap_all", "above_vwap", digits=4)


block("cnd", "bars", """SELECT *, abs(close - open) / nullif(high - low, 0) AS body_pct,
  (high - greatest(close, open)) / nullif(high - low, 0) AS upper_wick,
  (least(close, open) - low) / nullif(high - low, 0) AS lower_wick,
  (close - low) / nullif(high - low, 0) AS close_location FROM bars""")


def flag_sql(cond: str) -> str:
    return f"coalesce(CAST({cond} AS INTEGER), 0)::DOUBLE"


@query("TS-31_candle_geometry", bar_sql(
    f"body_pct; upper_wick; lower_wick; close_location; doji={flag_sql('body_pct < 0.1')}; "
    f"hammer={flag_sql('lower_wick > 0.6 AND upper_wick < 0.2')}; "
    f"shooting_star={flag_sql('upper_wick > 0.6 AND lower_wick < 0.2')}", src="cnd"))
def _(t):
    return keep(ind.candles(t.bars), "body_pct", "upper_wick", "lower_wick", "close_location",
                "doji", "hammer", "shooting_star")


@query("TS-32_gap_opening_range", bar_sql(
    f"gap_up=coalesce({div('open', lag('close', 1))} - 1, 0); "
    f"opening_range={div('high - low', 'open')}"))
def _(t):
    return keep(ind.gaps(t.bars), "gap_up", "opening_range")


block("piv", "bars", f"""SELECT *, ({lag('high', 1)} + {lag('low', 1)} + {lag('close', 1)}) / 3 AS pv,
  {lag('high', 1)} - {lag('low', 1)} AS pr FROM bars""")


@query("TS-33_fibonacci_pivots", bar_sql(
    "dist_fib_r1=(pv + 0.382::DOUBLE * pr - close) / close; "
    "dist_fib_s1=(close - (pv - 0.382::DOUBLE * pr)) / close", src="piv"))
def _(t):
    return keep(ind.fibonacci(t.bars), "dist_fib_r1", "dist_fib_s1")


@query("TS-34_seasonality", sql("bars", """SELECT sym, date,
  CAST(isodow(date) - 1 AS INTEGER) AS day_of_week, CAST(month(date) AS INTEGER) AS month,
  CAST(quarter(date) AS INTEGER) AS quarter, CAST(weekofyear(date) AS INTEGER) AS week_of_year
FROM bars"""))
def _(t):
    return keep(ind.seasonality(t.bars), "day_of_week", "month", "quarter", "week_of_year")


@query("TS-35_risk_columns", bar_sql(
    f"stop_loss_pct=coalesce({div('atr', 'close')}, 0) * 2; "
    f"risk_reward_ratio=0.02::DOUBLE / nullif(coalesce({div('atr', 'close')}, 0) * 2, 0)",
    src="atrs"))
def _(t):
    return keep(ind.risk_levels(ind.atr_family(t.bars)), "stop_loss_pct", "risk_reward_ratio")


block("bfeat", "bench", """SELECT date, bench, bench / nullif(lag(bench, 1) OVER (ORDER BY date), 0) - 1
    AS bench_ret_1, bench / nullif(lag(bench, 20) OVER (ORDER BY date), 0) - 1 AS bench_ret_20,
  lead(bench, 10) OVER (ORDER BY date) / nullif(bench, 0) - 1 AS bench_fwd FROM bench""")


@query("TS-36_benchmark_features", sql("rets bfeat", f"""
SELECT sym, date, {r('bench_ret_1; bench_ret_20; bench_vol; rel_ret_20=ret_20 - bench_ret_20')}
FROM rets LEFT JOIN (SELECT *, CASE WHEN count(bench_ret_1) OVER w >= 10
    THEN stddev_samp(bench_ret_1) OVER w END AS bench_vol FROM bfeat
  WINDOW w AS (ORDER BY date ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)) USING (date)"""))
def _(t):
    from ..operators.joins import benchmark_features
    df = benchmark_features(ind.returns(t.bars, (20,)), t.bench)
    return keep(df, "bench_ret_1", "bench_ret_20", "bench_vol", "rel_ret_20")


@query("TS-37_delivery_factors", bar_sql(
    f"deliv_chg20=deliv_pct - {roll('avg', 'deliv_pct', 20, 5)}; deliv_x_ret=deliv_pct * {ret(20)}"))
def _(t):
    return keep(ind.delivery(t.bars), "deliv_chg20", "deliv_x_ret")


@query("TS-38_delivery_full_window", bar_sql(
    f"deliv_chg20=deliv_pct - {roll('avg', 'deliv_pct', 20)}"))
def _(t):
    return keep(ind.delivery(t.bars, min_obs=None), "deliv_chg20")


@query("TS-39_mean_daily_range", bar_sql(f"range20={roll('avg', 'range_pct', 20)}", src="rngs"))
def _(t):
    df = t.bars.withColumn("range20", w.mean(ratio(c("high") - c("low"), "close"), 20))
    return keep(df, "range20")


@query("TS-40_support_resistance", bar_sql(
    f"support={roll('min', 'low', 20, 1)}; resistance={roll('max', 'high', 20, 1)}"))
def _(t):
    return keep(ind.support_resistance(t.bars), "support", "resistance")


block("tgt", "bars", f"""SELECT *, coalesce(CAST({fwd(5)} > 0.02::DOUBLE AS INTEGER), 0) AS target,
  {fwd(5)} AS future_ret FROM bars""")


@query("TS-41_target_lags", sql("tgt", f"""
SELECT sym, date, target, lag(target, 1) OVER ({W}) AS target_lag_1,
  lag(target, 2) OVER ({W}) AS target_lag_2, lag(target, 5) OVER ({W}) AS target_known_5
FROM tgt QUALIFY future_ret IS NOT NULL"""))
def _(t):
    from ..operators.labels import target_lags
    return target_lags(t.bars, horizon=5, move=0.02).select(
        "sym", "date", "target", "target_lag_1", "target_lag_2", "target_known_5")


block("one_series", "bench", f"""SELECT 'MARKET' AS sym, date, bench AS close FROM bench""")


@query("TS-42_macro_snapshot", sql("bars", f"""
SELECT sym, {r('latest_close', 4)}, {r('ret14d; ret5d; vol20')} FROM (
  SELECT sym, date, close AS latest_close, row_number() OVER (PARTITION BY sym ORDER BY date DESC) AS k,
    coalesce((close / nullif({lag('close', 13)}, 0) - 1) * 100, 0) AS ret14d,
    coalesce((close / nullif({lag('close', 4)}, 0) - 1) * 100, 0) AS ret5d,
    CASE WHEN row_number() OVER ({W}) >= 20
      THEN coalesce({roll('stddev_samp', 'r1', 20, 5)} * 100, 0) ELSE 0 END AS vol20
  FROM (SELECT *, {ret(1)} AS r1 FROM bars)) WHERE k = 1"""))
def _(t):
    from ..operators.macro import macro_snapshot
    return rounded(macro_snapshot(t.bars), latest_close=4)


@query("TS-43_flow_proxies", sql("bars bench", f"""
SELECT sym, date, {r('fii_flow_proxy; dii_flow_proxy')},
  {r('fii_dii_sentiment=greatest(-1, least(1, (fii_flow_proxy * 0.6::DOUBLE + dii_flow_proxy * 0.4::DOUBLE) / 2.0))')}
FROM (SELECT sym, date,
    coalesce((bench / nullif({lag('bench', 9)}, 0) - 1) * 100, 0) AS fii_flow_proxy,
    coalesce((rt / nullif({lag('rt', 9)}, 0) - 1) * 100, 0) AS dii_flow_proxy
  FROM (SELECT sym, date, bench, close / nullif(bench, 0) AS rt FROM bars JOIN bench USING (date)))"""))
def _(t):
    from ..operators.macro import flow_proxies
    return rounded(flow_proxies(t.bars, t.bench))


@query("TS-44_interaction_features", sql("rets bench", f"""
SELECT sym, date, {r('vix_regime=greatest(-1, least(1, (vix - 12) / 15)) * sign(ret_20); '
 'trend=greatest(-1, least(1, m14 / 5)) * sign(ret_10); '
 'fx_mom=greatest(-1, least(1, (fx - 83) / 2)) * sign(ret_5); mood_align=mood * sign(ret_10); '
 'mood_vol_align=mood * range_pct')}
FROM (SELECT *, (high - low) / nullif(close, 0) AS range_pct FROM rets),
  (SELECT max_by(bench, date) / 100.0 AS vix, max_by(m, date) AS m14, max_by(bench, date) / 20.0 AS fx,
     greatest(-1, least(1, max_by(m, date) / 10)) AS mood
   FROM (SELECT date, bench, (bench / nullif(lag(bench, 13) OVER (ORDER BY date), 0) - 1) * 100 AS m
         FROM bench))"""))
def _(t):
    from ..operators.macro import interactions, market_state
    df = ind.returns(t.bars, (5, 10, 20)).withColumn(
        "range_pct", ratio(c("high") - c("low"), "close"))
    return rounded(interactions(df, market_state(t.bench)))
