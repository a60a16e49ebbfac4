"""Scores, gates and trackers (SC-*, AGG-18, TOP-4)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import indicators as ind
from ..functions import windows as w
from ..functions.exprs import c, clip, ratio, rounded
from ..operators import crosssection as xs
from ..operators import scoring
from .base import block, div, fwd, lag, prank, query, r, ret, roll, rows, sql
from .timeseries import keep


def health_sql(mp20, mp50, long: str) -> str:
    return f"""SELECT *, round_even(greatest(5, least(100,
    CASE WHEN close > sma_20 THEN 12 ELSE 0 END + CASE WHEN sma_20 > sma_50 THEN 13 ELSE 0 END + CASE WHEN close > e20 THEN 10 ELSE 0 END
    + CASE WHEN rsi >= 50 AND rsi <= 68 THEN 20 WHEN rsi > 68 AND rsi <= 75 THEN 15 WHEN rsi >= 40 AND rsi < 50 THEN 10 WHEN rsi < 30 THEN 12 ELSE 5 END
    + CASE WHEN macd > sig THEN 5 ELSE 0 END
    + CASE WHEN ret_1m > 10 THEN 15 WHEN ret_1m > 5 THEN 12 WHEN ret_1m > 0 THEN 8 ELSE greatest(0::DOUBLE, 8 + ret_1m * 0.5::DOUBLE) END
    + CASE WHEN ret_long > 15 THEN 10 WHEN ret_long > 5 THEN 7 WHEN ret_long > 0 THEN 4 ELSE 0 END
    + CASE WHEN vol_ratio >= 1.5 AND close > prev THEN 15 WHEN vol_ratio >= 1 THEN 10 ELSE 5 END)), 1) AS score
  FROM (SELECT *, e12 - e26 AS macd, {roll('avg', 'close', 20, mp20)} AS sma_20, {roll('avg', 'close', 50, mp50)} AS sma_50,
    coalesce({ret(5)} * 100, 0) AS ret_1w, coalesce({ret(21)} * 100, 0) AS ret_1m, coalesce({long}, 0) AS ret_long,
    coalesce({div('volume', roll('avg', 'volume', 20, 1))}, 1) AS vol_ratio, {ret(1)} * 100 AS r1,
    {fwd(5)} * 100 AS fwd_5d, {fwd(10)} * 100 AS fwd_10d, {fwd(21)} * 100 AS fwd_21d FROM sm)"""


block("health", "sm", health_sql(None, None, ret(63) + " * 100"))
block("healthl", "sm", health_sql(1, 1, "(close / first_value(close) OVER (PARTITION BY sym ORDER BY date) - 1) * 100"))


@query("SC-1_health_score_history", sql("health", f"SELECT sym, date, {r('score; fwd_5d; fwd_10d; fwd_21d')} FROM health WHERE sma_50 IS NOT NULL"))
def _(t):
    return keep(scoring.health_history(t.bars), "score", "fwd_5d", "fwd_10d", "fwd_21d")


@query("SC-2_health_score_latest_form", sql("healthl", f"SELECT sym, date, {r('score')} FROM healthl"))
def _(t):
    df = scoring.health_inputs(t.bars, history=False).withColumn("score", scoring.health_score())
    return keep(df, "score")


CLASS = """CASE WHEN score >= 80 THEN 'STRONG BUY (Top Performer)' WHEN score >= 65 THEN 'BULLISH (Uptrend Momentum)'
  WHEN score >= 50 THEN 'NEUTRAL / ACCUMULATE' WHEN score >= 35 THEN 'CAUTION / CONSOLIDATION' ELSE 'BEARISH (Downtrend / Exit)' END"""


@query("SC-3_signal_class", sql("healthl", f"SELECT sym, date, {CLASS} AS signal FROM healthl"))
def _(t):
    df = scoring.health_inputs(t.bars, history=False).withColumn("score", scoring.health_score())
    return df.select("sym", "date", scoring.signal_class().alias("signal"))


ROUND2 = {"close_price": "close", "support": "support", "resistance": "resistance", "rsi": "rsi", "sma_20": "sma_20",
          "sma_50": "sma_50", "return_1w": "ret_1w", "return_1m": "ret_1m", "return_period": "ret_long",
          "vol_ratio": "vol_ratio", "volatility": "volatility"}
block("screen", "healthl", f"""SELECT sym, {', '.join(f'round_even({v}, 2) AS {k}' for k, v in ROUND2.items())}, score, {CLASS} AS signal
FROM (SELECT *, {roll('min', 'low', 20, 1)} AS support, {roll('max', 'high', 20, 1)} AS resistance,
    coalesce({roll('stddev_samp', 'r1', 20, 5)} * sqrt(252), 0) AS volatility, count(*) OVER (PARTITION BY sym) AS n FROM healthl)
WHERE n >= 30 QUALIFY row_number() OVER (PARTITION BY sym ORDER BY date DESC) = 1""")


@query("SC-4_screener_rows", sql("screen", "SELECT * FROM screen"))
def _(t):
    return scoring.screener(t.bars)


@query("AGG-18_breadth", sql("screen", """SELECT count(*) AS total, count(*) FILTER (signal LIKE '%BUY%' OR signal LIKE '%BULLISH%') AS bullish,
  count(*) FILTER (signal LIKE '%BEARISH%' OR signal LIKE '%CAUTION%') AS bearish, round_even(avg(score), 1) AS avg_score,
  round_even(avg(return_1m), 2) AS avg_1m_return, arg_max(sym, (return_1m, sym)) AS top_gainer,
  count(*) FILTER (NOT (signal LIKE '%BUY%' OR signal LIKE '%BULLISH%' OR signal LIKE '%BEARISH%' OR signal LIKE '%CAUTION%')) AS neutral FROM screen"""))
def _(t):
    return scoring.breadth(scoring.screener(t.bars))


@query("TOP-4_leaders", sql("screen", """SELECT *, CAST(row_number() OVER (ORDER BY score DESC, return_1m DESC, return_period DESC, sym) AS INTEGER) AS rank
FROM screen ORDER BY score DESC, return_1m DESC, return_period DESC, sym LIMIT 5"""))
def _(t):
    return scoring.leaders(scoring.screener(t.bars), 5)


NEAR = "greatest(-1, least(1, ({x} - {m}) / {s}::DOUBLE))"


def mood_sql(a, b) -> str:
    def total(m):
        return (f"({m[0]}::DOUBLE * {NEAR.format(x='rsi', m=50, s=50)} + {m[1]}::DOUBLE * sign(e12 - e26 - sig) + {m[2]}::DOUBLE * sign(e9 - e21)"
                f" + {m[3]}::DOUBLE * sign(e21 - e50) + {m[4]}::DOUBLE * {NEAR.format(x='r5', m=0, s=3)} + {m[5]}::DOUBLE * {NEAR.format(x='r14', m=0, s=5)}"
                f" + {m[6]}::DOUBLE * (av * 2 - 1))")
    return f"""SELECT sym, date, rn, adxm, round(CASE WHEN rn >= 20 THEN greatest(-1, least(1, CASE WHEN adxm < 20 THEN {total(a)}
      WHEN vr > 1.2::DOUBLE THEN {total(b)} * 1.1::DOUBLE ELSE {total(b)} END)) ELSE 0 END, 9) + 0.0 AS score
    FROM (SELECT sm.*, coalesce({ret(5)}, 0) * 100 AS r5, coalesce({ret(14)}, 0) * 100 AS r14,
      coalesce({div('volume', roll('avg', 'volume', 20, 5))}, 1) AS vr, CAST(close > vwap_14 AS INTEGER) AS av
      FROM sm JOIN (SELECT sym, date, vwap_14 FROM vw) v USING (sym, date))"""


EVEN = ([0.10, 0.10 * 0.67, 0.10, 0.10, 0.10, 0.10, 0.10 * 0.67], [0.15, 0.15 * 0.67, 0.15, 0.15, 0.15, 0.15, 0.15 * 0.67])
LISTED = ([0.10, 0.05, 0.10, 0.10, 0.10, 0.10, 0.05], [0.15, 0.10, 0.15, 0.15, 0.10, 0.15, 0.10])
block("mood_even", "sm vw", mood_sql(*EVEN))
block("mood_list", "sm vw", mood_sql(*LISTED))
LABEL = "CASE WHEN score >= 0.25 THEN 'BULLISH' WHEN score <= -0.25 THEN 'BEARISH' ELSE 'NEUTRAL' END AS label"


@query("SC-5_mood_score", sql("mood_even", f"SELECT sym, date, {r('score; adx=CASE WHEN rn >= 20 THEN adxm ELSE 25 END')}, {LABEL} FROM mood_even"))
def _(t):
    return keep(scoring.mood(t.bars), "score", "adx", "label")


@query("SC-6_mood_score_listed_weights", sql("mood_list", f"SELECT sym, date, {r('score')}, {LABEL} FROM mood_list"))
def _(t):
    return keep(scoring.mood(t.bars, scoring.LISTED), "score", "label")


block("dec0", "rets", f"""SELECT sym, date, ret_5 * 100 AS a_ret, least(100, greatest(50, 50 + abs(ret_5 * 100) * 10)) AS a_conf,
  {prank('rv')} AS b_prob, greatest(-1, least(1, ret_10)) AS mood FROM (SELECT *, -ret_20 AS rv FROM rets) WHERE rv IS NOT NULL""")
block("dec", "dec0", """SELECT *, CASE WHEN a_ret >= 0 THEN 'UP' ELSE 'DOWN' END AS dir_a, CASE WHEN b_prob >= 0.5 THEN 'UP' ELSE 'DOWN' END AS dir_b,
  greatest(b_prob, 1 - b_prob) AS bc, a_conf / 100.0::DOUBLE AS ac FROM dec0""")
block("dec2", "dec", """SELECT *, (mood < -0.4::DOUBLE AND dir_a = 'UP') OR (mood > 0.4::DOUBLE AND dir_a = 'DOWN') AS oa,
  (mood < -0.4::DOUBLE AND dir_b = 'UP') OR (mood > 0.4::DOUBLE AND dir_b = 'DOWN') AS ob FROM dec""")


def decisions(t):
    df = ind.returns(t.bars, (5, 10, 20)).where(c("ret_20").isNotNull()).withColumn("rv", -c("ret_20"))
    df = df.withColumns({"a_ret": c("ret_5") * 100, "mood": clip("ret_10", -1.0, 1.0)})
    df = df.withColumn("a_conf", clip(50 + F.abs("a_ret") * 10, 50.0, 100.0))
    return xs.rank_pct(df, {"b_prob": "rv"}, bound=t.bound).select("sym", "date", "a_ret", "a_conf", "b_prob", "mood")


def gate_sql(weak: float) -> str:
    return f"""SELECT sym, date, dir_a, dir_b, gate, gate <> 'NO TRADE' AS tradeable,
  CASE WHEN gate = 'B OVERRIDE' OR (gate = 'NO TRADE' AND dir_a <> dir_b AND bc > ac) THEN dir_b ELSE dir_a END AS direction,
  round_even(CASE WHEN gate IN ('A+B CONFIRMED', 'WEAK CONFIRM', 'B OVERRIDE') OR (gate = 'NO TRADE' AND dir_a <> dir_b AND bc > ac)
    THEN bc * 100 ELSE a_conf END, 1) AS confidence
FROM (SELECT *, CASE WHEN dir_a = dir_b AND NOT oa AND bc >= 0.50 THEN 'A+B CONFIRMED' WHEN dir_a = dir_b AND bc >= {weak}::DOUBLE THEN 'WEAK CONFIRM'
  WHEN dir_a = dir_b THEN 'NO TRADE' WHEN bc >= 0.55::DOUBLE AND NOT ob AND ac < bc THEN 'B OVERRIDE'
  WHEN ac >= 0.60::DOUBLE AND ac > bc AND NOT oa THEN 'A STRONG' ELSE 'NO TRADE' END AS gate FROM dec2)"""


GATE_COLS = ("sym", "date", "dir_a", "dir_b", "gate", "tradeable", "direction", "confidence")


@query("SC-7_decision_gate", sql("dec2", gate_sql(0.48)))
def _(t):
    return scoring.decision_gate(decisions(t)).select(*GATE_COLS)


@query("SC-7_decision_gate_variant", sql("dec2", gate_sql(0.50)))
def _(t):
    return scoring.decision_gate(decisions(t), scoring.GATE_VARIANT).select(*GATE_COLS)


@query("SC-8_simple_gate", sql("dec2", """SELECT sym, date, dir_a AS direction,
  dir_a = dir_b AND NOT oa AND b_prob >= 0.55::DOUBLE AS tradeable FROM dec2"""))
def _(t):
    return scoring.simple_gate(decisions(t)).select("sym", "date", "direction", "tradeable")


block("fc", "seq", """SELECT a.sym, a.date AS origin, a.close AS last_close, b.rn - a.rn AS step, b.close, b.high, b.low
  FROM seq a JOIN seq b ON a.sym = b.sym AND b.rn BETWEEN a.rn + 1 AND a.rn + 5""")
FC = ("proj_return", "proj_direction", "proj_range_pct", "proj_std_pct", "confidence")
block("fcs", "fc", """SELECT sym, origin, (proj - last) / last * 100 AS proj_return, CASE WHEN (proj - last) / last * 100 >= 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS proj_direction,
  (hi - lo) / last * 100 AS proj_range_pct, sd / last * 100 AS proj_std_pct, least(100, greatest(50, 50 + abs((proj - last) / last * 100) * 10)) AS confidence
  FROM (SELECT sym, origin, max(last_close) AS last, arg_max(close, step) AS proj, max(high) AS hi, min(low) AS lo, stddev_samp(close) AS sd FROM fc GROUP BY 1, 2)""")


def forecast_bars(t, steps=5):
    """The next bars of a series stand in for a forecast: (sym, origin, last_close, step, ...)."""
    ahead = w.series().rowsBetween(1, steps)
    df = t.bars.withColumn("_b", F.collect_list(F.struct("close", "high", "low")).over(ahead))
    return df.select("sym", c("date").alias("origin"), c("close").alias("last_close"),
                     F.posexplode("_b").alias("step", "b")).select(
        "sym", "origin", "last_close", "step", "b.close", "b.high", "b.low")


@query("SC-9_forecast_summary", sql("fcs", f"SELECT sym, origin, {r('; '.join(FC))} FROM fcs"))
def _(t):
    return rounded(scoring.forecast_summary(forecast_bars(t)))


@query("SC-10_trend_bucket", sql("fcs", """SELECT sym, origin, CASE WHEN round_even(proj_return, 2) >= 0.5 THEN 'Bullish'
  WHEN round_even(proj_return, 2) <= -0.5 THEN 'Bearish' ELSE 'Neutral' END AS trend FROM fcs"""))
def _(t):
    df = scoring.forecast_summary(forecast_bars(t))
    return df.select("sym", "origin", scoring.trend_bucket(F.bround("proj_return", 2)).alias("trend"))


@query("SC-11_tradeable_filter", sql("dec2", """SELECT sym, date, dir_a AS direction FROM dec2 WHERE dir_a = dir_b AND NOT oa AND b_prob >= 0.55::DOUBLE"""))
def _(t):
    df = scoring.simple_gate(decisions(t))
    nested = df.select("sym", "date", F.struct("direction", "tradeable").alias("prediction"))
    return scoring.tradeable_only(nested).select("sym", "date", "prediction.direction")


block("et", "bars", f"""SELECT *, (close - lc) / lc * 100 AS act_ret, abs(pc - close) / close * 100 AS mape,
    (high - low) - (ph - pl) AS miss, ((pc - lc) >= 0) = ((close - lc) / lc * 100 >= 0) AS is_hit
  FROM (SELECT *, {lag('close', 1)} AS lc, ({lag('close', 1)} + {lag('close', 2)}) / 2 AS pc, {lag('high', 1)} AS ph, {lag('low', 1)} AS pl FROM bars)
  WHERE pc IS NOT NULL""")


@query("SC-12_prediction_error_tracker", sql("et", f"""SELECT sym, date, {r('mape; act_ret')}, is_hit,
  CASE WHEN miss > 0.15::DOUBLE * (high - low) THEN 'under' WHEN miss < -0.15::DOUBLE * (high - low) THEN 'over' ELSE 'ok' END AS range_class,
  {r('''running_winrate=avg(CAST(is_hit AS INTEGER)) OVER w * 100; running_mape=avg(mape) OVER w''')}
FROM et WINDOW w AS (PARTITION BY sym ORDER BY date)"""))
def _(t):
    lag = lambda x, n: w.shift(x, n)
    df = t.bars.withColumns({"last_close": lag("close", 1), "pred_high": lag("high", 1), "pred_low": lag("low", 1),
                             "pred_close": (lag("close", 1) + lag("close", 2)) / 2})
    df = scoring.error_tracker(df.where(c("pred_close").isNotNull()))
    return keep(df, "mape", "act_ret", "is_hit", "range_class", "running_winrate", "running_mape")
