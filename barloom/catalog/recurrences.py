"""Exponentially smoothed indicators and what is built on them (WIN-6, TS-11..20, XS-1)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import indicators as ind
from ..functions import windows as w
from ..functions.exprs import c, ratio, rounded
from ..operators import ewm as smooth
from ..plans.pooled import FEATURES, pooled_dataset
from .base import block, div, fwd, lag, query, r, ret, roll, rows, sql
from .timeseries import bar_sql, flag_sql, keep

block("ema_in0", "trs", f"""SELECT *, close - {lag('close', 1)} AS d, greatest(high - {lag('high', 1)}, 0) AS up,
  greatest({lag('low', 1)} - low, 0) AS dn, {lag('close', 1)} AS prev, {roll('avg', 'tr', 14, 3)} AS atr,
  row_number() OVER (PARTITION BY sym ORDER BY date) AS rn FROM trs""")
block("ema_in", "ema_in0", """SELECT *, CASE WHEN d IS NOT NULL THEN greatest(d, 0) END AS gain,
  CASE WHEN d IS NOT NULL THEN greatest(-d, 0) END AS loss,
  CASE WHEN prev IS NOT NULL AND up > dn THEN up ELSE 0 END AS pl,
  CASE WHEN prev IS NOT NULL AND dn > up THEN dn ELSE 0 END AS mi FROM ema_in0""")
E = ind.EMA_SPANS


def step(n: int, old: str, new: str) -> str:
    return f"((1 - 2::DOUBLE / {n + 1}) * {old} + (2::DOUBLE / {n + 1}) * {new})"


DX = ("coalesce(100 * abs(100 * {p} / nullif({a}, 0) - 100 * {m} / nullif({a}, 0)) / nullif(100 * {p} / nullif({a}, 0)"
      " + 100 * {m} / nullif({a}, 0), 0), 0)")
WILD = "CASE WHEN {o} IS NULL THEN {n} ELSE (13::DOUBLE / 14) * {o} + (1::DOUBLE / 14) * {n} END"
EMA_COLUMNS = "sym, date, rn, " + ", ".join(f"e{n}" for n in E) + ", sig, g, l, te, pe, me, adx, adxm"
block("ema", "ema_in", f"""
SELECT sym, date, rn, {', '.join(f'close::DOUBLE' for n in E)}, 0::DOUBLE, gain, loss, tr, pl::DOUBLE, mi::DOUBLE,
  {DX.format(p='pl', m='mi', a='atr')}, {DX.format(p='pl', m='mi', a='tr')} FROM ema_in WHERE rn = 1
UNION ALL
SELECT sym, date, rn, {', '.join(f'n{n}' for n in E)}, {step(9, 'psig', '(n12 - n26)')}, ng, nl, nte, npe, nme,
  {step(14, 'padx', DX.format(p='npe', m='nme', a='atr'))}, {step(14, 'padxm', DX.format(p='npe', m='nme', a='nte'))}
FROM (SELECT s.sym, s.date, s.rn, s.atr, {', '.join(step(n, f'p.e{n}', 's.close') + f' AS n{n}' for n in E)}, p.sig AS psig,
    {WILD.format(o='p.g', n='s.gain')} AS ng, {WILD.format(o='p.l', n='s.loss')} AS nl, {step(14, 'p.te', 's.tr')} AS nte,
    {step(14, 'p.pe', 's.pl')} AS npe, {step(14, 'p.me', 's.mi')} AS nme, p.adx AS padx, p.adxm AS padxm
  FROM ema p JOIN ema_in s ON s.sym = p.sym AND s.rn = p.rn + 1)""", columns=EMA_COLUMNS)
block("sm", "ema ema_in", """SELECT i.*, e.* EXCLUDE (sym, date, rn), coalesce(CASE WHEN i.rn >= 15
  THEN 100 - 100 / (1 + g / nullif(l, 0)) END, 50) AS rsi FROM ema_in i JOIN ema e ON i.sym = e.sym AND i.rn = e.rn""")


@query("WIN-6_ewm_mean", bar_sql("ema_20=e20; wilder_gain=CASE WHEN rn >= 15 THEN g END", src="sm"))
def _(t):
    return keep(ind.smoothed(t.bars, ["ema_20", "avg_gain"]).withColumnRenamed("avg_gain", "wilder_gain"),
                "ema_20", "wilder_gain")


@query("WIN-6_ewm_mean_in_blocks", bar_sql("ema_5=e5", src="sm"))
def _(t):
    df = smooth.ewm(t.bars, [smooth.span("ema_5", "close", 5)], block_rows=128)
    return keep(df, "ema_5")


@query("TS-11_ema", bar_sql("; ".join(f"ema_{n}=e{n}" for n in E), src="sm"))
def _(t):
    names = [f"ema_{n}" for n in E]
    return keep(ind.smoothed(t.bars, names), *names)


PAIRS = ((5, 10), (10, 20), (20, 50), (50, 200))


@query("TS-12_ema_gaps", bar_sql(
    "; ".join(f"ema_gap_{a}_{b}=e{a} / e{b} - 1" for a, b in PAIRS) + "; "
    + "; ".join(f"close_vs_ema{n}=close / e{n} - 1" for n in (10, 20, 50))
    + "; bullish_ema_alignment=" + flag_sql("e20 > e50 AND e50 > e200"), src="sm"))
def _(t):
    df = ind.ema_gaps(ind.smoothed(t.bars, [f"ema_{n}" for n in (5, 10, 20, 50, 200)]))
    return keep(df, *[f"ema_gap_{a}_{b}" for a, b in PAIRS],
                *[f"close_vs_ema{n}" for n in (10, 20, 50)], "bullish_ema_alignment")


def with_rsi(t):
    return ind.smoothed(t.bars, ["avg_gain", "avg_loss"]).withColumn("rsi_14", ind.rsi())


@query("TS-13_rsi", bar_sql("rsi_14=rsi", src="sm"))
def _(t):
    return keep(with_rsi(t), "rsi_14")


@query("TS-14_rsi_slope", bar_sql(f"rsi_slope_3=rsi - {lag('rsi', 3)}; rsi_slope_5=rsi - {lag('rsi', 5)}", src="sm"))
def _(t):
    df = with_rsi(t).withColumns({"rsi_slope_3": w.diff("rsi_14", 3), "rsi_slope_5": w.diff("rsi_14", 5)})
    return keep(df, "rsi_slope_3", "rsi_slope_5")


@query("TS-15_macd", sql("sm", f"""SELECT sym, date, {r('macd=e12 - e26; macd_signal=sig; macd_hist=h')},
  {r(f"macd_slope_3=h - {lag('h', 3)}; macd_slope_5=h - {lag('h', 5)}")} FROM (SELECT *, e12 - e26 - sig AS h FROM sm)"""))
def _(t):
    df = ind.smoothed(t.bars, ["ema_12", "ema_26", "macd_signal"]).withColumn("macd", ind.macd())
    df = df.withColumn("macd_hist", c("macd") - c("macd_signal"))
    df = df.withColumns({"macd_slope_3": w.diff("macd_hist", 3), "macd_slope_5": w.diff("macd_hist", 5)})
    return keep(df, "macd", "macd_signal", "macd_hist", "macd_slope_3", "macd_slope_5")


@query("TS-17_atr", bar_sql("atr_ewm=te; atr_sma=atr", src="sm"))
def _(t):
    return keep(ind.smoothed(t.bars, ["atr_ewm"]).withColumnRenamed("atr", "atr_sma"), "atr_ewm", "atr_sma")


@query("TS-20_directional_index", bar_sql(
    "plus_di=100 * pe / nullif(atr, 0); minus_di=100 * me / nullif(atr, 0); adx_14=adx; adx_mood=adxm; "
    "pdi_mdi_diff=coalesce(100 * pe / nullif(atr, 0) - 100 * me / nullif(atr, 0), 0)", src="sm"))
def _(t):
    df = ind.smoothed(t.bars, ["adx_14", "adx_mood"])
    plus, minus = ind.directional()
    df = df.withColumns({"plus_di": plus, "minus_di": minus,
                         "pdi_mdi_diff": F.coalesce(plus - minus, F.lit(0.0))})
    return keep(df, "plus_di", "minus_di", "adx_14", "adx_mood", "pdi_mdi_diff")


block("pool0", "sm bfeat", f"""SELECT s.sym, s.date, close, {ret(1)} AS ret_1, {ret(5)} AS ret_5, {ret(20)} AS ret_20,
  rsi / 100 - 0.5 AS rsi_14, {'; '.join(f"{div('close', roll('avg', 'close', n))} - 1 AS dist_sma{n}" for n in (20, 50, 200)).replace(';', ',')},
  te / close AS atr_ratio, CASE WHEN {div('volume', roll('avg', 'volume', 20))} IS NOT NULL
    THEN least({div('volume', roll('avg', 'volume', 20))}, 10) END AS volume_ratio,
  volume * close AS vc, {div(lag('close', 21), lag('close', 252))} - 1 AS mom_12_1, {ret(126)} AS mom_6m,
  {fwd(10)} AS fwd_ret, count(*) OVER (PARTITION BY sym) AS nb FROM sm s""")
block("pool1", "pool0 bfeat", f"""SELECT p.*, {roll('stddev_samp', 'ret_1', 10)} AS vol_10,
  {roll('stddev_samp', 'ret_1', 20)} AS vol_20, {roll('avg', 'vc', 20)} AS liq FROM pool0 p""")
block("bvol", "bfeat", """SELECT *, CASE WHEN count(bench_ret_1) OVER w >= 10 THEN stddev_samp(bench_ret_1) OVER w END AS bench_vol
  FROM bfeat WINDOW w AS (ORDER BY date ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)""")
block("pool", "pool1 bvol", """SELECT p.*, bench_ret_1, bench_ret_20, bench_vol, ret_20 - bench_ret_20 AS rel_ret_20,
  fwd_ret - bench_fwd AS fwd_excess FROM pool1 p LEFT JOIN bvol USING (date) WHERE nb >= 300 AND """
      + " AND ".join(f"{f} IS NOT NULL" for f in FEATURES))
ZED = """coalesce(CASE WHEN max({x}) OVER x > min({x}) OVER x THEN ({x} - avg({x}) OVER x) / nullif(stddev_samp({x}) OVER x, 0)
  ELSE 0 END, 0)"""


@query("XS-1_pooled_zscores", sql("pool", f"""SELECT sym, date, {r('; '.join(f"{f}={ZED.format(x=f)}" for f in FEATURES), 5)},
  coalesce(CAST(fwd_excess > 0 AS INTEGER), 0) AS label FROM pool WINDOW x AS (PARTITION BY date)"""))
def _(t):
    df = pooled_dataset(t.bars, t.bench, 10, bound=t.bound)
    return keep(df, *FEATURES, "label", digits=5)
