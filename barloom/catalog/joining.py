"""Joins (J-*)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import indicators as ind
from ..functions import windows as w
from ..functions.exprs import c, ratio, rounded
from ..operators import joins, labels
from ..operators.macro import attach_scalars, market_state
from .base import block, div, fwd, lag, prank, query, r, ret, roll, rows, sql
from .timeseries import keep


@query("J-1_benchmark_forward_return", sql("bars bfwd", f"""SELECT sym, date, {r(f'''fwd_ret={fwd(10)}; bench_fwd;
  fwd_excess={fwd(10)} - bench_fwd''')} FROM bars LEFT JOIN bfwd USING (date)"""))
def _(t):
    df = joins.excess_by_benchmark_calendar(t.bars, t.bench, 10)
    return keep(df, "fwd_ret", "bench_fwd", "fwd_excess")


block("barsb", "bars bench", "SELECT bars.*, bench FROM bars LEFT JOIN bench USING (date)")


@query("J-2_benchmark_on_symbol_calendar", sql("barsb", f"""SELECT sym, date, {r(f'''fwd_ret={fwd(10)};
  bench_fwd={fwd(10, 'bench')}; fwd_excess={fwd(10)} - {fwd(10, 'bench')}''')} FROM barsb"""))
def _(t):
    df = joins.excess_by_symbol_calendar(t.bars, t.bench, 10)
    return keep(df, "fwd_ret", "bench_fwd", "fwd_excess")


@query("J-3_align_columns_to_close", sql("bars", """SELECT c.sym, c.date, round(c.close, 6) + 0.0 AS close,
  round(h.high, 6) + 0.0 AS high, round(h.low, 6) + 0.0 AS low FROM bars c
LEFT JOIN (SELECT sym, date, high, low FROM bars WHERE deliv_pct < 50) h ON c.sym = h.sym AND c.date = h.date"""))
def _(t):
    some = t.bars.where(c("deliv_pct") < 50).select("sym", "date", "high", "low")
    df = t.bars.select("sym", "date", "close").join(some, ["sym", "date"], "left")
    return rounded(df)


@query("J-4_price_with_delivery", sql("bars", """SELECT p.sym, p.date, round(p.close, 6) + 0.0 AS close,
  round(d.deliv_pct, 6) + 0.0 AS deliv_pct FROM bars p
LEFT JOIN (SELECT sym, date, deliv_pct FROM bars WHERE volume >= 50) d ON p.sym = d.sym AND p.date = d.date"""))
def _(t):
    deliv = t.bars.where(c("volume") >= 50).select("sym", "date", "deliv_pct")
    return rounded(t.bars.select("sym", "date", "close").join(deliv, ["sym", "date"], "left"))


CTX = ("^MKT", "A-FX=X")
block("ctxj", "bars bench", """SELECT b.sym, b.date, x.bench AS m, z.close AS f FROM bars b LEFT JOIN bench x USING (date)
  LEFT JOIN (SELECT date, close FROM bars WHERE sym = 'Brand#1') z ON b.date = z.date""")


@query("J-5_context_features", sql("ctxj", f"""SELECT sym, date, {r('; '.join(
    f'{n}_ret_{k}={ret(k, x)}' for n, x in (('MKT', 'm'), ('A_FXX', 'f')) for k in (1, 5, 10)))},
  {r('; '.join(f"{n}_vol_20={roll('stddev_samp', 'r' + x, 20, 5)}" for n, x in (('MKT', 'm'), ('A_FXX', 'f'))))}
FROM (SELECT *, {ret(1, 'm')} AS rm, {ret(1, 'f')} AS rf FROM ctxj)"""))
def _(t):
    context = t.bench.select(F.lit("^MKT").alias("symbol"), "date", c("bench").alias("close")) \
        .unionByName(t.bars.where(c("sym") == "Brand#1").select(
            F.lit("A-FX=X").alias("symbol"), "date", "close"))
    df = joins.context_features(t.bars.select("sym", "date"), context, CTX)
    return keep(df, *[f"{n}_{k}" for n in ("MKT", "A_FXX")
                      for k in ("ret_1", "ret_5", "ret_10", "vol_20")])


@query("J-6_asof_backward", sql("bars fund", f"""SELECT b.sym, b.date, avail_date, {r('eps; roe; earn_growth; profit_margin')}
FROM bars b ASOF LEFT JOIN fund u ON b.sym = u.sym AND b.date >= u.avail_date WHERE b.sym IN (SELECT sym FROM fund)"""))
def _(t):
    df = joins.attach_fundamentals(t.bars.select("sym", "date", "close"), t.fund)
    return keep(df, "avail_date", "eps", "roe", "earn_growth", "profit_margin")


@query("J-6_asof_by_interval", sql("bars fund", f"""SELECT b.sym, b.date, avail_date, {r('eps; roe')}
FROM bars b ASOF LEFT JOIN fund u ON b.sym = u.sym AND b.date >= u.avail_date WHERE b.sym IN (SELECT sym FROM fund)"""))
def _(t):
    df = joins.attach_by_interval(t.bars.select("sym", "date", "close"), t.fund)
    return keep(df, "avail_date", "eps", "roe")


@query("J-7_scalar_attach", sql("bars bench", f"""SELECT sym, date, {r('close; vix; m14')} FROM bars, (
  SELECT max_by(bench, date) / 100.0::DOUBLE AS vix, max_by(m, date) AS m14 FROM (SELECT date, bench,
    (bench / lag(bench, 13) OVER (ORDER BY date) - 1) * 100 AS m FROM bench))"""))
def _(t):
    return keep(attach_scalars(t.bars, market_state(t.bench).select("vix", "m14")),
                "close", "vix", "m14")


@query("J-8_rebalance_semi_join", sql("bars", f"""SELECT sym, date, {r('close')} FROM (SELECT *,
  dense_rank() OVER (ORDER BY date) AS k FROM bars) WHERE (k - 1) % 10 = 0"""))
def _(t):
    return keep(joins.on_rebalance_dates(t.bars, 10), "close")


@query("J-9_left_join_extra_column", sql("vols", f"""SELECT v.sym, v.date, {r('volatility_20')}, round(b.deliv_pct, 6) + 0.0 AS deliv
FROM vols v LEFT JOIN (SELECT sym, date, deliv_pct FROM bars WHERE volume >= 100) b ON v.sym = b.sym AND v.date = b.date"""))
def _(t):
    vol = ind.volatility(ind.returns(t.bars, (1,))).select("sym", "date", "volatility_20")
    extra = t.bars.where(c("volume") >= 100).select("sym", "date", c("deliv_pct").alias("deliv"))
    return rounded(vol.join(extra, ["sym", "date"], "left"))


block("names", "", """SELECT CAST(s_suppkey AS VARCHAR) AS sym, s_name AS name FROM supplier WHERE s_acctbal > 0""")


@query("J-10_name_lookup", sql("wbars names", """SELECT w.sym, coalesce(name, w.sym) AS name, count(*) AS bars
FROM wbars w LEFT JOIN names n ON w.sym = n.sym GROUP BY 1, 2"""))
def _(t):
    names = t.table("supplier").where(c("s_acctbal") > 0).select(
        c("s_suppkey").cast("string").alias("sym"), c("s_name").alias("name"))
    per = t.wide_bars.groupBy("sym").agg(F.count(F.lit(1)).alias("bars"))
    return joins.with_names(per, names)


@query("J-11_both_dates_present", sql("bars", f"""SELECT a.sym, a.date, b.date AS next_date,
  round((b.close - a.close) / a.close * 100, 6) + 0.0 AS fwd_ret FROM bars a
JOIN (SELECT date, lead(date, 14) OVER (ORDER BY date) AS nd FROM (SELECT DISTINCT date FROM bars)) d ON a.date = d.date
JOIN bars b ON b.sym = a.sym AND b.date = d.nd"""))
def _(t):
    from pyspark.sql import Window
    dates = t.bars.select("date").distinct().withColumn(
        "next_date", F.lead("date", 14).over(Window.orderBy("date")))
    later = t.bars.select("sym", c("date").alias("next_date"), c("close").alias("exit"))
    df = t.bars.select("sym", "date", "close").join(dates, "date").join(later, ["sym", "next_date"])
    return rounded(df.select("sym", "date", "next_date",
                             (ratio(c("exit") - c("close"), "close") * 100).alias("fwd_ret")))


@query("J-12_events_soon", sql("bars fund", """SELECT sym, date,
  EXISTS (SELECT 1 FROM fund u WHERE u.sym = b.sym AND u.avail_date <= b.date + INTERVAL 12 DAY) AS any_until,
  EXISTS (SELECT 1 FROM fund u WHERE u.sym = b.sym AND u.avail_date <= b.date + INTERVAL 12 DAY AND u.avail_date >= b.date) AS upcoming
FROM bars b"""))
def _(t):
    calendar = t.fund.select("sym", c("avail_date").alias("event_date"))
    base = t.bars.select("sym", "date")
    df = joins.soon(base, calendar, 12, "date").withColumnRenamed("earnings_soon", "any_until")
    return joins.soon(df, calendar, 12, "date", lower=True).withColumnRenamed(
        "earnings_soon", "upcoming")


@query("J-13_forecast_and_realised", sql("bars", f"""SELECT sym, date, {r('''proj_ret; actual_ret; error=actual_ret - proj_ret''')},
  CASE WHEN proj_ret >= 0 THEN 'UP' ELSE 'DOWN' END AS pred_dir, (proj_ret >= 0) = (actual_ret >= 0) AS is_hit
FROM (SELECT sym, date, -{ret(5)} AS proj_ret, {fwd(10)} AS actual_ret FROM bars) WHERE proj_ret IS NOT NULL AND actual_ret IS NOT NULL"""))
def _(t):
    df = t.bars.withColumn("proj_ret", -w.change("close", 5))
    df = df.withColumn("pred_dir", labels.direction(c("proj_ret")))
    df = labels.direction_hits(df, 10).where(c("proj_ret").isNotNull())
    return keep(df.withColumn("error", c("actual_ret") - c("proj_ret")),
                "proj_ret", "actual_ret", "error", "pred_dir", "is_hit")


@query("J-14_common_sample", sql("common", f"SELECT sym, date, {r('score_mr; score_fund3')} FROM common"))
def _(t):
    return keep(t.factors.na.drop(subset=["score_mr", "score_fund3"]), "score_mr", "score_fund3")


@query("J-15_no_open_position", sql("rets", """SELECT sym, date FROM rets s WHERE ret_5 > 0
  AND sym NOT IN (SELECT sym FROM rets WHERE date = (SELECT max(date) FROM rets) AND ret_20 > 0)"""))
def _(t):
    from ..plans.ranking import latest_rows
    df = ind.returns(t.bars, (5, 20))
    held = latest_rows(df).where(c("ret_20") > 0).select("sym")
    return df.where(c("ret_5") > 0).select("sym", "date").join(held, "sym", "left_anti")
