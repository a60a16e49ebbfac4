"""Labels and targets (LBL-*)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import windows as w
from ..functions.exprs import c, rounded
from ..operators import joins, labels
from .base import block, div, fwd, lag, query, r, ret, roll, rows, sql
from .timeseries import keep

HZ = (5, 10, 20, 21, 30)


@query("LBL-1_forward_returns", sql("bars", f"SELECT sym, date, {r('; '.join(f'fwd_ret_{h}={fwd(h)}' for h in HZ))} FROM bars"))
def _(t):
    return keep(labels.forward_returns(t.bars, HZ), *[f"fwd_ret_{h}" for h in HZ])


@query("LBL-2_forward_excess", sql("barsb bfwd", f"""SELECT sym, date, {r(f'''by_benchmark={fwd(10)} - bench_fwd;
  by_symbol={fwd(10)} - {fwd(10, 'bench')}''')} FROM barsb LEFT JOIN bfwd USING (date)"""))
def _(t):
    a = joins.excess_by_benchmark_calendar(t.bars, t.bench, 10)
    a = a.withColumnRenamed("fwd_excess", "by_benchmark").drop("fwd_ret", "bench_fwd")
    b = joins.excess_by_symbol_calendar(a, t.bench, 10)
    return keep(b.withColumnRenamed("fwd_excess", "by_symbol"), "by_benchmark", "by_symbol")


@query("LBL-3_binary_label", sql("bars bfwd", f"""SELECT sym, date,
  coalesce(CAST({fwd(10)} - bench_fwd > 0 AS INTEGER), 0) AS label FROM bars LEFT JOIN bfwd USING (date)"""))
def _(t):
    df = joins.excess_by_benchmark_calendar(t.bars, t.bench, 10)
    return df.select("sym", "date", labels.binary().alias("label"))


@query("LBL-4_threshold_label", sql("bars", "SELECT sym, date, " + ", ".join(
    f"coalesce(CAST({fwd(5)} > {m}::DOUBLE AS INTEGER), 0) AS up_{int(m * 1000)}" for m in (0.015, 0.02, 0.03)) + " FROM bars"))
def _(t):
    df = t.bars.withColumn("f", w.forward("close", 5))
    return df.select("sym", "date", *[labels.above("f", m).alias(f"up_{int(m * 1000)}")
                                      for m in (0.015, 0.02, 0.03)])


@query("LBL-5_majority_label", sql("bars", f"""SELECT sym, date, CAST((coalesce(CAST(a > 0 AS INTEGER), 0)
  + coalesce(CAST(b > 0 AS INTEGER), 0) + coalesce(CAST(d > 0 AS INTEGER), 0)) >= 2 AS INTEGER) AS majority_up
FROM (SELECT sym, date, {fwd(5)} AS a, {fwd(10)} AS b, {fwd(20)} AS d FROM bars) WHERE d IS NOT NULL"""))
def _(t):
    return labels.majority(t.bars).select("sym", "date", "majority_up")


block("seq", "bars",
      "SELECT *, row_number() OVER (PARTITION BY sym ORDER BY date) AS rn FROM bars")


@query("LBL-6_triple_barrier", sql("seq", """SELECT sym, date, CAST(CASE WHEN tp IS NULL AND sl IS NULL THEN 2
  WHEN sl IS NULL OR tp <= sl THEN 1 ELSE 0 END AS INTEGER) AS triple_label
FROM (SELECT a.sym, a.date, min(b.rn - a.rn) FILTER (b.high >= a.close * (1 + 0.03::DOUBLE)) AS tp,
    min(b.rn - a.rn) FILTER (b.low <= a.close * (1 - 0.02::DOUBLE)) AS sl
  FROM seq a LEFT JOIN seq b ON a.sym = b.sym AND b.rn BETWEEN a.rn + 1 AND a.rn + 10 GROUP BY 1, 2)"""))
def _(t):
    return labels.triple_barrier(t.bars).select("sym", "date", "triple_label")


@query("LBL-7_meta_label", sql("bars", f"""SELECT sym, date, CAST(coalesce((p = 1 AND f > 0) OR (p = 0 AND f < 0), FALSE) AS INTEGER) AS meta_label
FROM (SELECT sym, date, CAST({ret(5)} < 0 AS INTEGER) AS p, {fwd(10)} AS f FROM bars) WHERE p IS NOT NULL"""))
def _(t):
    df = t.bars.withColumn("pred_up", (w.change("close", 5) < 0).cast("int"))
    df = labels.meta_label(df)
    return df.where(c("pred_up").isNotNull()).select("sym", "date", "meta_label")


@query("LBL-8_direction_and_hit", sql("bars", f"""SELECT sym, date, CASE WHEN p >= 0 THEN 'UP' ELSE 'DOWN' END AS pred_dir,
  CASE WHEN f >= 0 THEN 'UP' ELSE 'DOWN' END AS actual_dir, (p >= 0) = (f >= 0) AS is_hit
FROM (SELECT sym, date, {ret(3)} AS p, {fwd(10)} AS f FROM bars) WHERE p IS NOT NULL AND f IS NOT NULL"""))
def _(t):
    df = t.bars.withColumn("pred_dir", labels.direction(w.change("close", 3)))
    df = labels.direction_hits(df, 10).where(c("pred_dir").isNotNull())
    return df.select("sym", "date", "pred_dir", "actual_dir", "is_hit")


@query("LBL-9_side_correctness", sql("signals", """SELECT sym, date, CASE WHEN proba >= 0.5 THEN 'LONG' ELSE 'SHORT' END AS direction,
  (proba >= 0.5) = (fwd_excess > 0) AS hit_exc, (proba >= 0.5) = (fwd_ret > 0) AS hit_abs FROM signals"""))
def _(t):
    df = labels.side_hits(t.signals, "proba")
    return df.select("sym", "date", "direction", "hit_exc", "hit_abs")
