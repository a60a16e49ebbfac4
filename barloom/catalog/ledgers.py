"""Positions and trades (TR-*)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import windows as w
from ..functions.exprs import c, rounded
from ..operators import crosssection as xs
from ..operators import joins, ledger
from .base import block, div, fwd, lag, prank, query, r, ret, roll, rows, sql

CAPITAL = 1_000_000.0
block("pos0", "bars", f"""SELECT sym, date AS entry_date, close AS price, CASE WHEN r >= 0 THEN 'UP' ELSE 'DOWN' END AS direction, 40 + 60 * p AS confidence
FROM (SELECT *, {prank('r')} AS p FROM (SELECT sym, date, close, {ret(20)} AS r, dense_rank() OVER (ORDER BY date) AS k FROM bars) WHERE r IS NOT NULL)
WHERE (k - 1) % 10 = 0""")
block("pos1", "pos0", f"""SELECT *, price AS entry_price, CAST(CASE WHEN kelly > 0 AND price > 0 THEN floor(greatest(100000 * kelly, 10000) / price) ELSE 0 END AS BIGINT) AS shares
FROM (SELECT *, greatest(0, least(1, (confidence / 100 - 0.5) * 2)) AS kelly FROM pos0)""")
block("pos", "pos1", """SELECT sym, entry_date, direction, confidence, entry_price, shares,
  round_even(entry_price * (1 - CASE WHEN direction = 'UP' THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END * 0.03::DOUBLE), 2) AS stop_loss,
  round_even(entry_price * (1 + CASE WHEN direction = 'UP' THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END * 0.06::DOUBLE), 2) AS target FROM pos1 WHERE shares > 0""")
block("px", "pos bars", """SELECT p.*, b.date AS d, b.close, CASE WHEN direction = 'UP' THEN low <= stop_loss ELSE high >= stop_loss END AS st,
  CASE WHEN direction = 'UP' THEN high >= target ELSE low <= target END AS tp FROM pos p JOIN bars b ON b.sym = p.sym AND b.date >= p.entry_date""")
block("ex", "px", """SELECT sym, entry_date, direction, confidence, entry_price, shares, stop_loss, target, bars, last AS last_close,
  CASE WHEN hs THEN 'CLOSED_SL' WHEN ht THEN 'CLOSED_TP' WHEN bars >= 10 THEN 'CLOSED_EXPIRY' ELSE 'OPEN' END AS status,
  CASE WHEN hs THEN stop_loss WHEN ht THEN target WHEN bars >= 10 THEN last END AS exit_price,
  CASE WHEN hs OR ht THEN hd WHEN bars >= 10 THEN de END AS exit_date
FROM (SELECT sym, entry_date, direction, confidence, entry_price, shares, stop_loss, target, count(*) AS bars, arg_max(close, d) AS last, max(d) AS de,
  min(d) FILTER (st OR tp) AS hd, coalesce(arg_min(st, d) FILTER (st OR tp), FALSE) AS hs, coalesce(arg_min(tp, d) FILTER (st OR tp), FALSE) AS ht
  FROM px GROUP BY 1, 2, 3, 4, 5, 6, 7, 8)""")
PNL = "CASE WHEN direction = 'UP' THEN exit_price - entry_price ELSE -(exit_price - entry_price) END * shares"
block("tr", "ex", f"""SELECT sym, direction, entry_price, exit_price, shares, round_even({PNL}, 2) AS pnl,
  round_even(({PNL}) / nullif(entry_price * shares, 0) * 100, 2) AS pnl_pct, entry_date, exit_date,
  CAST(greatest(1, date_diff('day', entry_date, exit_date)) AS INTEGER) AS hold_days, status AS reason FROM ex WHERE status <> 'OPEN'""")


def sized(t):
    df = t.stored_bars.withColumn("r", w.change("close", 20)).where(c("r").isNotNull())
    df = xs.rank_pct(df, {"p": "r"}, bound=t.bound)
    df = df.join(joins.every_hth_date(t.stored_bars, 10), "date", "left_semi")
    df = df.select("sym", c("date").alias("entry_date"), c("close").alias("price"),
                   F.when(c("r") >= 0, F.lit("UP")).otherwise(F.lit("DOWN")).alias("direction"),
                   (40 + 60 * c("p")).alias("confidence"), F.lit(CAPITAL).alias("capital"))
    return df.withColumns({"shares": ledger.shares(), "entry_price": c("price")})


def positions(t, stop=ledger.STOP, target=ledger.TARGET):
    return ledger.with_levels(sized(t).where("shares > 0"), stop=stop, target=target).select(
        "sym", "entry_date", "direction", "confidence", "entry_price", "shares", "stop_loss", "target")


def closed(t):
    return ledger.exits(positions(t), t.stored_bars)


@query("TR-1_position_size", sql("pos1", f"SELECT sym, entry_date, {r('confidence')}, shares FROM pos1"))
def _(t):
    return rounded(sized(t).select("sym", "entry_date", "confidence", "shares"))


@query("TR-2_stop_and_target", sql("pos", f"SELECT sym, entry_date, direction, {r('stop_loss; target')} FROM pos"))
def _(t):
    return rounded(positions(t).select("sym", "entry_date", "direction", "stop_loss", "target"))


@query("TR-3_first_exit", sql("ex", f"SELECT sym, entry_date, status, exit_date, bars, {r('exit_price')} FROM ex"))
def _(t):
    return rounded(closed(t).select("sym", "entry_date", "status", "exit_date", "bars", "exit_price"))


@query("TR-4_trade_records", sql("tr", f"SELECT * EXCLUDE (entry_price, exit_price), {r('entry_price; exit_price')} FROM tr"))
def _(t):
    return rounded(ledger.trade_records(closed(t)))


block("pos5", "pos1", """SELECT sym, entry_date, direction, entry_price, shares,
  round_even(entry_price * (1 - CASE WHEN direction = 'UP' THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END * 0.99::DOUBLE), 2) AS stop_loss,
  round_even(entry_price * (1 + CASE WHEN direction = 'UP' THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END * 99::DOUBLE), 2) AS target FROM pos1 WHERE shares > 0""")
block("open5", "pos5 bars", """SELECT p.sym, p.entry_date, direction, entry_price, shares, arg_max(close, b.date) AS last_close, count(*) AS bars
  FROM pos5 p JOIN bars b ON b.sym = p.sym AND b.date >= p.entry_date GROUP BY 1, 2, 3, 4, 5
  HAVING count(*) < 10 AND NOT bool_or(CASE WHEN direction = 'UP' THEN low <= stop_loss OR high >= target ELSE high >= stop_loss OR low <= target END)""")


@query("TR-5_open_value", sql("open5", f"""SELECT sym, count(*) AS n_open, {r(f"open_pnl=sum({PNL.replace('exit_price', 'last_close')})", 4)}
FROM open5 GROUP BY 1"""))
def _(t):
    return rounded(ledger.open_value(ledger.exits(positions(t, 0.99, 99.0), t.stored_bars)), 4)


@query("TR-6_performance_report", sql("tr", """SELECT n AS total_trades, wn AS winning_trades, n - wn AS losing_trades, round_even(wn / n * 100, 2) AS win_rate,
  round_even(p, 2) AS total_pnl, round_even(p / n, 2) AS avg_pnl, round_even(dd, 2) AS max_drawdown, round_even(hold, 1) AS mean_hold_days,
  round_even(coalesce(m * (252 / greatest(1, hold)) / nullif(s * sqrt(252 / greatest(1, hold)), 0), 0), 2) AS sharpe_ratio, round_even(p / 1000000 * 100, 2) AS total_return
FROM (SELECT count(*) AS n, count(*) FILTER (pnl > 0) AS wn, sum(pnl) AS p, avg(hold_days) AS hold, avg(pnl_pct / 100) AS m, stddev_samp(pnl_pct / 100) AS s FROM tr),
 (SELECT greatest(max((pk - eq) / pk * 100), 0) AS dd FROM (SELECT eq, greatest(max(eq) OVER (ORDER BY exit_date), 1000000) AS pk
  FROM (SELECT exit_date, 1000000 + sum(sum(pnl)) OVER (ORDER BY exit_date) AS eq FROM tr GROUP BY 1)))"""))
def _(t):
    return ledger.performance(ledger.trade_records(closed(t)), CAPITAL)
