"""Backtests (BT-*) and accuracy leaders (TOP-6)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import windows as w
from ..functions.exprs import c, ratio, rounded
from ..operators import backtest as bt
from ..operators import crosssection as xs
from ..operators import joins, metrics, scoring
from .aggregates import HIT, TIER_SQL, accuracy_by_symbol, hits, sided
from .base import block, div, fwd, lag, prank, query, r, ret, roll, rows, sql
from .crosssection import QS, cut_sql, liquidity_reversal, rebalanced
from .timeseries import keep

block("sdays", "signals", """SELECT date, n, row_number() OVER (ORDER BY date) AS rn FROM (SELECT date, count(*) AS n FROM signals GROUP BY 1)""")
block("greedy", "sdays", """SELECT min(rn) FROM sdays WHERE n >= 25
  UNION ALL SELECT min(d.rn) FROM greedy g JOIN sdays d ON d.n >= 25 AND d.rn >= g.rn + 10 GROUP BY g.rn""", columns="rn")
block("greedy_dates", "greedy sdays", "SELECT date FROM greedy JOIN sdays USING (rn)")


@query("BT-1_greedy_schedule", sql("greedy_dates", "SELECT date FROM greedy_dates"))
def _(t):
    return bt.greedy_schedule(t.signals, 10, 25)


@query("BT-1_greedy_schedule_per_fold", sql("signals", """SELECT fold, date FROM (SELECT fold, date, dense_rank() OVER (PARTITION BY fold ORDER BY date) AS k FROM (SELECT DISTINCT fold, date FROM signals))
WHERE (k - 1) % 10 = 0"""))
def _(t):
    return bt.greedy_schedule(t.signals, 10, 1, by=["fold"])


@query("BT-2_fixed_schedule", sql("sdays", "SELECT date FROM sdays WHERE (rn - 1) % 10 = 0 AND n >= 25"))
def _(t):
    return bt.fixed_schedule(t.signals, 10, 25)


block("trades", "signals greedy_dates", """SELECT date, avg(fwd_excess) - 2 * 0.001::DOUBLE AS pnl, avg(label) AS hit, count(*) AS picks
  FROM (SELECT *, row_number() OVER (PARTITION BY date ORDER BY proba DESC, sym) AS k FROM signals WHERE date IN (SELECT date FROM greedy_dates))
  WHERE k <= 5 GROUP BY 1""")


def trades(t):
    return bt.basket(t.stored_signals, bt.greedy_schedule(t.stored_signals, 10, 25), "proba", 5)


@query("BT-3_basket_pnl", sql("trades", f"SELECT date, {r('pnl; hit')}, picks FROM trades"))
def _(t):
    return rounded(trades(t))


SO_FAR = "(ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
block("curve", "trades", f"""SELECT *, equity / max(equity) OVER {SO_FAR} - 1 AS drawdown
  FROM (SELECT *, product(1 + pnl) OVER {SO_FAR} AS equity FROM trades)""")


@query("BT-4_equity_curve", sql("curve", f"SELECT date, {r('pnl; equity; drawdown; hit')} FROM curve"))
def _(t):
    return rounded(bt.equity_curve(trades(t)).select("date", "pnl", "equity", "drawdown", "hit"))


@query("BT-4_portfolio_summary", sql("curve", f"""SELECT count(*) AS n_rebalances, {r('''total_return=arg_max(equity, date) - 1;
  ann_return=avg(pnl) * 25.2::DOUBLE; ann_vol=stddev_samp(pnl) * sqrt(25.2::DOUBLE); max_drawdown=min(drawdown); hit_rate=avg(hit);
  sharpe=coalesce(avg(pnl) * 25.2::DOUBLE / nullif(stddev_samp(pnl) * sqrt(25.2::DOUBLE), 0), 0)''')} FROM curve"""))
def _(t):
    return rounded(bt.summary(bt.equity_curve(trades(t)), 10))


block("vs0", "signals greedy_dates", """SELECT *, row_number() OVER (PARTITION BY date ORDER BY proba DESC, sym) AS k FROM signals
  WHERE date IN (SELECT date FROM greedy_dates)""")
block("vs1", "vs0", """SELECT date, avg(fwd_ret) FILTER (k <= 5) - 0.002::DOUBLE AS s, avg(fwd_ret) - 0.002::DOUBLE AS b,
  string_agg(sym, ', ' ORDER BY k) FILTER (k <= 5) AS picks, round_even(avg(label) FILTER (k <= 5) * 100, 0) AS hit_rate FROM vs0 GROUP BY 1""")


@query("BT-5_basket_and_universe", sql("vs1", """SELECT date, picks, round_even(s * 100, 2) AS strat_ret, round_even(b * 100, 2) AS bench_ret,
  round_even((s - b) * 100, 2) AS excess, hit_rate FROM vs1"""))
def _(t):
    grid = bt.greedy_schedule(t.stored_signals, 10, 25)
    return bt.against_universe(t.stored_signals.join(grid, "date", "left_semi"), "proba", 5, horizon=1)


block("rot0", "health", "SELECT sym, date, close, score FROM health WHERE sma_50 IS NOT NULL")
block("rotd", "rot0", """SELECT date, lead(date) OVER (ORDER BY date) AS nd FROM (SELECT date, row_number() OVER (ORDER BY date) - 1 AS i
  FROM (SELECT date, count(*) AS n FROM rot0 GROUP BY 1) WHERE n >= 5) WHERE i % 14 = 0""")
block("rot1", "rot0 rotd", """SELECT a.date, a.sym, a.score, (b.close - a.close) / a.close * 100 AS ret,
  row_number() OVER (PARTITION BY a.date ORDER BY a.score DESC, a.sym) AS k
  FROM rot0 a JOIN rotd d ON a.date = d.date JOIN rot0 b ON b.sym = a.sym AND b.date = d.nd""")
block("rot2", "rot1", f"""SELECT *, 100000 * product(1 + top_ret / 100) OVER {SO_FAR} AS portfolio, 100000 * product(1 + bench_ret / 100) OVER {SO_FAR} AS benchmark
  FROM (SELECT date, avg(ret) FILTER (k <= 5) AS top_ret, avg(ret) AS bench_ret, count(*) AS names FROM rot1 GROUP BY 1 HAVING count(*) >= 5)""")
block("rot3", "rot2", f"SELECT *, portfolio / greatest(max(portfolio) OVER {SO_FAR}, 100000) - 1 AS drawdown FROM rot2")


def rotation(t):
    return bt.score_rotation(scoring.health_history(t.bars).select("sym", "date", "close", "score"))


@query("BT-6_score_rotation", sql("rot3", f"SELECT date, names, {r('top_ret; bench_ret; drawdown')}, {r('portfolio; benchmark', 2)} FROM rot3"))
def _(t):
    return rounded(rotation(t), portfolio=2, benchmark=2)


@query("BT-6_rotation_summary", sql("rot3", """SELECT round_even(p, 2) AS final_capital, round_even((p / 100000 - 1) * 100, 2) AS strategy_total_return,
  round_even((b / 100000 - 1) * 100, 2) AS benchmark_total_return, round_even((p / 100000 - 1) * 100 - (b / 100000 - 1) * 100, 2) AS alpha,
  round_even(dd * 100, 2) AS max_drawdown, round_even(coalesce(m / nullif(s, 0) * sqrt(18), 0), 2) AS sharpe_ratio, n AS rebalance_count
FROM (SELECT arg_max(portfolio, date) AS p, arg_max(benchmark, date) AS b, least(min(drawdown), 0) AS dd, avg(top_ret / 100) AS m,
  stddev_pop(top_ret / 100) AS s, count(*) AS n FROM rot3)"""))
def _(t):
    return bt.rotation_summary(rotation(t))


block("htiers", "health", "SELECT * FROM health WHERE sma_50 IS NOT NULL AND fwd_5d IS NOT NULL AND fwd_10d IS NOT NULL AND fwd_21d IS NOT NULL")


def tier_samples(t):
    return scoring.health_history(t.bars).na.drop(subset=["fwd_5d", "fwd_10d", "fwd_21d"])


@query("BT-7_score_tier_test", sql("htiers", TIER_SQL.format(src="htiers")))
def _(t):
    return bt.tier_table(tier_samples(t))


@query("BT-7_score_correlation", sql("htiers", """SELECT count(*) AS total_samples,
  round_even(covar_pop(score, fwd_10d) / nullif(stddev_pop(score) * stddev_pop(fwd_10d), 0), 4) AS ic_10d,
  round_even(covar_pop(score, fwd_21d) / nullif(stddev_pop(score) * stddev_pop(fwd_21d), 0), 4) AS ic_21d FROM htiers"""))
def _(t):
    return tier_samples(t).agg(F.count(F.lit(1)).alias("total_samples"),
                               F.bround(xs.correlation("score", "fwd_10d"), 4).alias("ic_10d"),
                               F.bround(xs.correlation("score", "fwd_21d"), 4).alias("ic_21d"))


@query("BT-8_signal_pnl", sql("sided", f"SELECT sym, date, fold, side, {r('gross=side * fwd_ret; net')} FROM sided"))
def _(t):
    return rounded(sided(t).select("sym", "date", "fold", "side", "gross", "net"))


@query("BT-8_fold_equity", sql("sided", f"""SELECT fold, date, n, {r('''log_equity=ln(nullif(abs(equity), 0)); drawdown=equity / max(equity) OVER w - 1''')}
FROM (SELECT *, product(growth) OVER (PARTITION BY fold ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS equity
  FROM (SELECT fold, date, product(1 + net / 100) AS growth, count(*) AS n FROM sided GROUP BY 1, 2))
WINDOW w AS (PARTITION BY fold ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"""))
def _(t):
    df = bt.fold_equity(sided(t).withColumn("net", c("net") / 100))
    return rounded(df.select("fold", "date", "n", F.ln(F.nullif(F.abs("equity"), F.lit(0.0))).alias("log_equity"), "drawdown"))


block("thr0", "signals", """SELECT fold, thr, avg(CAST(proba >= thr AS INTEGER)) AS coverage, count(*) FILTER (proba >= thr) AS trades,
  count(*) FILTER (proba >= thr AND label = 1) AS tp, product(1 + s * fwd_ret / 100 - CASE WHEN s <> 0 THEN 0.001::DOUBLE ELSE 0 END) - 1 AS total
  FROM (SELECT *, CASE WHEN proba >= thr THEN 1 WHEN proba <= 1 - thr THEN -1 ELSE 0 END AS s FROM signals,
    (SELECT CAST(round(0.50 + 0.01 * i, 2) AS DOUBLE) AS thr FROM range(46) g(i))) GROUP BY 1, 2""")
block("thr1", "thr0", """SELECT *, coalesce(tp / nullif(trades, 0), 0) AS precision, coverage >= 0.05::DOUBLE AND trades >= 5 AS ok FROM thr0""")
block("thr2", "thr1", """SELECT *, round(CASE WHEN precision >= 0.55::DOUBLE THEN 10 + coverage + total ELSE precision + 0.05::DOUBLE * coverage + total END, 9) AS points FROM thr1""")


@query("BT-9_threshold_search", sql("thr2", f"""SELECT fold, {r('threshold=thr; precision')}, trades FROM thr2 WHERE ok
QUALIFY row_number() OVER (PARTITION BY fold ORDER BY points DESC, thr) = 1"""))
def _(t):
    df = t.signals.withColumn("fwd_ret", c("fwd_ret") / 100)
    return rounded(bt.threshold_search(df, ["fold"]))


block("mc0", "liqrev", " UNION ALL ".join(f"""SELECT '{m}' AS model, sym, date, CAST(year(date) AS INTEGER) AS fold, {e} AS proba, exc_10 AS fwd_excess,
  CAST(exc_10 > 0 AS INTEGER) AS label FROM liqrev WHERE exc_10 IS NOT NULL""" for m, e in (
      ("liq", "rank_liq"), ("rev", "rank_rev"), ("mom", "mom_rank"), ("composite", "score"))).replace("FROM liqrev", f"FROM (SELECT *, {prank('mom_12_1')} AS mom_rank FROM liqrev)"))
MCAUC = """SELECT {by}, sum(pos * (b0 + neg / 2.0::DOUBLE)) / nullif(sum(pos) * sum(neg), 0) AS auc FROM (
  SELECT *, coalesce(sum(neg) OVER (PARTITION BY {by} ORDER BY proba ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b0 FROM (
  SELECT {by}, proba, count(*) FILTER (label = 1) AS pos, count(*) FILTER (label <> 1) AS neg FROM mc0 GROUP BY {by}, proba)) GROUP BY {by}"""
block("mc_a", "mc0", MCAUC.format(by="model"))
block("mc_f", "mc0", """SELECT model, avg(auc) AS fm, stddev_pop(auc) AS fs, avg(CAST(auc > 0.5 AS INTEGER)) AS fp FROM ("""
      + MCAUC.format(by="model, fold") + ") GROUP BY 1")
block("mc_q", "mc0", f"""SELECT model, avg(fwd_excess) FILTER (bucket = mb) AS qt, avg(fwd_excess) FILTER (bucket = 0) AS qb FROM (
  SELECT *, max(bucket) OVER (PARTITION BY model) AS mb FROM (SELECT *, {cut_sql('proba', 'e')} AS bucket FROM (
  SELECT *, quantile_cont(proba, {QS}) OVER (PARTITION BY model, fold) AS e FROM mc0))) GROUP BY 1""")
block("mc_p", "mc0", """SELECT model, avg(pnl) AS m, stddev_samp(pnl) AS s, count(*) AS n, avg(hit) AS h FROM (SELECT model, date, avg(fwd_excess) - 0.002::DOUBLE AS pnl, avg(label) AS hit FROM (
  SELECT *, row_number() OVER (PARTITION BY model, date ORDER BY proba DESC, sym) AS k, dense_rank() OVER (PARTITION BY model ORDER BY date) AS dk,
    count(*) OVER (PARTITION BY model, date) AS nn FROM mc0) WHERE (dk - 1) % 10 = 0 AND nn >= 5 AND k <= 5 GROUP BY 1, 2) GROUP BY 1""")


@query("BT-10_model_comparison", sql("mc0 mc_a mc_f mc_q mc_p", """SELECT model, round_even(auc, 4) AS auc, round_even(acc, 4) AS accuracy, round_even(base, 4) AS baseline_up_rate,
  round_even(fm, 4) AS fold_auc_mean, round_even(fs, 4) AS fold_auc_std, round_even(fp * 100, 0) AS fold_auc_positive_pct,
  round_even(qt, 4) AS top_quintile_excess, round_even(qt - qb, 4) AS quintile_spread, round_even(m * 25.2::DOUBLE * 100, 1) AS ann_excess_pct,
  round_even(coalesce(m * 25.2::DOUBLE / nullif(s * sqrt(25.2::DOUBLE), 0), 0), 2) AS sharpe, round_even(h * 100, 1) AS avg_hit_rate_pct, n AS n_rebalances, np AS n_predictions
FROM (SELECT model, avg(CAST((proba > 0.5) = (label = 1) AS INTEGER)) AS acc, avg(label) AS base, count(*) AS np FROM mc0 GROUP BY 1)
JOIN mc_a USING (model) JOIN mc_f USING (model) JOIN mc_q USING (model) JOIN mc_p USING (model)"""))
def _(t):
    from ..plans.evaluation import compare_models
    full = xs.rank_pct(liquidity_reversal(t), {"mom_rank": "mom_12_1"}, bound=t.bound).where(c("exc_10").isNotNull())
    cells = F.array(*[F.struct(F.lit(m).alias("model"), c(x).alias("proba")) for m, x in (
        ("liq", "rank_liq"), ("rev", "rank_rev"), ("mom", "mom_rank"), ("composite", "score"))])
    long = full.select("sym", "date", F.year("date").alias("fold"), c("exc_10").alias("fwd_excess"),
                       (c("exc_10") > 0).cast("int").alias("label"), F.inline(cells))
    return compare_models(long, 10, 5, 10, None)


block("tq", "rebal", " UNION ALL ".join(f"SELECT date, '{m}' AS model, {e} AS score, fwd_excess FROM rebal" for m, e in (
    ("shipped", "score_mr"), ("newcore", "round((rank_rev + (1 - rank_deliv_x_ret)) / 2, 12)"), ("fund3", "score_fund3"))))


@query("BT-11_top_quintile_hit_rate", sql("tq", f"""SELECT model, count(*) AS n_picks, {r('''hit_rate=avg(CAST(fwd_excess > 0 AS INTEGER)) * 100;
  se_pp=sqrt(avg(CAST(fwd_excess > 0 AS INTEGER)) * (1 - avg(CAST(fwd_excess > 0 AS INTEGER))) / greatest(count(*) / 10.0::DOUBLE, 1)) * 100''')}
FROM (SELECT *, score >= quantile_cont(score, 0.8) OVER (PARTITION BY model, date) AS top FROM tq WHERE score IS NOT NULL) WHERE top GROUP BY 1"""))
def _(t):
    core = F.round((c("rank_rev") + (1 - c("rank_deliv_x_ret"))) / 2, xs.TIE_DIGITS)
    cells = F.array(*[F.struct(F.lit(m).alias("model"), e.alias("score")) for m, e in (
        ("shipped", c("score_mr")), ("newcore", core), ("fund3", c("score_fund3")))])
    df = rebalanced(t).select("date", "fwd_excess", F.inline(cells)).where(c("score").isNotNull())
    top = xs.with_quantiles(df, "score", {"q": 0.8}, ["model", "date"], t.bound).where("score >= q")
    hit, n = F.avg((c("fwd_excess") > 0).cast("double")), F.count(F.lit(1))
    return rounded(top.groupBy("model").agg(n.alias("n_picks"), (hit * 100).alias("hit_rate"), (F.sqrt(
        hit * (1 - hit) / F.greatest(n / 10.0, F.lit(1.0))) * 100).alias("se_pp")))


GRIDS = [(h, m) for h in (5, 10, 20) for m in (0.015, 0.02, 0.03)]
@query("BT-12_parameter_sweep", sql("bars", f"""SELECT horizon, move, count(*) AS n, {r('''positive_rate=avg(CAST(f > move AS INTEGER));
  precision=coalesce(count(*) FILTER (p >= 0.6::DOUBLE AND f > move) / nullif(count(*) FILTER (p >= 0.6::DOUBLE), 0), 0);
  coverage=avg(CAST(p >= 0.6::DOUBLE AS INTEGER)); mean_ret=avg(f) FILTER (p >= 0.6::DOUBLE)''')}
FROM (SELECT p, f5, f10, f20 FROM (SELECT *, {prank('rv')} AS p FROM (SELECT sym, date, -{ret(20)} AS rv, {fwd(5)} AS f5, {fwd(10)} AS f10, {fwd(20)} AS f20 FROM bars) WHERE rv IS NOT NULL)),
LATERAL (SELECT * FROM (VALUES {', '.join(f'({h}, {m}::DOUBLE, f{h})' for h, m in GRIDS)}) v(horizon, move, f)) WHERE f IS NOT NULL GROUP BY 1, 2"""))
def _(t):
    from ..plans.evaluation import parameter_sweep
    return rounded(parameter_sweep(t.bars, (5, 10, 20), (0.015, 0.02, 0.03), t.bound))


@query("TOP-6_best_and_worst", sql("acc", f"""SELECT * FROM ((SELECT 'best' AS side, sym, {r('acc')} FROM acc ORDER BY round(acc, 6) DESC, sym LIMIT 3)
UNION ALL (SELECT 'worst' AS side, sym, round(acc, 6) + 0.0 AS acc FROM acc ORDER BY round(acc, 6), sym LIMIT 3))"""))
def _(t):
    acc = rounded(accuracy_by_symbol(t).select("sym", "acc"))
    best = acc.orderBy(c("acc").desc(), "sym").limit(3).select(F.lit("best").alias("side"), "sym", "acc")
    worst = acc.orderBy("acc", "sym").limit(3).select(F.lit("worst").alias("side"), "sym", "acc")
    return best.unionByName(worst)
