"""Cross-sectional operators, rankings and top-k (XS-*, TOP-*, WIN-10..13)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import indicators as ind
from ..functions import windows as w
from ..functions.exprs import c, ratio, rounded
from ..operators import crosssection as xs
from ..operators import joins, stats
from ..plans import factors as plan
from ..plans import ranking as weekly
from ..session import materialise
from .base import (MOM, RANKED, block, div, fwd, ic_blocks, lag, prank, query, r, ret, roll, rows,
                   sql)
from .timeseries import keep


# ---- windows by date ------------------------------------------------------------------------
@query("WIN-10_pct_rank", sql("rets", f"SELECT sym, date, {r('pct=' + prank('ret_5'))} FROM rets"))
def _(t):
    df = ind.returns(t.bars, (5,))
    return keep(xs.rank_pct(df, {"pct": "ret_5"}, bound=t.bound), "pct")


block("wrets", "wbars", f"SELECT *, {ret(5)} AS ret_5, {fwd(5)} AS fwd_5 FROM wbars")


@query("WIN-10_pct_rank_unbounded", sql("wrets", f"SELECT sym, date, {r('pct=' + prank('ret_5'))}"
                                                 " FROM wrets"))
def _(t):
    df = ind.returns(t.wide_bars, (5,)).select("sym", "date", "ret_5")
    return keep(xs.rank_pct(df, {"pct": "ret_5"}), "pct")


Z = """CASE WHEN max({x}) OVER x > min({x}) OVER x THEN ({x} - avg({x}) OVER x)
  / nullif(stddev_samp({x}) OVER x, 0) ELSE 0 END"""


@query("WIN-11_zscore_by_date", sql("rets", f"""SELECT sym, date,
  {r('z_5=coalesce(' + Z.format(x='ret_5') + ', 0); z_20=coalesce(' + Z.format(x='ret_20') + ', 0)')}
FROM rets WINDOW x AS (PARTITION BY date)"""))
def _(t):
    df = ind.returns(t.bars, (5, 20), prefix="z_")
    return keep(xs.zscore(df, ["z_5", "z_20"], bound=t.bound), "z_5", "z_20")


@query("WIN-11_zscore_unbounded", sql("wrets", f"""SELECT sym, date,
  {r('z_5=coalesce(' + Z.format(x='ret_5') + ', 0)')} FROM wrets WINDOW x AS (PARTITION BY date)"""))
def _(t):
    df = ind.returns(t.wide_bars, (5,), prefix="z_")
    return keep(xs.zscore(df, ["z_5"]), "z_5")


@query("WIN-12_quantile_by_date", sql("rets", f"""SELECT sym, date,
  {r('hi=quantile_cont(ret_5, 0.8) OVER x; lo=quantile_cont(ret_5, 0.2) OVER x')}
FROM rets WINDOW x AS (PARTITION BY date)"""))
def _(t):
    df = ind.returns(t.bars, (5,))
    return keep(xs.with_quantiles(df, "ret_5", {"hi": 0.8, "lo": 0.2}, bound=t.bound), "hi", "lo")


@query("WIN-12_quantile_unbounded", sql("wrets", f"""SELECT date,
  {r('lo=quantile_cont(ret_5, 0.2); mid=quantile_cont(ret_5, 0.5); hi=quantile_cont(ret_5, 0.8)')}
FROM wrets WHERE ret_5 IS NOT NULL GROUP BY date"""))
def _(t):
    table = xs.quantile_table(ind.returns(t.wide_bars, (5,)), "ret_5", (0.2, 0.5, 0.8))
    return rounded(table.select("date", *[c("q")[i].alias(n) for i, n in enumerate(("lo", "mid", "hi"))]))


def cut_sql(x: str, edges: str) -> str:
    return (f"CAST(CASE WHEN {x} IS NOT NULL THEN greatest(len(list_filter(list_distinct({edges}), "
            f"lambda e: e < {x})) - 1, 0) END AS INTEGER)")


QS = "[0, 0.2, 0.4, 0.6, 0.8, 1.0]"


@query("WIN-13_quantile_cut_by_date", sql("rets", f"""SELECT sym, date, {cut_sql('ret_5', 'e')} AS bucket
FROM (SELECT *, quantile_cont(ret_5, {QS}) OVER (PARTITION BY date) AS e FROM rets)"""))
def _(t):
    df = ind.returns(t.bars, (5,))
    return xs.quantile_cut(df, "ret_5", bound=t.bound).select("sym", "date", "bucket")


@query("WIN-13_quantile_cut_overall", sql("signals", f"""SELECT sym, date, {cut_sql('proba', 'e')} AS bucket
FROM signals, (SELECT quantile_cont(proba, {QS}) AS e FROM signals)"""))
def _(t):
    return xs.quantile_cut(t.signals, "proba", by=()).select("sym", "date", "bucket")


# ---- XS -------------------------------------------------------------------------------------
@query("XS-2_factor_ranks", sql("fact1", f"""SELECT sym, date,
  {r('; '.join('rank_' + f for f in RANKED))} FROM fact1"""))
def _(t):
    return keep(t.factors, *[f"rank_{f}" for f in RANKED])


@query("XS-3_composite_score_mr", sql("factors", f"""SELECT sym, date,
  {r('score_mr; rank_score_mr; weekly_form=(rank_mom_12_1 + 1 - wr) / 2')}
FROM (SELECT *, {prank('ret_20')} AS wr FROM factors) WHERE score_mr IS NOT NULL"""))
def _(t):
    df = xs.rank_pct(t.factors, {"wr": "ret_20"}, bound=t.bound).where(c("score_mr").isNotNull())
    df = df.withColumn("weekly_form", (c("rank_mom_12_1") + 1 - c("wr")) / 2)
    return keep(df, "score_mr", "rank_score_mr", "weekly_form")


@query("XS-4_composite_score_fund3", sql("factors", f"""SELECT sym, date,
  {r('score_fund3; rank_score_fund3')} FROM factors WHERE score_fund3 IS NOT NULL"""))
def _(t):
    return keep(t.factors.where(c("score_fund3").isNotNull()), "score_fund3", "rank_score_fund3")


block("liqrev", "ds", f"""SELECT *, {prank('liq')} AS rank_liq, 1 - {prank('ret_20')} AS rank_rev,
  round({prank('liq')} + (1 - {prank('ret_20')}), 12) AS score FROM ds""")


def liquidity_reversal(t):
    df = xs.rank_pct(t.dataset, {"rank_liq": "liq", "_r": "ret_20"}, bound=t.bound)
    return df.withColumn("rank_rev", 1 - c("_r")).withColumn(
        "score", F.round(c("rank_liq") + c("rank_rev"), xs.TIE_DIGITS))


@query("XS-5_liquidity_reversal", sql("liqrev", f"SELECT sym, date, {r('rank_liq; rank_rev; score')}"
                                                " FROM liqrev"))
def _(t):
    return keep(liquidity_reversal(t), "rank_liq", "rank_rev", "score")


block("sigp0", "ds", f"""SELECT *, {prank('mom_12_1')} AS sig_momentum, 1 - {prank('ret_20')} AS sig_reversal,
  {prank('liq')} AS sig_liquidity, {prank('mom_12_1')} + (1 - {prank('ret_20')}) AS comp FROM ds""")
block("sigp", "sigp0", f"SELECT *, {prank('comp')} AS sig_composite FROM sigp0")


@query("XS-6_model_signal_percentiles", sql("sigp", f"""SELECT sym, date,
  {r('sig_composite; sig_momentum; sig_reversal; sig_liquidity')} FROM sigp"""))
def _(t):
    return keep(plan.signal_percentiles(t.dataset, t.bound), *[f"sig_{m}" for m in plan.MODELS])


block("grid10", "factors", """SELECT date FROM (SELECT DISTINCT date, dense_rank() OVER (ORDER BY date)
  AS k FROM factors WHERE fwd_excess IS NOT NULL) WHERE (k - 1) % 10 = 0""")
block("rebal", "factors grid10", """SELECT * FROM factors WHERE fwd_excess IS NOT NULL
  AND date IN (SELECT date FROM grid10)""")
ic_blocks("fund_ic", "rebal", plan.FUNDAMENTAL, "fwd_excess", 10)
block("fund_t", "fund_ic", """SELECT factor, avg(ic) AS m, avg(ic) / nullif(stddev_samp(ic) / sqrt(count(*)), 0) AS t
  FROM fund_ic GROUP BY 1 HAVING count(*) >= 3""")
block("chosen", "fund_t", "SELECT factor, m FROM fund_t ORDER BY abs(t) DESC, factor LIMIT 1")


def rebalanced(t, step=10):
    data = t.stored_factors.where(c("fwd_excess").isNotNull())
    return joins.on_rebalance_dates(data, step)


def chosen_composite(data, ranks, min_names, min_dates, bound):
    """Reversal, inverted flow and the fundamental factor with the largest absolute t, signed."""
    ic = xs.information_coefficient(data, plan.FUNDAMENTAL, min_names=min_names, bound=bound)
    t = stats.mean_tests(ic, "factor", "date", "ic", 1).where(c("n") >= min_dates)
    best = t.orderBy(F.abs("t_naive").desc(), "factor").limit(1).select(F.struct("factor", "mean"))
    data = data.withColumn("_best", best.scalar())
    picked = F.coalesce(*[F.when(c("_best.factor") == f, c(ranks[f])) for f in plan.FUNDAMENTAL])
    signed = F.when(c("_best.mean") > 0, picked).otherwise(1 - picked)
    score = F.round((c("rank_rev") + (1 - c("rank_deliv_x_ret")) + signed) / 3, xs.TIE_DIGITS)
    return data.withColumns({"best": c("_best.factor"), "score": score}).drop("_best")


@query("XS-7_sign_chosen_composite", sql("rebal chosen", f"""
SELECT sym, date, c.factor AS best, {r('''score=(rank_rev + (1 - rank_deliv_x_ret) + CASE WHEN m > 0
  THEN x ELSE 1 - x END) / 3''')}
FROM (SELECT r.*, c.factor, c.m, CASE c.factor WHEN 'earn_yield' THEN rank_earn_yield WHEN 'roe' THEN rank_roe
  WHEN 'earn_growth' THEN rank_earn_growth ELSE rank_profit_margin END AS x FROM rebal r, chosen c) c"""))
def _(t):
    df = chosen_composite(materialise(rebalanced(t)), {f: f"rank_{f}" for f in plan.FUNDAMENTAL}, 10, 3, t.bound)
    return keep(df, "best", "score")


block("rk0", "bars", f"""SELECT *, volume * close AS vc, {ret(20)} AS ret_20,
  {div(lag('close', 4), lag('close', 52))} - 1 AS mom FROM bars""")
block("rk1", "rk0", f"SELECT *, {roll('avg', 'vc', 20)} AS liq FROM rk0")
block("rk2", "rk1", """SELECT * FROM rk1 WHERE mom IS NOT NULL AND ret_20 IS NOT NULL AND liq IS NOT NULL
  QUALIFY date = max(date) OVER ()""")
block("rk3", "rk2", f"SELECT *, ({prank('mom')} + (1 - {prank('ret_20')})) / 2 AS score_raw FROM rk2")
block("ranked", "rk3 fund", """SELECT CAST(row_number() OVER (ORDER BY score_raw DESC, sym) AS INTEGER) AS rank,
  sym, regexp_replace(sym, '\\.NS$', '') AS symbol, date AS as_of, round_even(close, 1) AS close,
  round_even(mom * 100, 1) AS mom_12_1_pct, round_even(ret_20 * 100, 1) AS ret20_pct,
  round_even(score_raw, 3) AS score,
  EXISTS (SELECT 1 FROM fund u WHERE u.sym = rk3.sym AND avail_date <= rk3.date + INTERVAL 12 DAY)
    AS earnings_soon FROM rk3""")


def ranked(t):
    calendar = t.fund.select("sym", c("avail_date").alias("event_date"))
    return weekly.ranking(t.bars, calendar, t.bound, skip=4, back=52)


@query("XS-8_weekly_ranking_table", sql("ranked", "SELECT * FROM ranked"))
def _(t):
    return ranked(t)


COLUMNS36 = ("ret_20 rev mom_12_1 mom_6m liq deliv_chg20 deliv_x_ret fwd_excess eps roe earn_growth "
             "profit_margin earn_yield score_mr rank_score_mr score_fund3 rank_score_fund3").split()


@query("XS-9_factor_table", sql("factors", f"""SELECT sym, date, avail_date,
  {r('; '.join(COLUMNS36 + ['rank_' + f for f in RANKED]))} FROM factors"""))
def _(t):
    return keep(t.factors, *COLUMNS36, *[f"rank_{f}" for f in RANKED],
                keys=("sym", "date", "avail_date"))


@query("XS-9_factor_table_suppliers", sql("wfactors", f"""SELECT sym, date, avail_date,
  {r('; '.join(COLUMNS36 + ['rank_' + f for f in RANKED]))} FROM wfactors"""))
def _(t):
    table = plan.factor_table(t.wide_closes, t.bench, t.wide_fund, bound=t.wide_bound, narrow=True)
    return keep(table, *COLUMNS36, *[f"rank_{f}" for f in RANKED],
                keys=("sym", "date", "avail_date"))


CELLS = " UNION ALL ".join(
    f"SELECT sym, date, '{m}' AS model, CAST({h} AS INTEGER) AS horizon, sig_{m} AS sig, fwd_{h} AS fwd, "
    f"exc_{h} AS exc FROM sigp" for m in plan.MODELS for h in (5, 10, 20))
block("cells", "sigp", CELLS)
block("cellstats", "cells", """SELECT sym, model, horizon,
  avg(CAST((sig >= 0.5) = (exc > 0) AS INTEGER)) FILTER (fwd IS NOT NULL AND exc IS NOT NULL) AS ae,
  avg(CAST((sig >= 0.5) = (fwd > 0) AS INTEGER)) FILTER (fwd IS NOT NULL AND exc IS NOT NULL) AS aa,
  avg(CAST(fwd > 0 AS INTEGER)) FILTER (fwd IS NOT NULL AND exc IS NOT NULL) AS ur,
  count(*) FILTER (fwd IS NOT NULL AND exc IS NOT NULL) AS n,
  max(sig) FILTER (date = (SELECT max(date) FROM cells)) AS sig
  FROM cells GROUP BY 1, 2, 3 HAVING max(date) = (SELECT max(date) FROM cells)""")


@query("XS-10_model_bench_table", sql("cellstats", """SELECT sym, model, horizon,
  CASE WHEN sig >= 0.5 THEN 'LONG' ELSE 'SHORT' END AS direction, round_even(sig, 3) AS score_pctile,
  row_number() OVER (PARTITION BY model, horizon ORDER BY sig DESC, sym) AS rank,
  count(*) OVER (PARTITION BY model, horizon) AS universe,
  round_even(ae * 100, 1) AS acc_excess_pct, round_even(aa * 100, 1) AS acc_abs_pct,
  round_even(ur * 100, 1) AS up_rate_pct, n FROM cellstats"""))
def _(t):
    return plan.model_bench(t.dataset, (5, 10, 20), t.bound)


# ---- TOP ------------------------------------------------------------------------------------
@query("TOP-1_ranking_ends", sql("ranked", """SELECT * FROM (
  (SELECT 'top' AS side, * FROM ranked ORDER BY rank LIMIT 5) UNION ALL
  (SELECT 'bottom' AS side, * FROM ranked ORDER BY rank DESC LIMIT 5))"""))
def _(t):
    return weekly.ends(ranked(t), 5)


@query("TOP-2_top_k_per_date", sql("signals", f"""SELECT sym, date, {r('proba')},
  CAST(k AS INTEGER) AS pick FROM (SELECT *, row_number() OVER (PARTITION BY date ORDER BY proba DESC, sym)
  AS k FROM signals) WHERE k <= 5"""))
def _(t):
    return keep(xs.top_k(t.signals, "proba", 5), "proba", "pick")


@query("TOP-2_top_k_unbounded", sql("wrets", f"""SELECT sym, date, {r('ret_5')}, CAST(k AS INTEGER) AS pick
FROM (SELECT *, row_number() OVER (PARTITION BY date ORDER BY ret_5 DESC, sym) AS k FROM wrets
  WHERE ret_5 IS NOT NULL) WHERE k <= 5"""))
def _(t):
    return keep(xs.top_k(ind.returns(t.wide_bars, (5,)), "ret_5", 5), "ret_5", "pick")


block("fifths", "liqrev", """SELECT *, row_number() OVER (PARTITION BY date ORDER BY score DESC, sym) AS kt,
  row_number() OVER (PARTITION BY date ORDER BY score, sym) AS kb, count(*) OVER (PARTITION BY date) AS n
  FROM liqrev WHERE exc_10 IS NOT NULL""")


@query("TOP-3_top_bottom_fifth", sql("fifths", """SELECT sym, date,
  kt <= greatest(n // 5, 1) AS is_top, kb <= greatest(n // 5, 1) AS is_bottom
FROM fifths WHERE kt <= greatest(n // 5, 1) OR kb <= greatest(n // 5, 1)"""))
def _(t):
    from ..operators.metrics import fifths
    df = fifths(liquidity_reversal(t).where(c("exc_10").isNotNull()), "score", bound=t.bound)
    return df.where("is_top or is_bottom").select("sym", "date", "is_top", "is_bottom")


ic_blocks("fic", "factors", ["rank_" + f for f in RANKED], "fwd_excess", 6)
block("tsort", "fic", """SELECT factor, avg(ic) / nullif(stddev_samp(ic) / sqrt(count(*)), 0) AS t
  FROM fic GROUP BY 1""")


@query("TOP-5_sort_by_absolute_t", sql("tsort", f"""SELECT factor, {r('t', 4)},
  CAST(row_number() OVER (ORDER BY abs(round(t, 6)) DESC NULLS LAST, factor) AS INTEGER) AS place
FROM tsort"""))
def _(t):
    from pyspark.sql import Window
    ic = xs.information_coefficient(t.factors, ["rank_" + f for f in RANKED], bound=t.bound)
    df = ic.groupBy("factor").agg(ratio(F.avg("ic"), F.stddev_samp("ic") / F.sqrt(F.count("ic")))
                                  .alias("t"))
    order = Window.orderBy(F.abs(F.round("t", 6)).desc_nulls_last(), "factor")
    return rounded(df.withColumn("place", F.row_number().over(order)), 4)


@query("TOP-7_latest_top_ten", sql("factors", f"""SELECT sym, {r('score_mr; rev; mom_12_1; deliv_pct')}
FROM (SELECT * FROM factors WHERE date = (SELECT max(date) FROM factors) AND score_mr IS NOT NULL
  ORDER BY score_mr DESC, sym LIMIT 10)"""))
def _(t):
    df = weekly.latest_rows(t.factors).where(c("score_mr").isNotNull())
    df = df.orderBy(c("score_mr").desc(), "sym").limit(10)
    return rounded(df.select("sym", "score_mr", "rev", "mom_12_1", "deliv_pct"))
