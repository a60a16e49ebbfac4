"""Significance tests and score statistics (ST-*)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import indicators as ind
from ..functions import windows as w
from ..functions.exprs import c, ratio, rounded
from ..operators import crosssection as xs
from ..operators import joins, metrics, stats
from ..plans import factors as plan
from .aggregates import HIT, HITCOLS
from .base import RANKED, block, div, fwd, ic_blocks, lag, query, prank, r, ret, roll, rows, sql, tests_blocks
from .crosssection import QS, cut_sql, rebalanced

RANKS = ["rank_" + f for f in RANKED]
tests_blocks("fic_t", "fic", "factor", "date", "ic", 10)
tests_blocks("fic_rule", "fic", "factor", "date", "ic", 10,
             lags="CAST(floor(4 * pow(n / 100.0::DOUBLE, 2.0::DOUBLE / 9)) AS BIGINT)")


def factor_ic(t, factors=None):
    return xs.information_coefficient(t.factors if factors is None else factors, RANKS, bound=t.bound)


@query("ST-1_newey_west", sql("fic_rule_se fic_rule_b", f"""SELECT s.factor, b.n, CAST(lags AS INTEGER) AS lags,
  {r('mean; hac_se')} FROM fic_rule_se s JOIN fic_rule_b b ON s.factor = b.factor"""))
def _(t):
    return rounded(stats.newey_west(factor_ic(t), "factor", "date", "ic"))


TESTCOLS = "mean; n_effective; t_naive; t_hac; t_nonoverlap; inflation"


@query("ST-2_mean_tests", sql("fic_t", f"SELECT factor, n, {r(TESTCOLS, 5)} FROM fic_t"))
def _(t):
    return rounded(stats.mean_tests(factor_ic(t), "factor", "date", "ic", 10).drop("positive"), 5)


@query("ST-3_verdicts", sql("fic_t", """SELECT factor, CASE WHEN t_nonoverlap IS NULL THEN 'inconclusive'
  WHEN abs(t_nonoverlap) >= 2.58::DOUBLE THEN 'significant p<0.01' WHEN abs(t_nonoverlap) >= 1.96::DOUBLE THEN 'significant p<0.05'
  WHEN abs(t_nonoverlap) >= 1.65::DOUBLE THEN 'marginal p<0.10' ELSE 'NOT significant' END AS verdict,
  coalesce((abs(t_hac) >= 1.96::DOUBLE) <> (abs(t_nonoverlap) >= 1.96::DOUBLE), FALSE) AS fragile FROM fic_t"""))
def _(t):
    df = stats.mean_tests(factor_ic(t), "factor", "date", "ic", 10)
    return df.select("factor", stats.verdict().alias("verdict"), stats.fragile().alias("fragile"))


@query("ST-4_factor_ic_table", sql("fic_t fic", f"""SELECT t.factor, round_even(mean, 4) AS ic_mean,
  round_even(t_nonoverlap, 2) AS t_nonovlp, round_even(t_hac, 2) AS t_hac, round_even(t_naive, 2) AS t_naive,
  round_even(pos, 2) AS pos_days, coalesce(abs(t_nonoverlap) >= 1.96::DOUBLE, FALSE) AS sig_5pct,
  CAST(row_number() OVER (ORDER BY abs(round_even(t_nonoverlap, 2)) DESC NULLS LAST, t.factor) AS INTEGER) AS place
FROM fic_t t JOIN (SELECT factor, avg(CAST(ic > 0 AS INTEGER)) AS pos FROM fic GROUP BY 1) p ON t.factor = p.factor"""))
def _(t):
    df = stats.mean_tests(factor_ic(t), "factor", "date", "ic", 10)
    df = df.select("factor", F.bround("mean", 4).alias("ic_mean"),
                   F.bround("t_nonoverlap", 2).alias("t_nonovlp"), F.bround("t_hac", 2).alias("t_hac"),
                   F.bround("t_naive", 2).alias("t_naive"), F.bround("positive", 2).alias("pos_days"),
                   F.coalesce(F.abs("t_nonoverlap") >= 1.96, F.lit(False)).alias("sig_5pct"))
    order = Window.orderBy(F.abs("t_nonovlp").desc_nulls_last(), "factor")
    return df.withColumn("place", F.row_number().over(order))


GRID_T = """SELECT factor, avg(ic) AS ic_mean, avg(ic) / nullif(stddev_samp(ic) / sqrt(count(*)), 0) AS t_naive,
  CASE WHEN count(*) FILTER (g) > 2 THEN avg(ic) FILTER (g) / nullif(stddev_samp(ic) FILTER (g)
    / sqrt(count(*) FILTER (g)), 0) END AS t_nonovlp, count(*) FILTER (g) AS n_indep
FROM (SELECT *, date IN (SELECT date FROM {grid}) AS g FROM {ic}) GROUP BY 1"""
block("grid_all", "factors", """SELECT date FROM (SELECT DISTINCT date, dense_rank() OVER (ORDER BY date) AS k FROM factors)
  WHERE (k - 1) % 10 = 0""")
block("fic_grid", "fic grid_all", GRID_T.format(grid="grid_all", ic="fic"))


@query("ST-5_date_grid_ic_table", sql("fic_grid", f"""SELECT factor, {r('ic_mean; t_naive; t_nonovlp', 5)}, n_indep,
  coalesce(abs(t_nonovlp) >= 1.96::DOUBLE, FALSE) AS significant FROM fic_grid"""))
def _(t):
    stored = t.stored_factors
    grid = joins.every_hth_date(stored, 10)
    return rounded(stats.date_grid_tests(factor_ic(t, stored), grid), 5)


def quintile_blocks(name: str, src: str, score: str, step: int) -> None:
    block(name + "_m", src, f"""SELECT *, {score} >= quantile_cont({score}, 0.8) OVER (PARTITION BY date) AS top,
      {score} <= quantile_cont({score}, 0.2) OVER (PARTITION BY date) AS bot
      FROM (SELECT *, dense_rank() OVER (ORDER BY date) AS k FROM {src}
            WHERE {score} IS NOT NULL AND fwd_excess IS NOT NULL) WHERE (k - 1) % {step} = 0""")
    block(name, name + "_m", "SELECT * FROM (" + HIT.format(by="", y="fwd_excess", src=name + "_m", group="") + ")")


def quintile_statistics(t, df, score, step):
    df = joins.on_rebalance_dates(df.where(c(score).isNotNull() & c("fwd_excess").isNotNull()), step)
    df = xs.with_quantiles(df, score, {"_hi": 0.8, "_lo": 0.2}, bound=t.bound)
    return metrics.hit_statistics(df, c(score) >= c("_hi"), c(score) <= c("_lo"))


REST = "n_picks, n_rebalances, beats_base"
quintile_blocks("q_mr", "factors", "score_mr", 4)
quintile_blocks("q_f3", "factors", "score_fund3", 4)
block("common", "factors", "SELECT * FROM factors WHERE score_mr IS NOT NULL AND score_fund3 IS NOT NULL")
quintile_blocks("q_mrc", "common", "score_mr", 4)
quintile_blocks("q_f3c", "common", "score_fund3", 4)


@query("ST-6_quintile_statistics", sql("q_mr", f"SELECT {r(HITCOLS, 5)}, {REST} FROM q_mr"))
def _(t):
    return rounded(quintile_statistics(t, t.factors, "score_mr", 4), 5)


@query("ST-7_all_and_common_rows", sql("q_mr q_f3 q_mrc q_f3c", " UNION ALL ".join(
    f"SELECT '{s}' AS score, '{k}' AS sample, {r(HITCOLS, 5)}, {REST} FROM {b}" for s, k, b in (
        ("score_mr", "all", "q_mr"), ("score_fund3", "all", "q_f3"),
        ("score_mr", "common", "q_mrc"), ("score_fund3", "common", "q_f3c")))))
def _(t):
    from functools import reduce
    stored = t.stored_factors
    common = stored.na.drop(subset=["score_mr", "score_fund3"])
    parts = [quintile_statistics(t, df, s, 4).withColumns({"score": F.lit(s), "sample": F.lit(k)})
             for k, df in (("all", stored), ("common", common))
             for s in ("score_mr", "score_fund3")]
    return rounded(reduce(lambda a, b: a.unionByName(b), parts), 5)


HS = (10, 20, 30)
block("sw0", "feat0", "SELECT sym, date, close, mom_12_1, -ret_20 AS rev, deliv_pct * ret_20 AS deliv_x_ret, "
      + ", ".join(f"{fwd(h)} - {fwd(h, 'bench')} AS e{h}" for h in HS) + " FROM feat0")
block("sw1", "sw0 fund", """SELECT s.*, eps / nullif(close, 0) AS earn_yield FROM sw0 s ASOF LEFT JOIN fund u
  ON s.sym = u.sym AND s.date >= u.avail_date WHERE s.sym IN (SELECT sym FROM fund)""")
block("sw2", "sw1", " UNION ALL ".join(
    f"SELECT {h} AS h, sym, date, mom_12_1, rev, deliv_x_ret, earn_yield, e{h} AS fwd_excess FROM sw1 WHERE e{h} IS NOT NULL"
    for h in HS))
block("sw3", "sw2", """SELECT * FROM (SELECT *, dense_rank() OVER (PARTITION BY h ORDER BY date) AS k FROM sw2)
  WHERE (k - 1) % h = 0""")
block("sw4", "sw3", "SELECT *, " + ", ".join(f"{prank(x, 'h, date')} AS r_{x}" for x in
                                             ("mom_12_1", "rev", "deliv_x_ret", "earn_yield")) + " FROM sw3")
block("sw5", "sw4", " UNION ALL ".join(f"SELECT h, date, fwd_excess, '{m}' AS model, {e} AS score FROM sw4" for m, e in (
    ("shipped", "round((r_mom_12_1 + r_rev) / 2, 12)"), ("newcore", "round((r_rev + (1 - r_deliv_x_ret)) / 2, 12)"),
    ("fund3", "round((r_rev + (1 - r_deliv_x_ret) + r_earn_yield) / 3, 12)"))))
block("sw6", "sw5", """SELECT *, score >= quantile_cont(score, 0.8) OVER (PARTITION BY h, model, date) AS top
  FROM sw5 WHERE score IS NOT NULL""")


@query("ST-8_horizon_sweep", sql("sw6 sw3", f"""SELECT CAST(h AS INTEGER) AS horizon, model, round_even(hr * 100, 2) AS hit_rate,
  round_even(sqrt(hr * (1 - hr) / greatest(n, 1)) * 100, 2) AS se_pp, n AS n_picks, rb AS rebalances
FROM (SELECT h, model, avg(CAST(fwd_excess > 0 AS INTEGER)) AS hr, count(*) AS n FROM sw6 WHERE top GROUP BY 1, 2)
JOIN (SELECT h, count(DISTINCT date) AS rb FROM sw3 GROUP BY 1) USING (h)"""))
def _(t):
    from ..plans.studies import horizon_sweep
    return horizon_sweep(t.bars, t.bench, t.fund, HS, t.bound)


block("vp0", "lrets", f"""SELECT sym, date, deliv_pct, -deliv_pct AS deliv_inv,
  {roll('stddev_samp', 'lr', 20)} * sqrt(252) AS vol20, {roll('stddev_samp', 'lr', 60)} * sqrt(252) AS vol60,
  CASE WHEN count(lr) OVER (PARTITION BY sym ORDER BY date ROWS BETWEEN 1 FOLLOWING AND 10 FOLLOWING) = 10
    THEN stddev_samp(lr) OVER (PARTITION BY sym ORDER BY date ROWS BETWEEN 1 FOLLOWING AND 10 FOLLOWING) END * sqrt(252) AS fwd_vol,
  (high - low) / nullif(close, 0) AS rng FROM lrets""")
block("vp", "vp0", f"SELECT * FROM (SELECT *, {roll('avg', 'rng', 20)} AS range20 FROM vp0) WHERE fwd_vol IS NOT NULL")
ic_blocks("vp_ic", "vp", ["vol20", "vol60", "range20", "deliv_inv"], "fwd_vol", 6)
block("vp_grid", "vp", """SELECT date FROM (SELECT DISTINCT date, dense_rank() OVER (ORDER BY date) AS k FROM vp) WHERE (k - 1) % 10 = 0""")
block("vp_t", "vp_ic vp_grid", GRID_T.format(grid="vp_grid", ic="vp_ic"))


@query("ST-9_volatility_predictability", sql("vp_t", f"""SELECT factor, {r('ic_mean; t_naive; t_nonovlp', 5)}, n_indep,
  coalesce(abs(t_nonovlp) >= 1.96::DOUBLE, FALSE) AS significant FROM vp_t"""))
def _(t):
    from ..plans.studies import volatility_tests
    return rounded(volatility_tests(t.bars, 10, t.bound), 5)


@query("ST-9_volatility_quintiles", sql("vp vp_grid", f"""SELECT bucket, {r('fwd_vol=avg(fwd_vol)')}, count(*) AS n
FROM (SELECT *, {cut_sql('vol20', 'e')} AS bucket FROM (SELECT *, quantile_cont(vol20, {QS}) OVER (PARTITION BY date) AS e
  FROM vp WHERE vol20 IS NOT NULL AND date IN (SELECT date FROM vp_grid))) GROUP BY 1"""))
def _(t):
    from ..plans.studies import volatility_quintiles
    return rounded(volatility_quintiles(t.bars, 10, t.bound))


tests_blocks("fund_tt", "fund_ic", "factor", "date", "ic", 1)


@query("ST-10_fundamental_ic", sql("fund_tt", """SELECT factor, round_even(mean, 4) AS ic_mean, round_even(t_naive, 2) AS t,
  n AS n_dates, coalesce(abs(t_naive) >= 1.96::DOUBLE, FALSE) AS sig FROM fund_tt WHERE n >= 10"""))
def _(t):
    ic = xs.information_coefficient(rebalanced(t), plan.FUNDAMENTAL, min_names=10, bound=t.bound)
    df = stats.mean_tests(ic, "factor", "date", "ic", 1).where("n >= 10")
    return df.select("factor", F.bround("mean", 4).alias("ic_mean"), F.bround("t_naive", 2).alias("t"),
                     c("n").alias("n_dates"),
                     F.coalesce(F.abs("t_naive") >= 1.96, F.lit(False)).alias("sig"))
