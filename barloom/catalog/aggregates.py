"""Aggregations and set operations (AGG-*, SET-*)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import indicators as ind
from ..functions import windows as w
from ..functions.exprs import c, ratio, rounded, share
from ..operators import crosssection as xs
from ..operators import metrics
from ..plans import factors as plan
from ..session import materialise
from .base import (RANKED, block, div, fwd, ic_blocks, lag, prank, query, r, ret, roll, rows, sql)
from .crosssection import QS, cut_sql, liquidity_reversal
from .timeseries import keep

# ---- shared prediction fixtures --------------------------------------------------------------
CUT = "0.6::DOUBLE"
block("sided", "signals", f"""SELECT *, CASE WHEN proba >= {CUT} THEN 1 ELSE 0 END AS pred,
  CASE WHEN proba >= {CUT} THEN 1 WHEN proba <= 1 - {CUT} THEN -1 ELSE 0 END AS side,
  (CASE WHEN proba >= {CUT} THEN 1 WHEN proba <= 1 - {CUT} THEN -1 ELSE 0 END) * fwd_ret
    - CASE WHEN proba >= {CUT} OR proba <= 1 - {CUT} THEN 0.001::DOUBLE ELSE 0 END AS net
  FROM signals""")
block("hits", "signals", """SELECT *, CASE WHEN proba >= 0.5 THEN 'UP' ELSE 'DOWN' END AS dir_a,
  CASE WHEN proba >= 0.6::DOUBLE THEN 'UP' ELSE 'DOWN' END AS dir_b,
  CASE WHEN fwd_ret >= 0 THEN 'UP' ELSE 'DOWN' END AS actual_dir,
  abs(proba - 0.5) >= 0.2::DOUBLE AS tradeable,
  (proba >= 0.5) = (fwd_ret >= 0) AS is_hit FROM signals""")


def sided(t):
    from ..operators.backtest import signal_pnl
    return signal_pnl(t.signals.withColumn("pred", (c("proba") >= 0.6).cast("int")), 0.6, 10)


def hits(t, signals=None):
    word = lambda cond: F.when(cond, F.lit("UP")).otherwise(F.lit("DOWN"))
    return (t.signals if signals is None else signals).withColumns({
        "dir_a": word(c("proba") >= 0.5), "dir_b": word(c("proba") >= 0.6),
        "actual_dir": word(c("fwd_ret") >= 0), "tradeable": F.abs(c("proba") - 0.5) >= 0.2,
        "is_hit": (c("proba") >= 0.5) == (c("fwd_ret") >= 0)})


block("quint", "liqrev", f"""SELECT *, {cut_sql('score', 'e')} AS bucket FROM (SELECT *,
  quantile_cont(score, {QS}) OVER (PARTITION BY date) AS e FROM liqrev WHERE exc_10 IS NOT NULL)""")


def quintiles(t):
    df = liquidity_reversal(t).where(c("exc_10").isNotNull())
    return xs.quantile_cut(df, "score", bound=t.bound)


@query("AGG-1_bucket_means", sql("quint", f"""SELECT bucket, {r('''mean_excess=avg(exc_10);
  hit=avg(CAST(exc_10 > 0 AS INTEGER)); avg_score=avg(score)''')}, count(*) AS n FROM quint GROUP BY 1"""))
def _(t):
    return rounded(quintiles(t).groupBy("bucket").agg(
        F.avg("exc_10").alias("mean_excess"), metrics.hit_rate("exc_10").alias("hit"),
        F.avg("score").alias("avg_score"), F.count(F.lit(1)).alias("n")))


@query("AGG-2_conditional_rate", sql("signals", f"""SELECT sym, {r('''up_rate=avg(CAST(fwd_ret > 0 AS INTEGER));
  win_rate=avg(CAST(fwd_excess > 0 AS INTEGER))''')}, count(*) AS n FROM signals GROUP BY 1"""))
def _(t):
    return rounded(t.signals.groupBy("sym").agg(
        metrics.hit_rate("fwd_ret").alias("up_rate"), metrics.hit_rate("fwd_excess")
        .alias("win_rate"), F.count(F.lit(1)).alias("n")))


TIER = """CASE WHEN score <= 0 THEN NULL WHEN score <= 45 THEN 'Bearish (0-45)' WHEN score <= 60 THEN 'Caution (45-60)'
  WHEN score <= 75 THEN 'Neutral (60-75)' WHEN score <= 85 THEN 'Bullish (75-85)'
  WHEN score <= 100 THEN 'Top Tier (85-100)' END"""
TIER_SQL = f"""SELECT {TIER} AS tier, count(*) AS n,
  round_even(avg(CAST(fwd_10d > 0 AS INTEGER)) * 100, 1) AS win_rate_10d, round_even(avg(fwd_10d), 2) AS avg_ret_10d,
  round_even(avg(CAST(fwd_21d > 0 AS INTEGER)) * 100, 1) AS win_rate_21d, round_even(avg(fwd_21d), 2) AS avg_ret_21d,
  round_even(coalesce(coalesce(avg(fwd_21d) FILTER (fwd_21d > 0), 0)
    / nullif(coalesce(abs(avg(fwd_21d) FILTER (fwd_21d < 0)), 1), 0), 0), 2) AS payoff_ratio
FROM {{src}} WHERE {TIER} IS NOT NULL GROUP BY 1"""
block("tiers", "bars", f"""SELECT *, {prank('r20')} * 100 AS score FROM (SELECT sym, date, {ret(20)} AS r20,
  {fwd(10)} * 100 AS fwd_10d, {fwd(21)} * 100 AS fwd_21d FROM bars)
  QUALIFY r20 IS NOT NULL AND fwd_10d IS NOT NULL AND fwd_21d IS NOT NULL""")


@query("AGG-3_score_tiers", sql("tiers", TIER_SQL.format(src="tiers")))
def _(t):
    from ..operators.backtest import tier_table
    df = t.bars.withColumns({"r20": w.change("close", 20), "fwd_10d": w.forward("close", 10) * 100,
                             "fwd_21d": w.forward("close", 21) * 100})
    df = xs.rank_pct(df, {"score": "r20"}, bound=t.bound).withColumn("score", c("score") * 100)
    return tier_table(df.where("score is not null and fwd_10d is not null and fwd_21d is not null"))


COVERED = " UNION ALL ".join(f"SELECT '{f}' AS factor, round(avg(CAST({f} IS NOT NULL AS INTEGER)), 6)"
                             f" + 0.0 AS coverage FROM factors" for f in RANKED)


@query("AGG-4_coverage", sql("factors", f"SELECT factor, coverage, coverage >= 0.3::DOUBLE AS ok FROM ({COVERED})"))
def _(t):
    from ..operators.quality import coverage
    df = rounded(coverage(t.factors, RANKED))
    return df.withColumn("ok", c("coverage") >= 0.3)


@query("AGG-5_pooled_correlation", sql("signals", f"""SELECT count(*) AS n,
  {r('''ic=covar_pop(proba, fwd_ret) / nullif(stddev_pop(proba) * stddev_pop(fwd_ret), 0)''')} FROM signals"""))
def _(t):
    return rounded(t.signals.agg(F.count(F.lit(1)).alias("n"),
                                 xs.correlation("proba", "fwd_ret").alias("ic")))


@query("AGG-6_spearman_ic_per_date", sql("fic", f"SELECT date, factor, {r('ic')}, n FROM fic"))
def _(t):
    ic = xs.information_coefficient(t.factors, ["rank_" + f for f in RANKED], bound=t.bound)
    return rounded(ic.select("date", "factor", "ic", "n"))


@query("AGG-6_factor_ic_mean", sql("fic factors", f"""SELECT 'spearman' AS method, {r('mean_ic=avg(ic)')}, count(*) AS n_dates FROM fic WHERE factor = 'rank_rev'
UNION ALL SELECT 'pearson', round(avg(ic), 6) + 0.0, count(*) FROM (SELECT covar_pop(rev, fwd_excess) / nullif(stddev_pop(rev) * stddev_pop(fwd_excess), 0) AS ic
  FROM factors WHERE rev IS NOT NULL AND fwd_excess IS NOT NULL GROUP BY date HAVING count(*) >= 6) WHERE ic IS NOT NULL"""))
def _(t):
    df = t.stored_factors
    rows = [xs.factor_ic(df, f, method=m, bound=t.bound).withColumn("method", F.lit(m))
            for f, m in (("rank_rev", "spearman"), ("rev", "pearson"))]
    return rounded(rows[0].unionByName(rows[1]))


block("wic_src", "wbars", f"SELECT *, -{ret(4)} AS rev, {fwd(4)} AS fwd_4 FROM wbars")
ic_blocks("wic", "wic_src", ["rev", "deliv_pct"], "fwd_4", 30)


@query("AGG-6_spearman_ic_unbounded", sql("wic", f"SELECT date, factor, {r('ic')}, n FROM wic"))
def _(t):
    df = t.wide_bars.withColumns({"rev": -w.change("close", 4), "fwd_4": w.forward("close", 4)})
    ic = xs.information_coefficient(df, ["rev", "deliv_pct"], "fwd_4", min_names=30)
    return rounded(ic.select("date", "factor", "ic", "n"))


AUC = """SELECT {by}sum(pos * (below0 + neg / 2.0::DOUBLE)) / nullif(sum(pos) * sum(neg), 0) AS auc, CAST(sum(pos + neg) AS BIGINT) AS n
FROM (SELECT *, coalesce(sum(neg) OVER ({part} ORDER BY proba ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below0
  FROM (SELECT {by}proba, count(*) FILTER (label = 1) AS pos, count(*) FILTER (label <> 1) AS neg
        FROM signals GROUP BY {by}proba))"""
block("auc_all", "signals", AUC.format(by="", part=""))
block("auc_fold", "signals", AUC.format(by="fold, ", part="PARTITION BY fold") + " GROUP BY fold")


@query("AGG-7_auc", sql("auc_all", f"SELECT {r('auc')}, n FROM auc_all"))
def _(t):
    return rounded(metrics.auc(t.signals).select("auc", "n"))


@query("AGG-7_auc_per_fold", sql("auc_fold", f"SELECT fold, {r('auc')}, n FROM auc_fold"))
def _(t):
    return rounded(metrics.auc(t.signals, by=["fold"]))


@query("AGG-8_accuracy_and_baselines", sql("signals", f"""SELECT fold, {r('''
  accuracy=avg(CAST((proba > 0.5) = (label = 1) AS INTEGER)); base_rate=avg(label);
  majority=greatest(avg(label), 1 - avg(label))''')} FROM signals GROUP BY 1"""))
def _(t):
    base = F.avg("label")
    return rounded(t.signals.groupBy("fold").agg(
        metrics.accuracy().alias("accuracy"), base.alias("base_rate"),
        F.greatest(base, 1 - base).alias("majority")))


@query("AGG-9_precision_recall_f1", sql("sided", f"""SELECT fold, {r('''
  precision=coalesce(tp / nullif(said, 0), 0); recall=coalesce(tp / nullif(tr, 0), 0);
  f1=coalesce(2 * tp / nullif(said + tr, 0), 0)''')} FROM (SELECT fold, count(*) FILTER (pred = 1 AND label = 1) AS tp,
  count(*) FILTER (pred = 1) AS said, count(*) FILTER (label = 1) AS tr FROM sided GROUP BY 1)"""))
def _(t):
    return rounded(metrics.classification(sided(t), ["fold"]))


@query("AGG-10_trading_metrics", sql("sided", f"""SELECT fold, {r('''coverage=avg(CAST(side <> 0 AS INTEGER));
  trade_win_rate=coalesce(avg(CAST(net > 0 AS INTEGER)) FILTER (side <> 0), 0);
  avg_trade_ret_pct=coalesce(avg(net) FILTER (side <> 0) * 100, 0)''')}, count(*) FILTER (side <> 0) AS trades,
  count(*) FILTER (side = 1) AS longs, count(*) FILTER (side = -1) AS shorts FROM sided GROUP BY 1"""))
def _(t):
    return rounded(metrics.trading(sided(t), ["fold"]))


@query("AGG-11_fold_auc_summary", sql("auc_fold", f"""SELECT {r('''mean_auc=avg(auc); std_sample=stddev_samp(auc);
  std_population=stddev_pop(auc); share_above_half=avg(CAST(auc > 0.5 AS INTEGER))''')} FROM auc_fold"""))
def _(t):
    folds = metrics.auc(t.signals, by=["fold"]).where(c("auc").isNotNull())
    return rounded(folds.agg(F.avg("auc").alias("mean_auc"), F.stddev_samp("auc").alias("std_sample"),
                             F.stddev_pop("auc").alias("std_population"),
                             share(c("auc") > 0.5).alias("share_above_half")))


HIT = """SELECT {by}hit * 100 AS hit_rate, se * 100 AS se, (hit - 1.96::DOUBLE * se) * 100 AS ci_lo,
  (hit + 1.96::DOUBLE * se) * 100 AS ci_hi, base * 100 AS base_rate, (hit - base) * 100 AS edge_pp,
  (tm - bm) * 100 AS spread_pp, n_picks, n_rebalances, coalesce(hit - 1.96::DOUBLE * se > base, FALSE) AS beats_base
FROM (SELECT *, sqrt(hit * (1 - hit) / greatest(n_picks, 1)) AS se FROM (
  SELECT {by}avg(CAST({y} > 0 AS INTEGER)) FILTER (top) AS hit, count(*) FILTER (top) AS n_picks,
    avg(CAST({y} > 0 AS INTEGER)) AS base, count(DISTINCT date) AS n_rebalances,
    avg({y}) FILTER (top) AS tm, avg({y}) FILTER (bot) AS bm FROM {src} {group}))"""
HITCOLS = "hit_rate; se; ci_lo; ci_hi; base_rate; edge_pp; spread_pp"
block("marked", "signals", """SELECT *, proba >= quantile_cont(proba, 0.8) OVER (PARTITION BY date) AS top,
  proba <= quantile_cont(proba, 0.2) OVER (PARTITION BY date) AS bot FROM signals""")
block("hitstat", "marked", HIT.format(by="", y="fwd_excess", src="marked", group=""))


@query("AGG-12_binomial_interval", sql("hitstat", f"SELECT {r(HITCOLS, 5)}, n_picks, n_rebalances, beats_base FROM hitstat"))
def _(t):
    df = xs.with_quantiles(t.signals, "proba", {"hi": 0.8, "lo": 0.2}, bound=t.bound)
    return rounded(metrics.hit_statistics(df, c("proba") >= c("hi"), c("proba") <= c("lo")), 5)


@query("AGG-13_deflated_error", sql("marked", f"""SELECT count(*) AS n_picks, {r('''hit_rate=avg(label);
  se=sqrt(avg(label) * (1 - avg(label)) / greatest(count(*) / 10.0::DOUBLE, 1))''')} FROM marked WHERE top"""))
def _(t):
    df = xs.with_quantiles(t.signals, "proba", {"hi": 0.8}, bound=t.bound).where("proba >= hi")
    hit, n = F.avg("label"), F.count(F.lit(1))
    return rounded(df.agg(n.alias("n_picks"), hit.alias("hit_rate"),
                          F.sqrt(hit * (1 - hit) / F.greatest(n / 10.0, F.lit(1.0))).alias("se")))


block("acc", "hits", "SELECT sym, avg(CAST(is_hit AS INTEGER)) * 100 AS acc, count(*) AS n FROM hits GROUP BY 1")


def accuracy_by_symbol(t):
    return hits(t).groupBy("sym").agg((F.avg(c("is_hit").cast("double")) * 100).alias("acc"),
                                      F.count(F.lit(1)).alias("n"))


@query("AGG-14_summary_statistics", sql("acc", f"""SELECT {r('''mean=avg(acc); median=median(acc);
  std=stddev_pop(acc); min=min(acc); max=max(acc)''')}, arg_min(sym, (round(acc, 6), sym)) AS worst,
  arg_max(sym, (round(acc, 6), sym)) AS best FROM acc"""))
def _(t):
    key = F.struct(F.round("acc", 6), "sym")
    acc = materialise(accuracy_by_symbol(t))
    median = xs.quantile_table(acc, "acc", (0.5,), ()).select(c("q")[0]).scalar()
    return rounded(acc.agg(
        F.avg("acc").alias("mean"), F.max(median).alias("median"),
        F.stddev_pop("acc").alias("std"), F.min("acc").alias("min"), F.max("acc").alias("max"),
        F.min_by("sym", key).alias("worst"), F.max_by("sym", key).alias("best")))


@query("AGG-15_category_counts", sql("acc", """SELECT count(*) FILTER (acc >= 70) AS excellent,
  count(*) FILTER (acc >= 50 AND acc < 70) AS good, count(*) FILTER (acc >= 40 AND acc < 50) AS average,
  count(*) FILTER (acc < 40) AS poor, count(*) FILTER (acc >= 55) AS at_55, count(*) FILTER (acc >= 60) AS at_60,
  count(*) FILTER (acc >= 65) AS at_65, count(*) FILTER (acc >= 70) AS at_70 FROM acc"""))
def _(t):
    a = c("acc")
    return accuracy_by_symbol(t).agg(
        F.count_if(a >= 70).alias("excellent"), F.count_if((a >= 50) & (a < 70)).alias("good"),
        F.count_if((a >= 40) & (a < 50)).alias("average"), F.count_if(a < 40).alias("poor"),
        *[F.count_if(a >= k).alias(f"at_{k}") for k in (55, 60, 65, 70)])


@query("AGG-16_argmax_row", sql("signals", f"""SELECT fold, sym, date, {r('fwd_ret')} FROM (
  SELECT *, row_number() OVER (PARTITION BY fold ORDER BY fwd_ret DESC, sym DESC, date DESC) AS k FROM signals) WHERE k = 1"""))
def _(t):
    best = F.max_by(F.struct("sym", "date", "fwd_ret"), F.struct("fwd_ret", "sym", "date"))
    return rounded(t.signals.groupBy("fold").agg(best.alias("b")).select("fold", "b.*"))


@query("AGG-17_monotonic_buckets", sql("quint", """SELECT coalesce(bool_and(m >= p), TRUE) AS monotonic FROM (
  SELECT m, lag(m) OVER (ORDER BY bucket) AS p FROM (SELECT bucket, avg(exc_10) AS m FROM quint GROUP BY 1))"""))
def _(t):
    means = quintiles(t).groupBy("bucket").agg(F.avg("exc_10").alias("m"))
    return metrics.monotonic(means, "bucket", "m")


GRID = " UNION ALL ".join(f"SELECT sym, {h} AS horizon, {m}::DOUBLE AS move_threshold, {fwd(h)} AS f FROM bars"
                          for h in (5, 10) for m in (0.015, 0.02, 0.03))


@query("AGG-19_parameter_groups", sql("bars", f"""SELECT horizon, move_threshold, {r('''
  positive_rate=avg(CAST(f > move_threshold AS INTEGER)); mean_ret=avg(f)''')}, count(*) AS n
FROM ({GRID}) WHERE f IS NOT NULL GROUP BY 1, 2"""))
def _(t):
    df = t.bars.withColumns({"f5": w.forward("close", 5), "f10": w.forward("close", 10)})
    grid = F.array(*[F.struct(F.lit(h).alias("horizon"), F.lit(m).alias("move_threshold"),
                              c(f"f{h}").alias("f")) for h in (5, 10) for m in (0.015, 0.02, 0.03)])
    df = df.select("sym", F.inline(grid)).where(c("f").isNotNull())
    return rounded(df.groupBy("horizon", "move_threshold").agg(
        share(c("f") > c("move_threshold")).alias("positive_rate"), F.avg("f").alias("mean_ret"),
        F.count(F.lit(1)).alias("n")))


CONF = """CASE WHEN abs(proba - 0.5) < 0.02::DOUBLE THEN '0-2%' WHEN abs(proba - 0.5) < 0.05::DOUBLE THEN '2-5%'
  WHEN abs(proba - 0.5) < 0.10::DOUBLE THEN '5-10%' WHEN abs(proba - 0.5) < 0.15::DOUBLE THEN '10-15%' ELSE '15%+' END"""


@query("AGG-20_confidence_buckets", sql("hits", f"""SELECT {CONF} AS bucket, count(*) AS n,
  round_even(avg(CAST(is_hit AS INTEGER)) * 100, 1) AS accuracy, round_even(avg(proba), 4) AS mean_conf
FROM hits GROUP BY 1 HAVING count(*) >= 10"""))
def _(t):
    from ..operators.backtest import confidence_bucket
    return hits(t).groupBy(confidence_bucket("proba").alias("bucket")).agg(
        F.count(F.lit(1)).alias("n"),
        F.bround(F.avg(c("is_hit").cast("double")) * 100, 1).alias("accuracy"),
        F.bround(F.avg("proba"), 4).alias("mean_conf")).where("n >= 10")


@query("AGG-20_confidence_gate", sql("hits", f"""SELECT {r('''gate_added_value=coalesce((avg(CAST(is_hit AS INTEGER)) FILTER (proba > md)
  - avg(CAST(is_hit AS INTEGER)) FILTER (proba <= md)) * 100, 0); filtered_accuracy=coalesce(avg(CAST(is_hit AS INTEGER))
  FILTER (proba > 0.6::DOUBLE) * 100, 0)''')}, count(*) FILTER (proba > 0.6::DOUBLE) AS filtered_count
FROM (SELECT *, quantile_cont(proba, 0.5) OVER () AS md FROM hits)"""))
def _(t):
    from ..operators.backtest import confidence_gate
    return rounded(confidence_gate(hits(t, t.stored_signals), "proba"))


@query("AGG-21_synthetic_benchmark", sql("rets", f"""SELECT date, {r('''log_level=ln(product(1 + coalesce(m, 0)) OVER (ORDER BY date));
  mean_ret=m''')} FROM (SELECT date, avg(ret_1) AS m FROM rets GROUP BY 1)"""))
def _(t):
    from ..operators.backtest import synthetic_benchmark
    df = synthetic_benchmark(t.bars)
    return rounded(df.select("date", F.ln("level").alias("log_level"), "mean_ret"))


@query("AGG-22_key_statistics", sql("bars", """SELECT count(*) AS rows,
  count(*) - count(DISTINCT (sym, date)) AS duplicates, count(DISTINCT sym) AS n_symbols,
  count(DISTINCT date) AS n_dates, min(date) AS date_min, max(date) AS date_max FROM bars"""))
def _(t):
    return t.bars.agg(
        F.count(F.lit(1)).alias("rows"),
        (F.count(F.lit(1)) - F.count_distinct("sym", "date")).alias("duplicates"),
        F.count_distinct("sym").alias("n_symbols"), F.count_distinct("date").alias("n_dates"),
        F.min("date").alias("date_min"), F.max("date").alias("date_max"))


@query("AGG-23_quintile_spread", sql("fifths", f"""SELECT date, {r('''spread=avg(exc_10) FILTER (kt <= greatest(n // 5, 1))
  - avg(exc_10) FILTER (kb <= greatest(n // 5, 1))''')} FROM fifths GROUP BY 1"""))
def _(t):
    df = metrics.fifths(liquidity_reversal(t).where(c("exc_10").isNotNull()), "score", bound=t.bound)
    return rounded(df.groupBy("date").agg(
        (F.avg(F.when(c("is_top"), c("exc_10"))) - F.avg(F.when(c("is_bottom"), c("exc_10"))))
        .alias("spread")))


block("foldhits", "hits", """SELECT sym, fold, count(*) AS total, count(*) FILTER (is_hit) AS hits,
  avg(CAST(is_hit AS INTEGER)) * 100 AS accuracy, min(date) AS test_start, max(date) AS test_end FROM hits GROUP BY 1, 2""")


def fold_hits(t):
    return hits(t).groupBy("sym", "fold").agg(
        F.count(F.lit(1)).alias("total"), F.count_if("is_hit").alias("hits"),
        (F.avg(c("is_hit").cast("double")) * 100).alias("accuracy"),
        F.min("date").alias("test_start"), F.max("date").alias("test_end"))


@query("AGG-24_mean_over_folds", sql("foldhits", f"""SELECT sym, count(*) AS folds, {r('''accuracy=avg(accuracy);
  mean_total=avg(total)''')} FROM foldhits GROUP BY 1"""))
def _(t):
    return rounded(fold_hits(t).groupBy("sym").agg(
        F.count(F.lit(1)).alias("folds"), F.avg("accuracy").alias("accuracy"),
        F.avg("total").alias("mean_total")))


@query("AGG-25_fold_hit_summary", sql("foldhits", f"""SELECT sym, count(*) AS total_folds,
  CAST(sum(total) AS BIGINT) AS total_predictions, CAST(sum(hits) AS BIGINT) AS total_hits, min(test_start) AS test_start,
  max(test_end) AS test_end, {r('''overall_accuracy=sum(hits) / sum(total) * 100;
  recent_accuracy=sum(hits) FILTER (k <= 3) / sum(total) FILTER (k <= 3) * 100''')}
FROM (SELECT *, row_number() OVER (PARTITION BY sym ORDER BY fold DESC) AS k FROM foldhits) GROUP BY 1"""))
def _(t):
    df = fold_hits(t).withColumn("k", F.row_number().over(
        Window.partitionBy("sym").orderBy(c("fold").desc())))
    recent = lambda x: F.sum(F.when(c("k") <= 3, c(x)))
    return rounded(df.groupBy("sym").agg(
        F.count(F.lit(1)).alias("total_folds"), F.sum("total").alias("total_predictions"),
        F.sum("hits").alias("total_hits"), F.min("test_start").alias("test_start"),
        F.max("test_end").alias("test_end"),
        (F.sum("hits") / F.sum("total") * 100).alias("overall_accuracy"),
        (recent("hits") / recent("total") * 100).alias("recent_accuracy")))


@query("AGG-26_hit_rate_by_subset", sql("hits", f"""SELECT sym, count(*) AS n, count(*) FILTER (tradeable) AS n_tradeable,
  {r('''all_pct=avg(CAST(is_hit AS INTEGER)) * 100; tradeable_pct=coalesce(avg(CAST(is_hit AS INTEGER)) FILTER (tradeable) * 100, 0);
  model_a_pct=avg(CAST(dir_a = actual_dir AS INTEGER)) * 100; model_b_pct=avg(CAST(dir_b = actual_dir AS INTEGER)) * 100''')}
FROM hits GROUP BY 1"""))
def _(t):
    pct = lambda cond: F.avg(cond.cast("double")) * 100
    return rounded(hits(t).groupBy("sym").agg(
        F.count(F.lit(1)).alias("n"), F.count_if("tradeable").alias("n_tradeable"),
        pct(c("is_hit")).alias("all_pct"),
        F.coalesce(F.avg(F.when(c("tradeable"), c("is_hit").cast("double"))) * 100, F.lit(0.0))
        .alias("tradeable_pct"), pct(c("dir_a") == c("actual_dir")).alias("model_a_pct"),
        pct(c("dir_b") == c("actual_dir")).alias("model_b_pct")))


@query("AGG-27_unweighted_and_pooled", sql("foldhits", f"""SELECT {r('''unweighted=avg(acc);
  pooled=sum(h) / sum(n) * 100''')} FROM (SELECT sym, sum(hits) AS h, sum(total) AS n, sum(hits) / sum(total) * 100 AS acc
  FROM foldhits GROUP BY 1)"""))
def _(t):
    per = fold_hits(t).groupBy("sym").agg(F.sum("hits").alias("h"), F.sum("total").alias("n"))
    return rounded(per.agg(F.avg(c("h") / c("n") * 100).alias("unweighted"),
                           (F.sum("h") / F.sum("n") * 100).alias("pooled")))


# ---- SET ------------------------------------------------------------------------------------
@query("SET-1_union_of_frames", sql("bars wbars", f"""SELECT 'brand' AS kind, sym, date, {r('close', 9)} FROM bars
UNION ALL SELECT 'supplier', sym, date, round(close, 9) + 0.0 FROM wbars"""))
def _(t):
    return rounded(t.bars.select(F.lit("brand").alias("kind"), "sym", "date", "close").unionByName(
        t.wide_bars.select(F.lit("supplier").alias("kind"), "sym", "date", "close")), 9)


@query("SET-2_dates_with_enough_names", sql("bars", "SELECT date, count(*) AS n FROM bars GROUP BY 1 HAVING count(*) >= 25"))
def _(t):
    return t.bars.groupBy("date").agg(F.count(F.lit(1)).alias("n")).where("n >= 25")


@query("SET-3_common_periods", sql("", """SELECT DISTINCT p_brand AS sym, CAST(year(l_shipdate) AS INTEGER) AS fy
  FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_returnflag = 'R' INTERSECT
  SELECT DISTINCT p_brand, CAST(year(l_shipdate) AS INTEGER) FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_linestatus = 'O'"""))
def _(t):
    part = t.table("part").select("p_partkey", c("p_brand").alias("sym"))
    li = t.table("lineitem").withColumn("fy", F.year("l_shipdate"))
    side = lambda cond: (li.where(cond).join(part, c("l_partkey") == c("p_partkey"))
                         .select("sym", "fy"))
    return side(c("l_returnflag") == "R").intersect(side(c("l_linestatus") == "O"))


@query("SET-4_row_difference", sql("bars bench", """SELECT s.sym, b.date FROM (SELECT DISTINCT sym FROM bars) s, bench b
EXCEPT SELECT sym, date FROM bars"""))
def _(t):
    from ..operators.quality import missing_bars
    return missing_bars(t.bars, t.bench)


@query("SET-5_distinct_keys", sql("bars", """SELECT DISTINCT sym, CAST(date_trunc('month', date) AS DATE) AS month FROM bars"""))
def _(t):
    return t.bars.select("sym", F.trunc("date", "month").alias("month")).distinct()
