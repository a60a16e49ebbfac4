"""Metric edge cases, context operators, running totals and plan shape."""

import datetime as dt
import glob

import numpy as np
import pytest
from pyspark.sql import functions as F

from barloom import session
from barloom.functions import windows as w
from barloom.operators import backtest as bt
from barloom.operators import crosssection as xs
from barloom.operators import joins, longseries, macro, metrics
from barloom.plans import evaluation, factors

D = dt.date


def test_classification_without_positives(spark):
    df = spark.createDataFrame([("a", 0, 0), ("a", 0, 1), ("b", 1, 1), ("b", 1, 0)], "k string, pred int, label int")
    got = {r.k: r for r in metrics.classification(df, ["k"]).collect()}
    assert (got["a"].precision, got["a"].recall, got["a"].f1) == (0.0, 0.0, 0.0)
    assert (got["b"].precision, got["b"].recall) == (0.5, 1.0) and got["b"].f1 == pytest.approx(2 / 3)


def test_trading_without_trades(spark):
    df = spark.createDataFrame([("a", 0, 0.0)], "k string, side int, net double")
    r = metrics.trading(df, ["k"]).first()
    assert (r.coverage, r.trades, r.trade_win_rate, r.avg_trade_ret_pct) == (0.0, 0, 0.0, 0.0)


def test_hit_statistics(spark):
    rows = [(D(2024, 1, 1), float(i), 0.1 if i % 3 else -0.2) for i in range(10)]
    df = spark.createDataFrame(rows, "date date, score double, fwd_excess double")
    r = metrics.hit_statistics(df, F.col("score") >= 8, F.col("score") <= 1).first()
    assert (r.hit_rate, r.n_picks, r.n_rebalances, r.beats_base) == (50.0, 2, 1, False)
    assert r.base_rate == 60.0 and r.spread_pp == pytest.approx(0.0)
    assert r.se == pytest.approx(100 * 0.5 / 2 ** 0.5)


def test_score_rotation(spark):
    days = [D(2024, 1, 1) + dt.timedelta(i) for i in range(9)]
    rows = [(f"S{k}", d, 100.0 + k * i, float(k)) for k in range(6) for i, d in enumerate(days)]
    df = spark.createDataFrame(rows, "sym string, date date, close double, score double")
    got = bt.score_rotation(df, k=2, step=4).orderBy("date").collect()
    assert [r.date for r in got] == [days[0], days[4]]
    first = np.mean([(100.0 + 4 * k) / 100 - 1 for k in (4, 5)]) * 100
    assert got[0].top_ret == pytest.approx(first) and got[0].portfolio == pytest.approx(1e5 * (1 + first / 100))
    out = bt.rotation_summary(bt.score_rotation(df, k=2, step=4), 4).first()
    assert out.rebalance_count == 2 and out.max_drawdown == 0.0 and out.alpha > 0


def test_running_total_of_a_hot_series(spark):
    rows = [("HOT" if i % 4 else "COLD", dt.datetime(2024, 1, 1) + dt.timedelta(hours=i), i) for i in range(400)]
    df = spark.createDataFrame(rows, "sym string, ts timestamp, x bigint")
    got = {(r.sym, r.x): r.t for r in longseries.running_total(df, F.col("x"), "t", order="ts", unit="day").collect()}
    seen = {"HOT": 0, "COLD": 0}
    for sym, _, x in rows:
        seen[sym] += x
        assert got[sym, x] == seen[sym]


def test_macro_snapshot_counts_both_ends(spark):
    rows = [("M", D(2024, 1, 1) + dt.timedelta(i), float(100 + i)) for i in range(25)]
    r = macro.macro_snapshot(spark.createDataFrame(rows, "sym string, date date, close double")).first()
    assert r.ret14d == pytest.approx((124 / 111 - 1) * 100) and r.ret5d == pytest.approx((124 / 120 - 1) * 100)
    short = macro.macro_snapshot(spark.createDataFrame(rows[:3], "sym string, date date, close double")).first()
    assert (short.ret14d, short.vol20) == (0.0, 0.0)


def test_context_prefixes(spark):
    bars = spark.createDataFrame([("A", D(2024, 1, i), 1.0) for i in range(1, 9)], "sym string, date date, close double")
    ctx = spark.createDataFrame([(s, D(2024, 1, i), float(i)) for s in ("^IX", "U-R=X") for i in range(1, 9)],
                                "symbol string, date date, close double")
    df = joins.context_features(bars, ctx, ["^IX", "U-R=X"], lags=(1,))
    assert {"IX_ret_1", "U_RX_ret_1", "IX_vol_20"} <= set(df.columns)
    assert df.where(F.col("date") == F.lit(D(2024, 1, 3))).first().IX_ret_1 == pytest.approx(0.5)


def test_constant_scores_compare(spark):
    rows = [("m", 1, D(2024, 1, d), f"S{k}", 0.5, int(k % 2), 0.01 * k) for d in range(1, 25) for k in range(6)]
    df = spark.createDataFrame(rows, "model string, fold int, date date, sym string, proba double, label int, fwd_excess double")
    r = evaluation.compare_models(df, 10, 5, 10, 10_000).first()
    assert r.auc == 0.5 and r.n_rebalances == 3 and r.n_predictions == 144


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_no_cross_join_and_no_single_task_in_feature_plans(panel):
    bench = panel.groupBy("date").agg(F.avg("close").alias("bench"))
    fund = panel.groupBy("sym").agg(F.lit(D(2021, 12, 31)).alias("fy_end"), F.lit(D(2022, 3, 31)).alias("avail_date"),
                                    F.lit(1.0).alias("eps"), F.lit(0.1).alias("roe"), F.lit(0.2).alias("earn_growth"),
                                    F.lit(0.3).alias("profit_margin"))
    text = plan_of(factors.factor_table(panel, bench, fund, horizon=10, bound=6))
    for bad in ("CartesianProduct", "BroadcastNestedLoopJoin", "SinglePartition"):
        assert bad not in text
    split = plan_of(xs.rank_pct(panel, {"r": "close"}))
    for bad in ("CartesianProduct", "BroadcastNestedLoopJoin", "SinglePartition"):
        assert bad not in split


def test_many_names_are_ranked_apart_from_their_rows(spark, panel):
    """The narrow factor table has the rows of the wide one, repeated and missing keys too, and sorts no whole rows by date."""
    odd = panel.where("sym < 'CCC.NS'").limit(40).unionByName(panel.limit(9).withColumn("close", F.lit(None).cast("double")))
    rows = panel.unionByName(odd).unionByName(panel.limit(30).withColumn("date", F.lit(None).cast("date")))
    bench = panel.groupBy("date").agg(F.avg("close").alias("bench"))
    fund = panel.groupBy("sym").agg(F.lit(D(2021, 12, 31)).alias("fy_end"), F.lit(D(2022, 3, 31)).alias("avail_date"),
                                    F.lit(1.0).alias("eps"), F.lit(0.1).alias("roe"), F.lit(0.2).alias("earn_growth"),
                                    F.lit(0.3).alias("profit_margin"))
    features = factors.stored(rows, "odd")
    wide = factors.factor_table(features, bench, fund, horizon=10, bound=6)
    table = factors.factor_table(features, bench, fund, horizon=10, bound=6, narrow=True)
    assert table.columns == wide.columns and table.count() == wide.count()
    ranks = [x for x in wide.columns if x.startswith(("rank_", "score_"))]
    keys = F.coalesce("date", F.lit(D(1970, 1, 1))).alias("date")
    both = [sorted(map(repr, df.where("rank_deliv_pct IS NOT NULL").select("sym", keys, "deliv_pct", "rank_deliv_pct").collect()))
            for df in (wide, table)]
    assert both[0] and both[0] == both[1]
    plain = [sorted(map(repr, factors.factor_table(panel, bench, fund, horizon=10, bound=6, narrow=n).select("sym", "date", *ranks)
                        .collect())) for n in (False, True)]
    assert plain[0] == plain[1]
    windows = lambda df: df._jdf.queryExecution().optimizedPlan().toString().count("Window [")
    assert windows(wide) >= 13 and windows(table) <= 3


def test_many_names_move_once_to_their_date(spark, panel):
    """The narrow factor table stores nothing, moves rows once by date, without the columns it can build again, and keeps no row numbers."""
    bench = panel.groupBy("date").agg(F.avg("close").alias("bench"))
    fund = panel.groupBy("sym").agg(F.lit(D(2021, 12, 31)).alias("fy_end"), F.lit(D(2022, 3, 31)).alias("avail_date"),
                                    F.lit(1.0).alias("eps"), F.lit(0.1).alias("roe"), F.lit(0.2).alias("earn_growth"),
                                    F.lit(0.3).alias("profit_margin"))
    kept = f"{session.shared_home(spark)}/barloom/factor-rows-*"
    before = set(glob.glob(kept))
    table = factors.factor_table(panel, bench, fund, horizon=10, bound=6, narrow=True)
    assert set(glob.glob(kept)) == before
    text = plan_of(table)
    lines = text.split("\n")
    by_date = [i for i, x in enumerate(lines) if "Exchange hashpartitioning(date" in x and "REPARTITION_BY_COL" in x]
    moved = lines[by_date[0] + 1]
    assert len(by_date) == 1 and "_row" not in text and "Project" in moved
    assert text.count("Exchange hashpartitioning(date") == 2 and "SortMergeJoin" not in text  # the rows, the benchmark's sums
    assert not any(x in moved for x in ("rev#", "deliv_x_ret", "earn_yield")) and "deliv_chg20" in moved


def test_top_k_is_cut_before_the_shuffle(panel):
    assert "WindowGroupLimit" in plan_of(xs.top_k(panel, "close", 3))


def test_filters_and_columns_reach_the_scan(spark):
    from barloom.sources import tables
    df = tables.table(spark, "/root/testdata/sf0.001", "lineitem").where("l_quantity > 40").select("l_suppkey")
    text = plan_of(df)
    assert "GreaterThan(l_quantity,40.0)" in text and "ReadSchema: struct<l_suppkey:bigint,l_quantity:double>" in text


def test_shifted_rows_do_not_cross_symbols(panel):
    df = panel.withColumn("p", w.shift("close", 1))
    assert df.where("p is null").count() == 6
