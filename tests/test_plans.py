"""Ranking, scores, splits and models."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from barloom.functions import indicators as ind
from barloom.functions import windows as w
from barloom.operators import learning as ml
from barloom.operators import scoring, splits
from barloom.plans import factors as plan
from barloom.plans import ranking as weekly

D = dt.date


def test_ranking_shows_what_it_scores(panel, panel_pd):
    rows = weekly.ranking(panel, bound=6).collect()
    newest = panel_pd.date.max()
    assert rows and all(r.as_of == newest for r in rows)
    for r in rows:
        c = panel_pd[panel_pd.sym == r.sym].sort_values("date").close.values
        assert r.ret20_pct == pytest.approx(round((c[-1] / c[-21] - 1) * 100, 1))
        assert r.mom_12_1_pct == pytest.approx(round((c[-22] / c[-253] - 1) * 100, 1))
    assert all(0 <= r.score <= 1 for r in rows)
    assert abs(np.mean([r.score for r in rows]) - 0.5) < 0.01
    assert sorted(r.rank for r in rows) == list(range(1, len(rows) + 1))
    ends = weekly.ends(weekly.ranking(panel, bound=6), 2).collect()
    assert [r.rank for r in ends if r.side == "bottom"] == [len(rows), len(rows) - 1]


def test_ranking_paths_agree(panel):
    a = weekly.ranking(panel, bound=6).orderBy("rank").collect()
    b = weekly.ranking(panel, bound=None).orderBy("rank").collect()
    assert a == b


def test_earnings_flag(spark, panel):
    newest = panel.agg(F.max("date")).first()[0]
    cal = spark.createDataFrame([("AAA.NS", newest - dt.timedelta(30)), ("BBB.NS", newest + dt.timedelta(5)),
                                 ("CCC.NS", newest + dt.timedelta(20))], "sym string, event_date date")
    flags = lambda lower: {r.sym for r in weekly.ranking(panel, cal, 6, lower=lower).where("earnings_soon").collect()}
    assert flags(False) <= {"AAA.NS", "BBB.NS"} and "CCC.NS" not in flags(False)
    assert flags(True) <= {"BBB.NS"}


def test_health_score_against_plain_rules(panel):
    rows = scoring.health_history(panel).limit(400).collect()
    for r in rows:
        s = 12 * (r.close > r.sma_20) + 13 * (r.sma_20 > r.sma_50) + 10 * (r.close > r.ema_20)
        s += 20 if 50 <= r.rsi <= 68 else 15 if 68 < r.rsi <= 75 else 10 if 40 <= r.rsi < 50 else 12 if r.rsi < 30 else 5
        s += 5 * (r.macd > r.macd_signal)
        s += 15 if r.ret_1m > 10 else 12 if r.ret_1m > 5 else 8 if r.ret_1m > 0 else max(0, 8 + r.ret_1m / 2)
        s += 10 if r.ret_long > 15 else 7 if r.ret_long > 5 else 4 if r.ret_long > 0 else 0
        s += 15 if r.vol_ratio >= 1.5 and r.close > r.prev_close else 10 if r.vol_ratio >= 1 else 5
        assert r.score == pytest.approx(min(max(s, 5), 100), abs=0.0501)


def test_decision_gate_cases(spark):
    cases = [(1.0, 60.0, 0.7, 0.0, "UP", True, "A+B CONFIRMED"), (1.0, 60.0, 0.7, -0.9, "UP", True, "WEAK CONFIRM"),
             (1.0, 52.0, 0.3, 0.0, "DOWN", True, "B OVERRIDE"), (1.0, 90.0, 0.3, 0.0, "UP", True, "A STRONG"),
             (1.0, 90.0, 0.48, -0.9, "UP", False, "NO TRADE"), (1.0, 50.0, 0.46, 0.0, "DOWN", False, "NO TRADE")]
    df = spark.createDataFrame([c[:4] + (i,) for i, c in enumerate(cases)],
                               "a_ret double, a_conf double, b_prob double, mood double, i int")
    for r in scoring.decision_gate(df).collect():
        assert (r.direction, r.tradeable, r.gate) == cases[r.i][4:]


def test_mood_is_neutral_without_history(panel):
    rows = scoring.mood(panel).where("bars < 20").select("score", "label").distinct().collect()
    assert [tuple(r) for r in rows] == [(0.0, "NEUTRAL")]


def test_walk_forward_folds_are_purged(panel):
    folds = splits.walk_forward_folds(panel, 2, 10, min_train=500).collect()
    assert folds and [f.fold for f in folds] == list(range(1, len(folds) + 1))
    for f in folds:
        assert f.test_start - f.train_end == dt.timedelta(15)
        assert f.n_train == panel.where(F.col("date") < F.lit(f.train_end)).count()
        assert f.n_test == panel.where(F.col("date").between(F.lit(f.test_start), F.lit(f.test_end))).count()


def test_sliding_and_expanding_windows(spark):
    df = spark.createDataFrame([("A", i) for i in range(23)], "sym string, date int")
    got = {}
    for r in splits.sliding_windows(df, 10, 4).collect():
        got.setdefault((r.fold, r.role), []).append(r.date)
    want, start, fold = {}, 10, 1
    while start + 4 <= 23:
        want[fold, "train"], want[fold, "test"] = list(range(start - 10, start)), list(range(start, start + 4))
        start, fold = start + 4, fold + 1
    assert {k: sorted(v) for k, v in got.items()} == want
    blocks = {}
    for r in splits.expanding_blocks(df, 3).collect():
        blocks.setdefault((r.split, r.role), []).append(r.date)
    assert sorted(blocks[1, "test"]) == list(range(8, 13)) and len(blocks[3, "train"]) == 18


def test_tail_split_has_a_floor(spark):
    df = spark.createDataFrame([("A", i) for i in range(60)] + [("B", i) for i in range(800)], "sym string, date int")
    got = {(r["sym"], r.role): r["count"] for r in splits.tail_split(df).groupBy("sym", "role").count().collect()}
    assert got["A", "validation"] == 30 and got["B", "validation"] == 100


def test_models_find_a_planted_signal(spark):
    rng = np.random.default_rng(2)
    days = [D(2020, 1, 1) + dt.timedelta(7 * i) for i in range(100)]
    rows = []
    for d in days:
        for k in range(12):
            x, z = rng.normal(), rng.normal()
            r = 0.02 * x + 0.01 * rng.normal()
            rows.append((f"S{k}", d, float(x), float(z), float(r), float(r), int(r > 0)))
    df = spark.createDataFrame(rows, "sym string, date date, x double, z double, fwd_ret double, fwd_excess double, label int")
    oos = ml.walk_forward(df, ["x", "z"], ml.logistic(), 6, min_train=200)
    report = ml.fold_report(oos, 10_000).collect()
    assert report and all(r.auc > 0.9 for r in report)
    imp = {r.feature: r.importance for r in ml.importances(df, ["x", "z"], [ml.forest(trees=5)]).collect()}
    assert imp["x"] > imp["z"]
    with pytest.raises(ValueError):
        ml.walk_forward(df, ["x", "z"], ml.logistic(), 6, min_train=10**6)


def test_signal_percentiles_and_bench(panel):
    bench = panel.groupBy("date").agg(F.avg("close").alias("bench"))
    data = plan.dataset(panel, bench, (5, 10), min_bars=300)
    table = plan.model_bench(data, (5, 10), bound=6).collect()
    assert len(table) == 6 * 4 * 2
    assert all((r.direction == "LONG") == (r.score_pctile >= 0.5) for r in table)


def test_feature_plan_has_one_series_shuffle(panel):
    df = ind.bollinger(ind.atr_family(ind.returns(plan.features(panel), (1, 5))))
    text = df.withColumn("f", w.forward("close", 5))._jdf.queryExecution().executedPlan().toString()
    assert text.count("Exchange hashpartitioning") == 1
