"""Point-in-time joins, labels, ledgers and schedules against brute force."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from barloom.operators import backtest as bt
from barloom.operators import joins, labels, ledger

D = dt.date


def test_asof_join_with_twins_and_unknown_symbols(spark):
    daily = spark.createDataFrame(
        [("A", D(2024, 1, d), 10.0) for d in (1, 5, 9)] + [("Z", D(2024, 1, 5), 1.0)],
        "sym string, date date, close double")
    fund = spark.createDataFrame(
        [("A", D(2022, 12, 31), D(2024, 1, 5), 1.0, 0.1, None, 0.2),
         ("A", D(2023, 12, 31), D(2024, 1, 5), 2.0, 0.3, 0.5, 0.4)],
        "sym string, fy_end date, avail_date date, eps double, roe double, earn_growth double, "
        "profit_margin double")
    for join in (joins.attach_fundamentals, joins.attach_by_interval):
        rows = {r.date: r.eps for r in join(daily, fund).collect()}
        assert rows == {D(2024, 1, 1): None, D(2024, 1, 5): 2.0, D(2024, 1, 9): 2.0}


def test_two_benchmark_calendars_differ(spark):
    days = [D(2024, 1, d) for d in range(1, 7)]
    bench = spark.createDataFrame([(d, float(10 + i)) for i, d in enumerate(days)],
                                  "date date, bench double")
    bars = spark.createDataFrame([("A", d, float(i + 1)) for i, d in enumerate(days) if i != 1],
                                 "sym string, date date, close double")
    a = joins.excess_by_benchmark_calendar(bars, bench, 1).where(F.col("date") == days[0]).first()
    b = joins.excess_by_symbol_calendar(bars, bench, 1).where(F.col("date") == days[0]).first()
    assert a.bench_fwd == pytest.approx(11 / 10 - 1) and b.bench_fwd == pytest.approx(12 / 10 - 1)


def test_triple_barrier(panel, panel_pd):
    got = {(r.sym, r.date): r.triple_label for r in labels.triple_barrier(panel).select(
        "sym", "date", "triple_label").collect()}
    for sym, g in panel_pd.sort_values("date").groupby("sym"):
        c, h, lo = g.close.values, g.high.values, g.low.values
        for i, day in enumerate(g.date):
            want = 2
            for j in range(i + 1, min(i + 10, len(g) - 1) + 1):
                if h[j] >= c[i] * 1.03:
                    want = 1
                    break
                if lo[j] <= c[i] * 0.98:
                    want = 0
                    break
            assert got[sym, day] == want


def test_labels_drop_rows_without_future(panel):
    tail = labels.majority(panel).groupBy("sym").agg(F.count("*").alias("n")).collect()
    full = {r["sym"]: r["count"] for r in panel.groupBy("sym").count().collect()}
    assert all(r.n == full[r["sym"]] - 20 for r in tail)


def test_greedy_and_fixed_schedules(spark):
    sizes = [3, 1, 3, 3, 1, 1, 3, 3, 3, 3, 1, 3]
    rows = [(D(2024, 1, i + 1), f"s{k}") for i, n in enumerate(sizes) for k in range(n)]
    df = spark.createDataFrame(rows, "date date, sym string")
    want, i = [], 0
    while i < len(sizes):
        if sizes[i] < 3:
            i += 1
            continue
        want.append(i + 1)
        i += 3
    assert sorted(r.date.day for r in bt.greedy_schedule(df, 3, 3).collect()) == want
    fixed = [i + 1 for i in range(0, len(sizes), 3) if sizes[i] >= 3]
    assert sorted(r.date.day for r in bt.fixed_schedule(df, 3, 3).collect()) == fixed


@pytest.mark.parametrize("step,block", [(1, 7), (3, 7), (10, 16), (10, 4096), (40, 16)])
def test_greedy_schedule_over_blocks(spark, step, block):
    """Walks over many blocks, several strategies (one without a name, one without a thick date)."""
    rng = np.random.default_rng(step)
    days = [D(2020, 1, 1) + dt.timedelta(int(x)) for x in np.sort(rng.choice(1500, 300, replace=False))]
    rows, want = [(None, None)], set()
    for name, least in (("a", 0), ("b", 0), (None, 0), ("thin", 2)):
        free = 0
        for i, day in enumerate(days):
            n = 1 if least else int(rng.integers(1, 4))
            rows += [(name, day)] * n
            if i >= free and n >= 2:
                want.add((name, day))
                free = i + step
    df = spark.createDataFrame(rows, "fold string, date date").repartition(5)
    got = [(r.fold, r.date) for r in bt.greedy_schedule(df, step, 2, by=["fold"], block=block).collect()]
    assert set(got) == want and len(got) == len(want)
    assert bt.greedy_schedule(df.limit(0), step, 2).count() == 0


def test_threshold_search(spark):
    rng = np.random.default_rng(9)
    p, r = rng.uniform(0, 1, 200), rng.normal(0, 0.01, 200)
    y = (r > 0).astype(int)
    df = spark.createDataFrame([("k", float(a), float(b), int(c)) for a, b, c in zip(p, r, y)],
                               "key string, proba double, fwd_ret double, label int")
    best, want = -np.inf, (0.5, 0.0, 0)
    for thr in [round(0.5 + 0.01 * i, 2) for i in range(46)]:
        said = p >= thr
        if said.mean() < 0.05 or said.sum() < 5:
            continue
        prec = y[said].mean()
        side = np.where(said, 1, np.where(p <= 1 - thr, -1, 0))
        total = np.prod(1 + side * r - np.where(side != 0, 0.001, 0)) - 1
        pts = 10 + said.mean() + total if prec >= 0.55 else prec + 0.05 * said.mean() + total
        if round(pts, 9) > best:
            best, want = round(pts, 9), (thr, prec, int(said.sum()))
    got = bt.threshold_search(df, ["key"]).first()
    assert (got.threshold, got.trades) == (want[0], want[2])
    assert got.precision == pytest.approx(want[1])


def test_threshold_search_without_candidates(spark):
    df = spark.createDataFrame([("k", 0.1, 0.0, 0)], "key string, proba double, fwd_ret double, label int")
    assert bt.threshold_search(df, ["key"]).first().threshold == 0.50


def test_first_exit_near_and_late(spark):
    days = [D(2024, 1, 1) + dt.timedelta(i) for i in range(30)]
    flat = [(100.5, 99.5, 100.0)] * 30
    late = flat[:20] + [(107.0, 99.0, 100.0)] + flat[:9]
    both = flat[:2] + [(107.0, 96.0, 100.0)] + flat[:27]
    bars = [(s, d, *b) for s, bs in (("LATE", late), ("BOTH", both), ("FLAT", flat)) for d, b in zip(days, bs)]
    bars += [("NEW", days[29], 100.2, 99.9, 100.0)]
    df = spark.createDataFrame(bars, "sym string, date date, high double, low double, close double")
    pos = spark.createDataFrame([(s, days[0] if s != "NEW" else days[29], "UP", 100.0, 10) for s in ("LATE", "BOTH", "FLAT", "NEW")],
                                "sym string, entry_date date, direction string, entry_price double, shares bigint")
    got = {r.sym: (r.status, r.exit_price, r.exit_date) for r in
           ledger.exits(ledger.with_levels(pos), df, near=5).collect()}
    assert got["LATE"] == ("CLOSED_TP", 106.0, days[20])
    assert got["BOTH"] == ("CLOSED_SL", 97.0, days[2])
    assert got["FLAT"] == ("CLOSED_EXPIRY", 100.0, days[29])
    assert got["NEW"][0] == "OPEN"


@pytest.mark.parametrize("near", [2, 16])
def test_first_exits_of_many_positions_on_one_symbol(spark, near):
    """10^5 positions on one symbol, with barriers from tight to never reached, against NumPy."""
    rng = np.random.default_rng(4)
    n, m = 3000, 100_000 if near == 16 else 2000
    close = np.round(100 * np.exp(np.cumsum(rng.normal(0, 0.01, n))), 2)
    high, low = close + np.round(rng.uniform(0, 1, n), 2), close - np.round(rng.uniform(0, 1, n), 2)
    days = [D(2015, 1, 1) + dt.timedelta(i) for i in range(n)]
    df = spark.createDataFrame(pd.DataFrame({"sym": "HOT", "date": days, "high": high, "low": low, "close": close}),
                               "sym string, date date, high double, low double, close double")
    at, up, width = rng.integers(0, n, m), rng.random(m) < 0.5, rng.choice([0.001, 0.05, 0.5, 50.0], m)
    sign = np.where(up, 1, -1)
    stop, target = close[at] * (1 - sign * width), close[at] * (1 + sign * width)
    pos = spark.createDataFrame(pd.DataFrame({
        "sym": "HOT", "entry_date": [days[i] for i in at], "direction": np.where(up, "UP", "DOWN"), "entry_price": close[at],
        "nth": np.arange(m), "stop_loss": stop, "target": target}),
        "sym string, entry_date date, direction string, entry_price double, nth long, stop_loss double, target double")
    out = ledger.exits(pos, df, near=near)
    assert out.columns == [*pos.columns, "status", "exit_price", "exit_date", "bars", "last_close"]
    got = out.toPandas().sort_values("nth")
    assert len(got) == m
    day = {d: i for i, d in enumerate(days)}
    exit_at = [day[d] if d is not None else -1 for d in got.exit_date]
    for k, (status, price, end, bars) in enumerate(zip(got.status, got.exit_price, exit_at, got.bars)):
        hi, lo = high[at[k]:], low[at[k]:]
        stopped = lo <= stop[k] if up[k] else hi >= stop[k]
        hit = stopped | (hi >= target[k] if up[k] else lo <= target[k])
        first = int(hit.argmax())
        assert bars == n - at[k]
        if hit[first]:
            want = ("CLOSED_SL", stop[k], at[k] + first) if stopped[first] else ("CLOSED_TP", target[k], at[k] + first)
            assert (status, price, end) == want
        elif bars >= 10:
            assert (status, price, end) == ("CLOSED_EXPIRY", close[-1], n - 1)
        else:
            assert status == "OPEN" and end == -1


def test_position_size(spark):
    df = spark.createDataFrame([(50.0, 100.0), (55.0, 100.0), (100.0, 100.0), (80.0, 0.0)],
                               "confidence double, price double").withColumn("capital", F.lit(1e6))
    assert [r.s for r in df.select(ledger.shares().alias("s")).collect()] == [0, 100, 1000, 0]


def test_performance_report(spark):
    rows = [("A", 100.0, 1.0, D(2024, 1, 3), 2), ("A", -300.0, -3.0, D(2024, 1, 5), 4), ("B", 50.0, 0.5, D(2024, 1, 9), 3)]
    df = spark.createDataFrame(rows, "sym string, pnl double, pnl_pct double, exit_date date, hold_days int")
    r = ledger.performance(df, 10_000.0).first()
    assert (r.total_trades, r.winning_trades, r.total_pnl) == (3, 2, -150.0)
    assert r.max_drawdown == round(300 / 10_100 * 100, 2)


def test_missing_history_gives_missing_labels(spark):
    df = spark.createDataFrame([("A", D(2024, 1, 1), 1.0)], "sym string, date date, close double")
    assert labels.target_lags(df).count() == 0
    assert pd.isna(labels.forward_returns(df, [5]).first().fwd_ret_5)
