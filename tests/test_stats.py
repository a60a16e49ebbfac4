"""Significance tests: identities, degenerate input and calibration under overlap."""

import datetime as dt

import numpy as np
import pytest

from barloom.operators import stats


def series(spark, **named):
    day = dt.date(2000, 1, 1)
    rows = [(k, day + dt.timedelta(i), None if np.isnan(v) else float(v))
            for k, xs in named.items() for i, v in enumerate(xs)]
    return spark.createDataFrame(rows, "key string, date date, x double")


def hac(x, lags):
    x = np.asarray(x, float)
    x = x[~np.isnan(x)]
    n = len(x)
    lags = max(0, min(lags, n - 2))
    d = x - x.mean()
    var = d @ d / n + sum(2 * (1 - k / (lags + 1)) * (d[k:] @ d[:-k]) / n for k in range(1, lags + 1))
    return np.sqrt(var / n) if var > 0 else np.nan


def test_against_direct_formula(spark):
    rng = np.random.default_rng(0)
    a, b = rng.normal(size=120), np.convolve(rng.normal(size=90), np.ones(5), "valid")
    b[7] = np.nan
    got = {r.key: r for r in stats.mean_tests(series(spark, a=a, b=b), "key", "date", "x", 5).collect()}
    for key, x in (("a", a), ("b", b)):
        known = x[~np.isnan(x)]
        assert got[key].n == len(known)
        assert got[key].t_hac == pytest.approx(known.mean() / hac(x, 9))
        assert got[key].t_naive == pytest.approx(known.mean() / (known.std(ddof=1) / np.sqrt(len(known))))
        sub = known[::5]
        assert got[key].t_nonoverlap == pytest.approx(sub.mean() / (sub.std(ddof=1) / np.sqrt(len(sub))))
    rule = stats.newey_west(series(spark, a=a), "key", "date", "x").first()
    assert rule.lags == int(np.floor(4 * 1.2 ** (2 / 9))) and rule.hac_se == pytest.approx(hac(a, rule.lags))


def test_degenerate_series(spark):
    df = series(spark, one=[1.0], two=[2.0, 2.0], zeros=[0.0] * 50, gaps=[1.0, np.nan, 2.0, 3.0, np.nan, 4.0])
    got = {r.key: r for r in stats.mean_tests(df, "key", "date", "x", 2).collect()}
    for key in ("one", "two", "zeros"):
        assert got[key].t_naive is None and got[key].t_hac is None and got[key].t_nonoverlap is None
    assert got["gaps"].n == 4 and got["gaps"].n_effective == 2.0


def test_false_positive_rates_under_overlap(spark):
    rng = np.random.default_rng(7)
    sims = {f"s{i:03d}": np.convolve(rng.normal(size=409), np.ones(10), "valid") for i in range(120)}
    rows = stats.mean_tests(series(spark, **sims), "key", "date", "x", 10).collect()
    rate = lambda f: np.mean([abs(getattr(r, f) or 0) >= 1.96 for r in rows])
    assert rate("t_naive") > 0.35
    assert rate("t_nonoverlap") < 0.14
    assert rate("t_hac") < rate("t_naive") / 2
    assert 2 <= np.median([r.inflation for r in rows]) <= 5


def test_verdicts(spark):
    df = spark.createDataFrame([(None, 1.0), (2.7, 2.0), (2.0, 1.0), (1.7, 1.0), (0.3, 2.2)],
                               "t_nonoverlap double, t_hac double")
    rows = df.select(stats.verdict().alias("v"), stats.fragile().alias("f")).collect()
    assert [r.v for r in rows] == ["inconclusive", "significant p<0.01", "significant p<0.05",
                                   "marginal p<0.10", "NOT significant"]
    assert [r.f for r in rows] == [False, False, True, False, True]
