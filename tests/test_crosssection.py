"""Ranks, quantiles, buckets and correlations: both paths against pandas, with ties and gaps."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from barloom.operators import crosssection as xs
from barloom.operators import metrics

BOUNDS = [1000, None]


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(3)
    rows = []
    for d in range(6):
        n = 400 if d == 0 else 15 + d          # one date holds most rows
        x = rng.integers(0, 40, n).astype(float)
        y = rng.normal(size=n).round(2)
        for i in range(n):
            rows.append((f"S{i:04d}", d, None if i % 11 == 3 else float(x[i]), float(y[i])))
    return pd.DataFrame(rows, columns=["sym", "date", "x", "y"])


@pytest.fixture(scope="module")
def frame(spark, data):
    rows = [tuple(None if isinstance(v, float) and np.isnan(v) else v for v in r)
            for r in data.itertuples(index=False)]
    return spark.createDataFrame(rows, "sym string, date int, x double, y double").cache()


def ordered(df):
    return df.toPandas().sort_values(["date", "sym"]).reset_index(drop=True)


@pytest.mark.parametrize("bound", BOUNDS)
def test_rank_pct(frame, data, bound):
    got = ordered(xs.rank_pct(frame, {"rx": "x", "ry": "y"}, bound=bound, range_cells=4))
    want = data.sort_values(["date", "sym"]).reset_index(drop=True)
    for col in ("x", "y"):
        np.testing.assert_allclose(got["r" + col].astype(float),
                                   want.groupby("date")[col].rank(pct=True), equal_nan=True)


@pytest.mark.parametrize("bound", BOUNDS)
def test_ordinal_breaks_ties_by_symbol(frame, data, bound):
    known = frame.where("x is not null")
    got = ordered(xs.ordinal(known, "x", bound=bound, range_cells=4))
    want = data.dropna().sort_values(["date", "x", "sym"], ascending=[True, False, True])
    want["rank"] = want.groupby("date").cumcount() + 1
    want = want.sort_values(["date", "sym"]).reset_index(drop=True)
    assert got["rank"].tolist() == want["rank"].tolist()


@pytest.mark.parametrize("bound", BOUNDS)
def test_quantile_cut_matches_equal_frequency_cut(frame, data, bound):
    got = ordered(xs.quantile_cut(frame, "x", bound=bound, range_cells=4))
    want = data.sort_values(["date", "sym"]).reset_index(drop=True)
    want["b"] = want.groupby("date")["x"].transform(
        lambda v: pd.qcut(v, 5, labels=False, duplicates="drop"))
    np.testing.assert_allclose(got["bucket"].astype(float), want["b"], equal_nan=True)


@pytest.mark.parametrize("bound", BOUNDS)
def test_quantiles(frame, data, bound):
    got = xs.quantile_table(frame, "y", (0.0, 0.2, 0.8, 1.0), bound=bound, range_cells=4).orderBy("date")
    want = data.groupby("date")["y"].quantile([0.0, 0.2, 0.8, 1.0]).unstack()
    np.testing.assert_allclose(np.array([r.q for r in got.collect()]), want.values)


@pytest.mark.parametrize("bound", BOUNDS)
def test_information_coefficient(frame, data, bound):
    got = xs.information_coefficient(frame, ["x"], "y", bound=bound, range_cells=4).orderBy("date")
    want = []
    for _, g in data.dropna().groupby("date"):
        rx, ry = g.x.rank(), g.y.rank()
        want.append(np.corrcoef(rx, ry)[0, 1])
    np.testing.assert_allclose([r.ic for r in got.collect()], want)


@pytest.mark.parametrize("bound", BOUNDS)
def test_zscore_is_zero_without_spread(spark, bound):
    df = spark.createDataFrame([("a", 1, 2.0), ("b", 1, 2.0), ("a", 2, 1.0), ("b", 2, 3.0),
                                ("c", 2, None)], "sym string, date int, x double")
    got = {(r.sym, r.date): r.x for r in xs.zscore(df, ["x"], bound=bound).collect()}
    assert got["a", 1] == got["b", 1] == got["c", 2] == 0.0
    assert abs(got["a", 2] + 2 ** -0.5) < 1e-12


def test_constant_factor_has_no_correlation(spark):
    df = spark.createDataFrame([(f"s{i}", 1, 1.0, float(i)) for i in range(10)],
                               "sym string, date int, x double, y double")
    assert xs.information_coefficient(df, ["x"], "y", bound=100).count() == 0


@pytest.mark.parametrize("bound", BOUNDS)
def test_auc_with_ties(spark, bound):
    rng = np.random.default_rng(5)
    score, label = rng.integers(0, 20, 300) / 20, rng.integers(0, 2, 300)
    df = spark.createDataFrame([(float(s), int(y)) for s, y in zip(score, label)],
                               "proba double, label int")
    pos, neg = score[label == 1], score[label == 0]
    want = np.mean([(p > neg).mean() + (p == neg).mean() / 2 for p in pos])
    assert abs(metrics.auc(df, bound=bound).first().auc - want) < 1e-12


def test_auc_of_one_class_is_missing(spark):
    df = spark.createDataFrame([(0.1, 1), (0.4, 1)], "proba double, label int")
    assert metrics.auc(df, bound=10).first().auc is None


def test_top_k_and_fifths(frame, data):
    got = ordered(xs.top_k(frame, "x", 3))
    want = (data.dropna().sort_values(["date", "x", "sym"], ascending=[True, False, True])
            .groupby("date").head(3))
    assert set(zip(got.sym, got.date)) == set(zip(want.sym, want.date))
    flags = metrics.fifths(frame.where("x is not null"), "x", bound=1000).groupBy("date").agg(
        F.count_if("is_top").alias("t"), F.count_if("is_bottom").alias("b"), F.count("*").alias("n"))
    for r in flags.collect():
        assert r.t == r.b == max(r.n // 5, 1)


def test_buckets_on_tiny_group(spark):
    df = spark.createDataFrame([("a", 1, 1.0)], "sym string, date int, x double")
    assert xs.quantile_cut(df, "x", bound=5).first().bucket == 0


@pytest.mark.parametrize("method", ["spearman", "pearson"])
def test_mean_factor_ic(frame, data, method):
    from barloom.api import factor_ic
    got = factor_ic(frame, "x", "y", method, bound=1000).first()
    want = data.dropna().groupby("date").apply(
        lambda g: np.corrcoef(*((g.x.rank(), g.y.rank()) if method == "spearman" else (g.x, g.y)))[0, 1],
        include_groups=False)
    assert got.n_dates == len(want) and got.mean_ic == pytest.approx(want.mean())
    with pytest.raises(ValueError):
        factor_ic(frame, "x", "y", "kendall")


@pytest.fixture(scope="module")
def awkward(spark):
    """Missing keys, scores and groups, repeated keys, NaN and ties."""
    nan = float("nan")
    rows = [("a", 1, 1.0, 2.0), ("a", 1, 1.0, 2.0), ("a", 1, 3.0, 1.0), ("b", 1, None, 4.0), ("c", 1, nan, 5.0), (None, 1, 1.0, 0.5),
            ("d", 1, -0.0, None), ("e", 1, 0.0, 3.0), ("f", 1, nan, -1.0), ("g", 1, None, None), ("a", None, 2.0, 1.0), ("b", None, 1.0, 2.0),
            (None, None, 3.0, 3.0), ("h", 2, None, 1.0), ("i", 2, None, 2.0)] + [(f"s{i}", 3, float(i % 5), float(i)) for i in range(30)]
    return spark.createDataFrame(rows, "sym string, date int, x double, y double").cache()


@pytest.mark.parametrize("run", [
    lambda df, b: xs.rank_pct(df, {"rx": "x", "ry": "y"}, bound=b, range_cells=3),
    lambda df, b: xs.ordinal(df, "x", bound=b, range_cells=3),
    lambda df, b: xs.with_quantiles(df.where("NOT isnan(x)"), "x", {"hi": 0.8, "lo": 0.2}, bound=b, range_cells=3),
    lambda df, b: xs.quantile_cut(df.where("NOT isnan(x)"), "x", bound=b, range_cells=3),
    lambda df, b: xs.zscore(df, ["y"], bound=b),
    lambda df, b: xs.information_coefficient(df.where("NOT isnan(x)"), ["x"], "y", min_names=2, bound=b, range_cells=3)])
def test_both_paths_give_the_same_rows(awkward, run):
    def rows(bound):
        return sorted(repr([round(v, 9) if isinstance(v, float) else v for v in r]) for r in run(awkward, bound).collect())
    assert rows(100) == rows(None) and len(rows(None)) > 2


def test_narrow_ranks_equal_window_ranks(spark):
    """Ties, NaN, both zeros, infinities, missing values and groups, whole numbers; composites of rounded sums too."""
    rng = np.random.default_rng(5)
    nan, inf = float("nan"), float("inf")
    odd = [None, nan, nan, 0.0, -0.0, inf, -inf, 1.0, None]
    rows = [(None if d == 3 else d, i, odd[i % 9] if i < 27 else float(rng.integers(0, 30)) / 7,
             None if d == 2 else float(rng.normal()), float(rng.normal()), None if i % 5 == 0 else int(rng.integers(0, 9)))
            for d in range(4) for i in range(157)] + [(4, 0, 1.0, None, nan, None)]
    df = spark.createDataFrame(rows, "date int, i int, a double, b double, x double, k int")
    ranks = {"rank_a": "a", "rank_b": "b", "rank_x": "x", "rank_k": "k"}
    formulas = {"s": (xs.mean_mr, ("rank_a", "rank_x")), "t": (xs.mean_fund3, ("rank_b", "rank_k", "rank_x"))}
    got = xs.narrow_ranks(df, ranks, "date", formulas)
    want = xs.rank_pct(df, ranks, bound=1000).withColumns({
        "s": xs.composite_mr("rank_a", "rank_x"), "t": xs.composite_fund3("rank_b", "rank_k", "rank_x")})
    want = xs.rank_pct(want, {"rank_s": "s", "rank_t": "t"}, bound=1000)
    assert got.columns == want.columns and got.dtypes == want.dtypes
    assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))


def test_half_up_rounds_as_spark(spark):
    rng = np.random.default_rng(6)
    x = np.concatenate([rng.random(2000), -rng.random(50), rng.integers(0, 10 ** 13, 500) / 1e13,
                        (rng.integers(0, 10 ** 6, 200) * 10 + 5) / 1e13, [0.0, 0.5, 1.0, 4 / 3, np.nan, -1e-14]])
    for x in (x, np.append(x, [700.25, np.inf])):
        rows = spark.createDataFrame([(i, float(v)) for i, v in enumerate(x)], "i int, x double").coalesce(1)
        for digits in (12, 6, 1):
            want = [r[0] for r in rows.sortWithinPartitions("i").select(F.round("x", digits)).collect()]
            assert list(map(repr, xs.half_up(x, digits).tolist())) == list(map(repr, want))
