"""Calendar splits without overlap, and models that learn only from what was known."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from barloom.operators import boosting, learning as ml, splits

D = dt.date


@pytest.fixture(scope="module")
def data(spark):
    """Twelve symbols of different age; x says the direction, z is noise; labels span ten days."""
    rng = np.random.default_rng(2)
    rows = []
    for i in range(100):
        for k in range(12):
            if i < 3 * k:
                continue
            day, x = D(2020, 1, 1) + dt.timedelta(7 * i), rng.normal()
            r = 0.02 * x + 0.01 * rng.normal()
            rows.append((f"S{k}", day, float(x), float(rng.normal()), float(r), float(r), int(r > 0), day + dt.timedelta(10) if i < 98 else None))
    return spark.createDataFrame(rows, "sym string, date date, x double, z double, fwd_ret double, fwd_excess double, label int, label_end date").cache()


@pytest.mark.parametrize("both", [False, True])
def test_no_label_of_a_training_row_meets_a_test_block_or_the_embargo(data, both):
    rows = splits.purged_blocks(data, 3, 5, both_sides=both).toPandas()
    assert sorted(rows["split"].unique()) == [1, 2, 3]
    ends = []
    for _, own in rows.groupby("split"):
        test, train = own[own.role == "test"], own[own.role == "train"]
        first, last = test["date"].min() - dt.timedelta(5), test["label_end"].max() + dt.timedelta(5)
        assert ((train["label_end"] < first) | (train["date"] > last)).all() and len(train)
        assert both or (train["label_end"] < first).all()
        known = data.where(F.col("label_end").isNotNull()).toPandas()
        free = (known["label_end"] < first) | ((known["date"] > last) & both)
        assert free.sum() == len(train) and test["date"].nunique() == 24  # of 98 dates, whatever a symbol's age
        ends.append((test["date"].min(), test["date"].max()))
    assert all(a[1] < b[0] for a, b in zip(sorted(ends), sorted(ends)[1:]))


def test_few_dates_and_no_rows(data):
    assert splits.purged_blocks(data.limit(0), 3).count() == 0
    assert splits.purged_blocks(data.where("date < '2020-01-10'"), 3).count() == 0


def test_out_of_fold_rows_are_those_of_the_test_blocks(data):
    frame = ml.assembled(data, ["x", "z"])
    out = ml.out_of_fold(frame, [ml.logistic()], 3)
    tested = splits.purged_blocks(frame, 3).where("role = 'test'")
    assert out.count() == tested.count() and out.select("sym", "date").exceptAll(tested.select("sym", "date")).count() == 0
    assert out.where("(p0 > 0.5) = (label = 1)").count() > 0.8 * out.count()


def test_meta_model_is_judged_on_whether_the_base_model_was_right(data):
    frame = ml.assembled(data, ["x", "z"])
    train, test = frame.where("date < '2021-06-01'"), frame.where("date >= '2021-06-01'")
    out = ml.meta_confidence(ml.logistic(), ml.forest(trees=10, leaf=5))(train, test, train.count()).toPandas()
    assert set(out["label"]) == {0, 1} and ((out["p0"] >= 0.5) == (out["fwd_ret"] > 0)).astype(int).tolist() == out["label"].tolist()
    # far from the border the base model is right, and the meta-model knows
    sure = out["p0"].sub(0.5).abs() > out["p0"].sub(0.5).abs().median()
    assert out[sure]["label"].mean() > out[~sure]["label"].mean() and out[sure]["proba"].mean() > out[~sure]["proba"].mean()


@pytest.mark.parametrize("calibrate", [False, True])
def test_stacking_and_its_calibration(data, calibrate):
    frame = ml.assembled(data, ["x", "z"])
    train, test = frame.where("date < '2021-06-01'"), frame.where("date >= '2021-06-01'")
    trees = ml.boosted(["x", "z"], rounds=3, depth=2, rate=0.5, leaf=2.0)
    out = ml.stacked([ml.logistic(), trees], calibrate=calibrate)(train, test, train.count()).toPandas()
    loss = -np.mean(np.log(np.clip(np.where(out["label"] > 0, out["proba"], 1 - out["proba"]), 1e-3, 1)))
    assert len(out) == test.count() and out["proba"].between(0, 1).all() and loss < 0.5


def test_folds_side_by_side_are_the_folds_one_by_one(data):
    p = boosting.Params(rounds=4, depth=2, rate=0.3, min_weight=2.0)
    many = ml.walk_forward_boosted(data, ["x", "z"], p, 6, min_train=200).toPandas()
    assert many["fold"].nunique() == 2
    report = ml.fold_report(ml.walk_forward_boosted(data, ["x", "z"], p, 6, min_train=200), 10_000).collect()
    assert all(r["auc"] > 0.9 for r in report)
    with pytest.raises(ValueError):
        ml.walk_forward_boosted(data, ["x", "z"], p, 6, min_train=10 ** 6)


def test_adaptive_search_of_boosted_trees(data):
    table = ml.search_boosted(data, ["x", "z"], trials=6, splits=2, rounds=2, depth=2, min_weight=1.0).toPandas()
    assert sorted(table["trial"]) == list(range(6)) and table["splits"].is_monotonic_decreasing
    best = table.iloc[0]
    assert best["splits"] == 2 and best["mean_auc"] > 0.9 and pd.notna(table["mean_auc"]).all()
