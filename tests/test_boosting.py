"""Boosted trees against a brute-force tree, and their table."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from barloom.operators import boosting

FEATURES = ["a", "b", "c"]


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(0)
    x = rng.integers(0, 12, (600, 3)).astype(float)
    y = ((x[:, 0] > 5) ^ (x[:, 1] > 7) ^ (rng.random(600) < 0.15)).astype(int)
    return pd.DataFrame({"sym": [f"s{k % 7}" for k in range(600)], "date": range(600), **dict(zip(FEATURES, x.T)), "label": y})


@pytest.fixture(scope="module")
def table(spark, rows):
    return spark.createDataFrame(rows).repartition(4).cache()


def brute(rows, p):
    """Predictions after ``p.rounds`` trees, every threshold of every feature tried in turn."""
    x, y = rows[FEATURES].to_numpy(), rows["label"].to_numpy(float)
    margin = np.zeros(len(x))

    def grow(at, depth):
        g, h = (1 / (1 + np.exp(-margin[at])) - y[at]), 0
        q = 1 / (1 + np.exp(-margin[at]))
        h = q * (1 - q)
        best = (1e-9, None, None)
        for f in range(3) if depth else ():
            for cut in sorted(set(x[:, f]))[:-1]:
                left = x[at, f] <= cut
                if min(h[left].sum(), h[~left].sum()) < p.min_weight:
                    continue
                score = lambda m: g[m].sum() ** 2 / (h[m].sum() + p.l2)
                gain = round(score(left) + score(~left) - g.sum() ** 2 / (h.sum() + p.l2), 9)
                if gain > best[0]:
                    best = (gain, f, cut)
        if best[1] is None:
            step[at] = -p.rate * g.sum() / (h.sum() + p.l2)
            return
        left = x[at, best[1]] <= best[2]
        splits.append((best[1], best[2]))
        grow(at[left], depth - 1)
        grow(at[~left], depth - 1)

    splits = []
    for _ in range(p.rounds):
        step = np.zeros(len(x))
        grow(np.arange(len(x)), p.depth)
        margin += step
    return 1 / (1 + np.exp(-margin)), splits


def test_equals_brute_force(spark, rows, table):
    p = boosting.Params(rounds=5, depth=3, rate=0.3, min_weight=4.0, rows=1.0, columns=1.0)
    model = boosting.fit(table, FEATURES, [p], F.array(F.lit(True)))
    want, splits = brute(rows, p)
    got = boosting.predict(table.withColumn("model", F.lit(0)), model).toPandas().sort_values("date")["proba"].to_numpy()
    assert np.allclose(got, want, atol=1e-9)
    found = [(FEATURES.index(r["feature"]), r["threshold"]) for r in model.table(spark).collect() if r["feature"]]
    # edges are quantiles of whole numbers: the same cuts
    assert sorted(found) == sorted(splits)


def test_models_side_by_side_are_those_alone(spark, table):
    slow, deep = boosting.Params(rounds=3, depth=2, min_weight=1.0), boosting.Params(rounds=4, depth=3, rate=0.2, min_weight=2.0, seed=7)
    early = F.col("date") < 400
    both = boosting.fit(table, FEATURES, [slow, deep], F.array(early, F.lit(True))).table(spark)
    alone = [boosting.fit(table, FEATURES, [slow], F.array(early)).table(spark), boosting.fit(table, FEATURES, [deep], F.array(F.lit(True))).table(spark)]
    for m, own in enumerate(alone):
        want = [tuple(r)[1:5] for r in own.orderBy("tree", "node").collect()]
        assert [tuple(r)[1:5] for r in both.where(F.col("model") == m).orderBy("tree", "node").collect()] == want


def test_table_and_back_and_margins_kept(spark, table, monkeypatch):
    p = boosting.Params(rounds=4, depth=2, min_weight=1.0, rate=0.3)
    plain = boosting.fit(table, FEATURES, [p], F.array(F.lit(True)))
    monkeypatch.setattr(boosting, "KEEP", 2)
    kept = boosting.fit(table, FEATURES, [p], F.array(F.lit(True)))
    again = boosting.Ensemble.from_table(plain.table(spark), FEATURES)
    rows = table.withColumn("model", F.lit(0))
    first, *others = [boosting.predict(rows, m).toPandas().sort_values("date")["proba"].to_numpy() for m in (plain, kept, again)]
    for other in others:
        assert np.allclose(first, other, atol=1e-12)


def test_learns_missing_values_and_no_rows(spark, rows, table):
    p = boosting.Params(rounds=20, depth=3, rate=0.3, min_weight=2.0)
    holes = table.withColumn("c", F.when(F.col("date") % 3 == 0, F.lit(None).cast("double")).otherwise(F.col("c")))
    model = boosting.fit(holes.where("date < 450"), FEATURES, [p], F.array(F.lit(True)))
    out = boosting.predict(holes.where("date >= 450").withColumn("model", F.lit(0)), model).toPandas()
    assert ((out["proba"] > 0.5) == (out["label"] > 0)).mean() > 0.7
    loss = -np.mean(np.where(out["label"] > 0, np.log(out["proba"]), np.log(1 - out["proba"])))
    assert loss < math.log(2)
    none = boosting.fit(table, FEATURES, [p], F.array(F.lit(False)))
    assert boosting.predict(table.withColumn("model", F.lit(0)), none).agg(F.max("proba"), F.min("proba")).first() == (0.5, 0.5)
