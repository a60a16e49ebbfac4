"""Adaptive search on a known surface; isotonic fits against pooling by the definition."""

import json

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from barloom.operators import calibration, search


def surface(p):
    return -((p["a"] - 0.2) ** 2 + (np.log10(p["b"]) + 2) ** 2 / 4 + (p["c"] - 7) ** 2 / 50)


SPACE = {"a": search.Range(0, 1), "b": search.Range(1e-4, 1, log=True), "c": search.Range(1, 20, whole=True)}


def run(seed, trials=30, **kw):
    return search.search(SPACE, lambda group, split: {t: surface(p) for t, p in group}, trials=trials, seed=seed, **kw)


def test_search_beats_drawing_at_random():
    found, drawn = [], []
    for seed in range(24):
        found.append(max(r[3] for r in run(seed)))
        drawn.append(max(r[3] for r in run(seed, startup=30)))
    assert np.mean(found) > np.mean(drawn) and np.median(found) > np.median(drawn)


def test_search_is_seeded_halves_and_stays_in_its_ranges():
    asked = []

    def evaluate(group, split):
        asked.append((split, len(group)))
        return {t: surface(p) for t, p in group}

    table = search.search(SPACE, evaluate, trials=20, startup=10, group=5, seed=3)
    assert asked == [(1, 10), (2, 5), (3, 3), (1, 5), (2, 3), (3, 2), (1, 5), (2, 3), (3, 2)]
    assert sorted(t for t, *_ in table) == list(range(20)) and table[0][2] == 3
    assert all(0 <= p["a"] <= 1 and 1e-4 <= p["b"] <= 1 and p["c"] in range(1, 21) for _, p, _, _ in table)
    again = search.search(SPACE, lambda g, s: {t: surface(p) for t, p in g}, trials=20, startup=10, group=5, seed=3)
    assert json.dumps(table) == json.dumps(again)


def brute_pav(scores, labels):
    """Fitted value of each distinct score: violators pooled one pair at a time."""
    blocks = []
    for x in sorted(set(scores)):
        own = [y for s, y in zip(scores, labels) if s == x]
        blocks.append([[x], sum(own), len(own)])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][2] >= blocks[-1][1] * blocks[-2][2]:
            last = blocks.pop()
            blocks[-1] = [blocks[-1][0] + last[0], blocks[-1][1] + last[1], blocks[-1][2] + last[2]]
    return {x: total / n for xs, total, n in blocks for x in xs}


@pytest.mark.parametrize("ranges", [1, 3, 40])
def test_isotonic_equals_pooling_by_pairs(spark, ranges):
    rng = np.random.default_rng(1)
    scores = np.round(rng.random(2000), 2)
    labels = (rng.random(2000) < scores ** 2).astype(int)
    df = spark.createDataFrame(pd.DataFrame({"proba": scores, "label": labels})).repartition(5)
    odd = spark.createDataFrame([(None, 1), (0.5, None), (float("nan"), 1)], "proba double, label int")
    curve = calibration.Curve(calibration.isotonic_blocks(df.unionByName(odd), ranges=ranges))
    want = brute_pav(scores.tolist(), labels.tolist())
    got = curve(np.array(sorted(want)))
    assert np.allclose(got, [want[x] for x in sorted(want)], atol=1e-12) and (np.diff(got) >= 0).all()


def test_no_rows_and_one_label(spark):
    df = spark.createDataFrame([(0.3, 1), (0.6, 1)], "proba double, label int")
    assert calibration.Curve(calibration.isotonic_blocks(df))(np.array([0.1, 0.9])).tolist() == [1.0, 1.0]
    assert calibration.isotonic_blocks(df.limit(0)).count() == 0


def test_calibrated_scores_have_a_better_log_loss(spark):
    rng = np.random.default_rng(2)
    truth = rng.random(6000)
    frame = pd.DataFrame({"a": truth ** 3, "b": truth ** 2, "label": (rng.random(6000) < truth).astype(int), "n": range(6000)})
    df = spark.createDataFrame(frame)
    train, test = df.where("n < 4000"), df.where("n >= 4000")
    curves = {s: calibration.Curve(calibration.isotonic_blocks(train, s)) for s in ("a", "b")}
    out = calibration.apply(test, curves).toPandas()
    assert list(out.columns) == ["label", "n", "proba"]
    loss = lambda p, y: -np.mean(np.where(y > 0, np.log(np.clip(p, 1e-3, 1)), np.log(np.clip(1 - p, 1e-3, 1))))
    held = frame[frame.n >= 4000]
    assert loss(out["proba"], out["label"]) < min(loss(held["a"], held["label"]), loss(held["b"], held["label"])) - 0.02
