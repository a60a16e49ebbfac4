"""Splits and pooled models (ML-*)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import windows as w
from ..functions.exprs import c, rounded
from ..operators import boosting, labels, learning as ml, metrics, splits
from ..operators import crosssection as xs
from ..plans.evaluation import compare_models
from ..plans.pooled import FEATURES, pooled_dataset
from ..session import materialise
from .base import block, query, r, ret, sql

block("wfd", "ds", "SELECT date, count(*) AS n FROM ds WHERE fwd_10 IS NOT NULL GROUP BY 1")
block("wfm", "wfd", """SELECT m, row_number() OVER (ORDER BY m) - 1 AS pos, count(*) OVER () AS total,
  max(m) OVER (ORDER BY m ROWS BETWEEN CURRENT ROW AND 1 FOLLOWING) AS last FROM (SELECT DISTINCT CAST(date_trunc('month', date) AS DATE) AS m FROM wfd)""")
block("wff", "wfm wfd", """SELECT pos, train_end, test_start, test_end, CAST(coalesce(sum(n) FILTER (date < train_end), 0) AS BIGINT) AS n_train,
  CAST(coalesce(sum(n) FILTER (date BETWEEN test_start AND test_end), 0) AS BIGINT) AS n_test
FROM (SELECT pos, CAST(m - INTERVAL 15 DAY AS DATE) AS train_end, m AS test_start, CAST(last_day(last) AS DATE) AS test_end FROM wfm
  WHERE pos >= 12 AND (pos - 12) % 2 = 0 AND pos < total - 1), wfd GROUP BY 1, 2, 3, 4""")


@query("ML-1_purged_walk_forward", sql("wff", """SELECT CAST(row_number() OVER (ORDER BY pos) AS INTEGER) AS fold, train_end, test_start, test_end, n_train, n_test
FROM wff WHERE n_train >= 500 AND n_test > 0"""))
def _(t):
    df = t.dataset.where(c("fwd_10").isNotNull())
    return splits.walk_forward_folds(df, 2, 10, min_train=500)


block("idx", "bars", "SELECT sym, date, row_number() OVER (PARTITION BY sym ORDER BY date) - 1 AS i, count(*) OVER (PARTITION BY sym) AS n FROM bars")


@query("ML-2_sliding_windows", sql("idx", """SELECT sym, CAST(f AS INTEGER) AS fold, count(*) FILTER (i < s) AS n_train, count(*) FILTER (i >= s) AS n_test,
  min(date) FILTER (i >= s) AS test_start, max(date) FILTER (i >= s) AS test_end
FROM (SELECT idx.*, f, 120 + (f - 1) * 20 AS s FROM idx, range(1, 100) g(f) WHERE 120 + f * 20 <= n) WHERE i >= s - 120 AND i < s + 20 GROUP BY 1, 2"""))
def _(t):
    df = splits.sliding_windows(t.bars.select("sym", "date"), 120, 20)
    test = F.when(c("role") == "test", c("date"))
    return df.groupBy("sym", "fold").agg(
        F.count_if(c("role") == "train").alias("n_train"), F.count_if(c("role") == "test").alias("n_test"),
        F.min(test).alias("test_start"), F.max(test).alias("test_end"))


@query("ML-3_point_in_time_steps", sql("idx", "SELECT sym, date FROM idx WHERE i >= 60 AND i < n - 10 AND (i - 60) % 20 = 0"))
def _(t):
    return splits.steps(t.bars.select("sym", "date"), 60, 20, 10)


@query("ML-4_tail_split", sql("idx", """SELECT sym, CASE WHEN i < CASE WHEN n - k < 30 THEN n - 30 ELSE k END THEN 'core' ELSE 'validation' END AS role, count(*) AS n, min(date) AS first, max(date) AS last
FROM (SELECT *, greatest(floor(n * 0.8::DOUBLE), n - 100) AS k FROM idx) GROUP BY 1, 2"""))
def _(t):
    return splits.tail_split(t.bars.select("sym", "date")).groupBy("sym", "role").agg(
        F.count(F.lit(1)).alias("n"), F.min("date").alias("first"), F.max("date").alias("last"))


@query("ML-5_expanding_blocks", sql("idx", """SELECT sym, CAST(k AS INTEGER) AS split, CASE WHEN i < s THEN 'train' ELSE 'test' END AS role, count(*) AS n, min(date) AS first, max(date) AS last
FROM (SELECT idx.*, k, n - (4 - k) * (n // 4) AS s FROM idx, range(1, 4) g(k)) WHERE i < s + n // 4 GROUP BY 1, 2, 3"""))
def _(t):
    return splits.expanding_blocks(t.bars.select("sym", "date")).groupBy("sym", "split", "role").agg(
        F.count(F.lit(1)).alias("n"), F.min("date").alias("first"), F.max("date").alias("last"))


block("lab", "bars", """SELECT sym, date, lead(date, 10) OVER (PARTITION BY sym ORDER BY date) AS label_end FROM bars
  QUALIFY label_end IS NOT NULL""")
block("cal", "lab", """SELECT CAST(k AS INTEGER) AS split, min(date) AS test_start, max(date) AS test_end
FROM (SELECT date, row_number() OVER (ORDER BY date) - 1 AS i, count(*) OVER () AS n FROM (SELECT DISTINCT date FROM lab)), range(1, 4) g(k)
WHERE i >= n - (4 - k) * (n // 4) AND i < n - (3 - k) * (n // 4) GROUP BY 1""")
PURGED = """SELECT split, role, count(*) AS n, min(date) AS first, max(date) AS last, max(label_end) AS last_end FROM (
  SELECT lab.*, cal.split, CASE WHEN date BETWEEN test_start AND test_end THEN 'test' WHEN label_end < test_start - INTERVAL 5 DAY THEN 'train' {more} END AS role
  FROM lab, (SELECT cal.split, any_value(test_start) AS test_start, any_value(test_end) AS test_end, max(label_end) AS reach
    FROM cal, lab WHERE date BETWEEN test_start AND test_end GROUP BY 1) cal) WHERE role IS NOT NULL GROUP BY 1, 2"""


def split_table(t, both_sides):
    rows = t.bars.select("sym", "date", F.lead("date", 10).over(Window.partitionBy("sym").orderBy("date")).alias("label_end"))
    return splits.purged_blocks(rows, 3, 5, both_sides=both_sides).groupBy("split", "role").agg(
        F.count(F.lit(1)).alias("n"), F.min("date").alias("first"), F.max("date").alias("last"), F.max("label_end").alias("last_end"))


@query("ML-11_purged_splits", sql("lab cal", PURGED.format(more="")))
def _(t):
    return split_table(t, False)


@query("ML-12_purged_splits_both_sides", sql("lab cal", PURGED.format(more="WHEN date > reach + INTERVAL 5 DAY THEN 'train'")))
def _(t):
    return split_table(t, True)


@query("ML-6_class_weight", sql("signals", f"""SELECT fold, pos, neg, {r('weight=neg / pos')} FROM (SELECT fold, greatest(1, CAST(sum(label) AS BIGINT)) AS pos,
  greatest(1, count(*) - greatest(1, CAST(sum(label) AS BIGINT))) AS neg FROM signals GROUP BY 1)"""))
def _(t):
    return rounded(splits.class_weights(t.signals, ["fold"]))


def pool(t):
    return pooled_dataset(t.bars, t.bench, 10, bound=t.bound)


def report(t, factory, months=6, transform=None):
    oos = ml.walk_forward(pool(t), FEATURES, factory, months, min_train=500, transform=transform)
    return rounded(ml.fold_report(oos, None))


@query("ML-7_logistic_regression")
def _(t):
    return report(t, ml.logistic(), months=2)


@query("ML-8_random_forest")
def _(t):
    return report(t, ml.forest(trees=30))


@query("ML-9_boosted_trees")
def _(t):
    return rounded(ml.fold_report(ml.walk_forward_boosted(pool(t), FEATURES, boosting.Params(), 2, min_train=500), None))


@query("ML-10_soft_vote")
def _(t):
    return report(t, None, transform=ml.soft_vote([ml.logistic(), ml.forest(trees=20)]))


@query("ML-11_stacking")
def _(t):
    return report(t, None, transform=ml.stacked([ml.logistic(), ml.forest(trees=10)]))


@query("ML-12_isotonic_calibration")
def _(t):
    return report(t, None, transform=ml.stacked([ml.logistic(), ml.forest(trees=10)], calibrate=True))


@query("ML-13_feature_importance")
def _(t):
    return rounded(ml.importances(pool(t), FEATURES, [ml.forest(trees=20), ml.boosted(FEATURES, rounds=5)]))


@query("ML-14_meta_labelling")
def _(t):
    return report(t, None, transform=ml.meta_confidence(ml.logistic(), ml.forest(trees=20, depth=4)))


@query("ML-15_parameter_search")
def _(t):
    return rounded(ml.search_boosted(pool(t), FEATURES, trials=30, splits=3, rounds=10))


@query("ML-16_out_of_sample_evaluation")
def _(t):
    oos = materialise(ml.walk_forward(pool(t), FEATURES, ml.logistic(), 6, min_train=500))
    return compare_models(oos.withColumn("model", F.lit("logistic")), 10, 5, 10, None)


@query("ML-17_batch_over_symbols_and_tiers")
def _(t):
    """Three label rules, one pooled model each; accuracy per symbol and tier, best first."""
    from functools import reduce
    base = materialise(pool(t).where(c("fwd_ret").isNotNull()))
    barrier = labels.triple_barrier(t.bars).select("sym", "date", (c("triple_label") == 1).cast("int").alias("b"))
    tiers = {"plain": base, "move": base.withColumn("label", labels.above("fwd_ret", 0.02)),
             "barrier": base.join(barrier, ["sym", "date"]).drop("label").withColumnRenamed("b", "label")}
    parts = [ml.walk_forward(df, FEATURES, ml.logistic(), 6, min_train=500).withColumn("tier", F.lit(name))
             for name, df in tiers.items()]
    oos = reduce(lambda a, b: a.unionByName(b), parts)
    return rounded(oos.groupBy("sym", "tier").agg(
        (metrics.accuracy() * 100).alias("accuracy"), F.count(F.lit(1)).alias("n")))
