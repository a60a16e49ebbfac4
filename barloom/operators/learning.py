"""Pooled classifiers with walk-forward training on MLlib.

Every fit is distributed; the driver loops over a fold table of a few rows.  Boosted trees grow for
all folds, or all trials of a search, side by side (``boosting``).  Inner splits go by the calendar and
are purged: no label of a training row reaches into a test block.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import c
from ..session import materialise
from . import boosting, calibration, metrics
from . import search as tuning
from .splits import purged_blocks, walk_forward_folds

Factory = Callable[[int], object]
KEYS = ("sym", "date")


# ---- models --------------------------------------------------------------------------------
def logistic(strength: float = 0.1, **kw) -> Factory:
    """L2 logistic regression; the penalty of C is 1 / (C n)."""
    return lambda n: LogisticRegression(regParam=1.0 / (strength * max(n, 1)), maxIter=1000,
                                        standardization=False, **kw)


def forest(trees: int = 300, depth: int = 6, leaf: int = 50, seed: int = 42, **kw) -> Factory:
    return lambda n: RandomForestClassifier(numTrees=trees, maxDepth=depth, minInstancesPerNode=leaf,
                                            seed=seed, **kw)


class BoostedModel:
    """A fitted model of ``boosting`` beside those of MLlib."""

    def __init__(self, ensemble: boosting.Ensemble):
        self.ensemble = ensemble

    def score(self, df: DataFrame, name: str) -> DataFrame:
        out = boosting.predict(df.drop("features").withColumn("_model", F.lit(0)), self.ensemble, "_model", name).drop("_model")
        return assembled(out, self.ensemble.features)

    def importances(self) -> list[float]:
        n = [0] * len(self.ensemble.features)
        for tree in self.ensemble.trees[0]:
            for f in tree.feature[tree.feature >= 0]:
                n[f] += 1
        return [x / max(1, sum(n)) for x in n]


class Boosted:
    def __init__(self, params: boosting.Params, features: Sequence[str]):
        self.params, self.features = params, features

    def fit(self, df: DataFrame) -> BoostedModel:
        return BoostedModel(boosting.fit(df, self.features, [self.params], F.array(F.lit(True))))


def boosted(features: Sequence[str], rounds: int = 300, depth: int = 4, rate: float = 0.05, leaf: float = 20.0, seed: int = 42,
            **kw) -> Factory:
    return lambda n: Boosted(boosting.Params(rounds=rounds, depth=depth, rate=rate, min_weight=leaf, seed=seed, **kw), features)


def assembled(df: DataFrame, features: Sequence[str]) -> DataFrame:
    return VectorAssembler(inputCols=list(features), outputCol="features").transform(df)


def probability(model, df: DataFrame, name: str = "proba") -> DataFrame:
    if isinstance(model, BoostedModel):
        return model.score(df, name)
    keep = [x for x in df.columns if x not in ("rawPrediction", "probability", "prediction")]
    out = model.transform(df)
    return out.select(*keep, vector_to_array("probability")[1].alias(name))


def fit(df: DataFrame, factory: Factory, rows: int):
    return factory(rows).fit(df)


# ---- walk-forward --------------------------------------------------------------------------
def walk_forward(df: DataFrame, features: Sequence[str], factory: Factory, test_months: int = 2,
                 embargo_days: int = 10, min_train: int = 5000,
                 transform: Callable[[DataFrame, DataFrame, int], DataFrame] | None = None
                 ) -> DataFrame:
    """Out-of-sample predictions over purged expanding folds.

    ``transform(train, test, n)`` replaces the plain fit-and-predict of one fold.
    """
    data = assembled(materialise(df.where(c("fwd_ret").isNotNull())), features)
    folds = walk_forward_folds(data, test_months, embargo_days, min_train=min_train).collect()
    parts = []
    for f in folds:
        train = data.where(c("date") < F.lit(f.train_end))
        test = data.where(c("date").between(F.lit(f.test_start), F.lit(f.test_end)))
        if transform is None:
            scored = probability(fit(train, factory, f.n_train), test)
        else:
            scored = transform(train, test, f.n_train)
        parts.append(scored.withColumn("fold", F.lit(f.fold)))
    if not parts:
        raise ValueError("no fold has enough training rows")
    out = reduce(DataFrame.unionByName, parts)
    return out.select("sym", "date", "fold", "fwd_ret", "fwd_excess", "label", "proba")


def walk_forward_boosted(df: DataFrame, features: Sequence[str], params: boosting.Params = boosting.Params(), test_months: int = 2,
                         embargo_days: int = 10, min_train: int = 5000) -> DataFrame:
    """``walk_forward`` of boosted trees, the models of all folds grown side by side."""
    data = materialise(df.where(c("fwd_ret").isNotNull()))
    folds = walk_forward_folds(data, test_months, embargo_days, min_train=min_train).collect()
    if not folds:
        raise ValueError("no fold has enough training rows")
    model = boosting.fit(data, features, [params] * len(folds), F.array(*[c("date") < F.lit(f.train_end) for f in folds]))
    number = F.coalesce(*[F.when(c("date").between(F.lit(f.test_start), F.lit(f.test_end)), F.struct(
        F.lit(f.fold).alias("fold"), F.lit(k).alias("k"))) for k, f in enumerate(folds)])
    test = data.withColumn("_at", number).where(c("_at").isNotNull()).withColumns({"fold": c("_at.fold"), "_model": c("_at.k")}).drop("_at")
    return boosting.predict(test, model, "_model").select("sym", "date", "fold", "fwd_ret", "fwd_excess", "label", "proba")


def fold_report(oos: DataFrame, bound: int | None = None) -> DataFrame:
    """AUC, accuracy and size per fold."""
    oos = materialise(oos)
    area = metrics.auc(oos, by=["fold"], bound=bound)
    rate = oos.groupBy("fold").agg(metrics.accuracy().alias("accuracy"),
                                   F.avg("label").alias("base_rate"))
    return area.join(rate, "fold")


def soft_vote(factories: Sequence[Factory]) -> Callable[[DataFrame, DataFrame, int], DataFrame]:
    """Mean probability of several models; each adds a column, so no join is needed."""

    def run(train: DataFrame, test: DataFrame, n: int) -> DataFrame:
        names = []
        for i, factory in enumerate(factories):
            test = probability(fit(train, factory, n), test, f"p{i}")
            names.append(f"p{i}")
        return test.withColumn("proba", sum((c(x) for x in names), F.lit(0.0)) / len(names))

    return run


def out_of_fold(df: DataFrame, factories: Sequence[Factory], splits: int = 3, embargo_days: int = 5) -> DataFrame:
    """The rows of the test blocks with out-of-fold probabilities p0, p1, ...; training rows are purged (``purged_blocks``)."""
    tagged = materialise(purged_blocks(df, splits, embargo_days))
    parts = []
    for k in range(1, splits + 1):
        train = tagged.where((c("split") == k) & (c("role") == "train")).drop("split", "role")
        test = tagged.where((c("split") == k) & (c("role") == "test")).drop("split", "role")
        n = train.count()
        if not n:
            continue
        for i, factory in enumerate(factories):
            test = probability(fit(train, factory, n), test, f"p{i}")
        parts.append(test)
    if not parts:
        raise ValueError("no split has a training row that is free of its test block")
    return reduce(DataFrame.unionByName, parts)


def stacked(factories: Sequence[Factory], splits: int = 3, calibrate: bool = False, embargo_days: int = 5
            ) -> Callable[[DataFrame, DataFrame, int], DataFrame]:
    """Logistic meta-model on out-of-fold probabilities.

    ``calibrate``: for each inner split of the out-of-fold rows a meta-model is fitted on its training
    rows and an isotonic curve on its held-out rows; the calibrated probabilities are averaged.
    """
    names = [f"p{i}" for i in range(len(factories))]
    meta_in = VectorAssembler(inputCols=names, outputCol="meta")
    meta_fit = lambda df: LogisticRegression(featuresCol="meta", maxIter=200, regParam=1e-3).fit(df)

    def run(train: DataFrame, test: DataFrame, n: int) -> DataFrame:
        oof = materialise(meta_in.transform(out_of_fold(train, factories, splits, embargo_days).drop("features")))
        for i, factory in enumerate(factories):
            test = probability(fit(train, factory, n), test, f"p{i}")
        scored = meta_in.transform(test)
        if not calibrate:
            return probability(meta_fit(oof), scored)
        tagged = materialise(purged_blocks(oof, splits, embargo_days, both_sides=True))
        curves = {}
        for k in range(1, splits + 1):
            part = lambda role: tagged.where((c("split") == k) & (c("role") == role))  # noqa: B023, E731
            if part("train").select("label").distinct().count() < 2:
                continue
            model = meta_fit(part("train"))
            curves[f"c{k}"] = calibration.Curve(calibration.isotonic_blocks(probability(model, part("test")), "proba"))
            scored = probability(model, scored, f"c{k}")
        curves = {k: v for k, v in curves.items() if v.x}
        if not curves:
            return probability(meta_fit(oof), scored)
        return calibration.apply(scored.drop("features", "meta"), curves)

    return run


def importances(df: DataFrame, features: Sequence[str], factories: Sequence[Factory],
                least: float = 0.01) -> DataFrame:
    """Mean importance per feature over several tree models, and whether it is kept."""
    data = assembled(materialise(df.where(c("fwd_ret").isNotNull())), features)
    n = data.count()
    models = [fit(data, f, n) for f in factories]
    found = [m.importances() if isinstance(m, BoostedModel) else m.featureImportances.toArray() for m in models]
    mean = [float(sum(v[i] for v in found) / len(found)) for i in range(len(features))]
    table = df.sparkSession.createDataFrame(list(zip(features, mean)),
                                            "feature string, importance double")
    return table.withColumn("keep", c("importance") >= least)


def meta_confidence(base: Factory, meta: Factory, splits: int = 3, in_sample: bool = False, embargo_days: int = 5
                    ) -> Callable[[DataFrame, DataFrame, int], DataFrame]:
    """Probability that the base model is right, learned from purged out-of-fold hits.

    The rows returned have that as ``proba`` and, as ``label``, whether the base model was right on
    them, so that reports judge the meta-model on its own target.  ``in_sample`` learns from the base
    model's own training rows instead (optimistic).
    """
    hit = lambda df: df.withColumn("label", ((c("p0") >= 0.5).cast("int") == c("label")).cast("int"))

    def run(train: DataFrame, test: DataFrame, n: int) -> DataFrame:
        model = fit(train, base, n)
        judged = probability(model, train, "p0") if in_sample else out_of_fold(train, [base], splits, embargo_days)
        second = fit(materialise(hit(judged)), meta, n)
        return probability(second, hit(probability(model, test, "p0")))

    return run


def search(df: DataFrame, features: Sequence[str], candidates: dict[str, Factory],
           splits: int = 3, bound: int | None = None, embargo_days: int = 5) -> DataFrame:
    """Mean AUC of every candidate over purged calendar blocks, best first."""
    data = materialise(assembled(df.where(c("fwd_ret").isNotNull()), features))
    tagged = materialise(purged_blocks(data, splits, embargo_days))
    parts = []
    for name, factory in candidates.items():
        for k in range(1, splits + 1):
            train = tagged.where((c("split") == k) & (c("role") == "train")).drop("split", "role")
            test = tagged.where((c("split") == k) & (c("role") == "test")).drop("split", "role")
            scored = probability(fit(train, factory, train.count()), test)
            parts.append(scored.select("label", "proba", F.lit(name).alias("candidate"),
                                       F.lit(k).alias("fold")))
    scored = materialise(reduce(DataFrame.unionByName, parts))
    area = metrics.auc(scored, by=["candidate", "fold"], bound=bound)
    return area.groupBy("candidate").agg(F.avg("auc").alias("mean_auc")).orderBy(
        c("mean_auc").desc(), "candidate")


#: Parameters that a search of boosted trees goes over.
BOOSTED_SPACE = {
    "rounds": tuning.Range(100, 800, whole=True), "depth": tuning.Range(3, 12, whole=True), "rate": tuning.Range(0.01, 0.15),
    "rows": tuning.Range(0.6, 1.0), "columns": tuning.Range(0.5, 1.0), "min_weight": tuning.Range(2.5, 15.0),
    "l2": tuning.Range(0.0, 2.0), "gain": tuning.Range(0.0, 1.0), "positive": tuning.Range(0.5, 2.0)}


def search_boosted(df: DataFrame, features: Sequence[str], space: dict[str, tuning.Range] | None = None, trials: int = 30,
                   splits: int = 3, embargo_days: int = 5, bound: int | None = None, seed: int = 42, **fixed) -> DataFrame:
    """(trial, parameters, splits, mean_auc) of an adaptive search of boosted trees over purged calendar blocks, best first.

    Parameters are those of ``boosting.Params``, as JSON; ``fixed`` sets those that are not searched.
    The trials of a group grow side by side; a block with one label only scores 0.5.
    """
    space = space or {k: v for k, v in BOOSTED_SPACE.items() if k not in fixed}
    tagged = materialise(purged_blocks(df.where(c("fwd_ret").isNotNull()), splits, embargo_days))

    def evaluate(group: list[tuple[int, dict]], split: int) -> dict[int, float]:
        part = lambda role: tagged.where((c("split") == split) & (c("role") == role)).drop("split", "role")
        models = [boosting.Params(**{"seed": seed, **fixed, **params}) for _, params in group]
        model = boosting.fit(part("train"), features, models, F.array(*[F.lit(True)] * len(models)))
        test = part("test").withColumn("_model", F.explode(F.array(*[F.lit(k) for k in range(len(models))])))
        area = metrics.auc(materialise(boosting.predict(test, model, "_model")), by=["_model"], bound=bound)
        found = {r["_model"]: r["auc"] for r in area.collect()}
        return {t: 0.5 if found.get(k) is None else found[k] for k, (t, _) in enumerate(group)}

    rows = tuning.search(space, evaluate, trials, splits, seed=seed)
    return df.sparkSession.createDataFrame([(t, json.dumps(p, sort_keys=True), n, score) for t, p, n, score in rows],
                                           "trial int, parameters string, splits int, mean_auc double")
