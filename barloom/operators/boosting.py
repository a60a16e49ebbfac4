"""Boosted trees by Newton steps on histograms, several models in one pass.

Features are cut into bins at approximate quantiles.  A level of all trees is one job: each task sums
gradients and hessians of its rows by (model, node, feature, bin), Spark adds the sums of the tasks, and
what reaches the driver has the size of the models, not of the data.  Models that share rows, such as
the folds of a walk-forward or the trials of a search, grow side by side: a row says which of them it
trains.  Margins are written with the rows every ``KEEP`` rounds; the trees since then go with the job.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.exprs import c
from ..session import materialise

#: Rounds between two tables of margins, and rows of a task.
KEEP, TASK_ROWS = 25, 100_000
TABLE = "model int, tree int, node int, feature string, threshold double, weight double"


@dataclass(frozen=True)
class Params:
    """Size and rules of one model; a leaf weighs -G / (H + l2), times ``rate``."""

    rounds: int = 300
    depth: int = 4
    rate: float = 0.05
    l2: float = 1.0
    min_weight: float = 20.0
    rows: float = 0.8
    columns: float = 0.8
    gain: float = 0.0
    positive: float = 1.0
    seed: int = 42


@dataclass
class Tree:
    """Nodes in heap order; feature -1 is a leaf.  Rows whose bin is at most ``cut`` go left."""

    feature: np.ndarray
    cut: np.ndarray
    weight: np.ndarray

    @staticmethod
    def empty(depth: int) -> "Tree":
        n = 2 ** (depth + 1) - 1
        return Tree(np.full(n, -1, np.int64), np.zeros(n, np.int64), np.zeros(n))

    def nodes(self, bins: np.ndarray, levels: int) -> np.ndarray:
        node = np.zeros(len(bins), np.int64)
        row = np.arange(len(bins))
        for _ in range(levels):
            f = self.feature[node]
            node = np.where(f >= 0, 2 * node + 1 + (bins[row, np.maximum(f, 0)] > self.cut[node]), node)
        return node

    @property
    def levels(self) -> int:
        return (len(self.feature) + 1).bit_length() - 2

    def values(self, bins: np.ndarray) -> np.ndarray:
        return self.weight[self.nodes(bins, self.levels)]


@dataclass
class Ensemble:
    """Trees by model, with the edges of the bins."""

    features: list[str]
    edges: list[np.ndarray]
    trees: list[list[Tree]] = field(default_factory=list)

    def margins(self, bins: np.ndarray, model: int) -> np.ndarray:
        return sum((t.values(bins) for t in self.trees[model]), np.zeros(len(bins)))

    def table(self, spark: SparkSession) -> DataFrame:
        """One row for each node of each tree: feature and threshold (x <= threshold goes left), or a leaf's weight."""
        rows = []
        for m, trees in enumerate(self.trees):
            for k, tree in enumerate(trees):
                for node in _reached(tree):
                    f = int(tree.feature[node])
                    rows.append((m, k, node, self.features[f] if f >= 0 else None,
                                 float(self.edges[f][tree.cut[node]]) if f >= 0 else None, None if f >= 0 else float(tree.weight[node])))
        return spark.createDataFrame(rows, TABLE)

    @staticmethod
    def from_table(table: DataFrame, features: Sequence[str]) -> "Ensemble":
        """The ensemble of a table made by ``table``."""
        rows = table.collect()
        edges = [np.array(sorted({r["threshold"] for r in rows if r["feature"] == f})) for f in features]
        out = Ensemble(list(features), edges, [[] for _ in range(1 + max((r["model"] for r in rows), default=-1))])
        by_tree: dict[tuple[int, int], list] = {}
        for r in rows:
            by_tree.setdefault((r["model"], r["tree"]), []).append(r)
        for (m, _), nodes in sorted(by_tree.items()):
            tree = Tree.empty(max(n["node"] + 1 for n in nodes).bit_length() - 1)
            for r in nodes:
                if r["feature"] is None:
                    tree.weight[r["node"]] = r["weight"]
                else:
                    f = out.features.index(r["feature"])
                    tree.feature[r["node"]], tree.cut[r["node"]] = f, np.searchsorted(edges[f], r["threshold"])
            out.trees[m].append(tree)
        return out

    def importance(self, spark: SparkSession) -> DataFrame:
        """(feature, splits): how many nodes of all models split on each feature."""
        n = np.zeros(len(self.features), np.int64)
        for tree in (t for trees in self.trees for t in trees):
            np.add.at(n, tree.feature[tree.feature >= 0], 1)
        return spark.createDataFrame(list(zip(self.features, n.tolist())), "feature string, splits long")


def _reached(tree: Tree) -> Iterator[int]:
    stack = [0]
    while stack:
        node = stack.pop()
        yield node
        if tree.feature[node] >= 0:
            stack += [2 * node + 2, 2 * node + 1]


def quantile_edges(df: DataFrame, features: Sequence[str], bins: int = 64, error: float = 0.001) -> list[np.ndarray]:
    """Distinct upper edges of at most ``bins`` bins for each feature, from Spark's quantile sketch."""
    found = df.approxQuantile(list(features), [k / bins for k in range(1, bins)], error)
    return [np.unique(np.array(x, float)) for x in found]


def _matrix(batch: pa.RecordBatch, features: Sequence[str]) -> np.ndarray:
    return np.column_stack([np.asarray(batch.column(f).to_numpy(zero_copy_only=False), float) for f in features])


def _binned(x: np.ndarray, edges: Sequence[np.ndarray]) -> np.ndarray:
    """Bin of each value; a missing one is in the lowest bin."""
    return np.column_stack([np.where(np.isnan(x[:, k]), 0, np.searchsorted(e, x[:, k])) for k, e in enumerate(edges)]).astype(np.uint8)


def _bytes(a: np.ndarray) -> pa.Array:
    return pa.array([row.tobytes() for row in a], pa.binary())


def _rows(column: pa.Array, kind: type, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(-1, width)


def _drawn(key: np.ndarray, seed: int, share: float) -> np.ndarray:
    """Rows of a sample that depends on the row's key and the seed alone."""
    if share >= 1:
        return np.ones(len(key), bool)
    x = key.astype(np.uint64) ^ np.uint64((seed * 0x9E3779B97F4A7C15) & (2 ** 64 - 1))
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return (x ^ (x >> np.uint64(33))) < np.uint64(int(share * 2 ** 64))


def leaf(p: Params, g: np.ndarray, h: np.ndarray) -> float:
    """Weight of a leaf with these sums; 0 without rows."""
    total = float(h.sum()) + p.l2
    return -p.rate * float(g.sum()) / total if total > 0 else 0.0


def best_split(g: np.ndarray, h: np.ndarray, p: Params, allowed: np.ndarray) -> tuple[int, int, float] | None:
    """(feature, last bin that goes left, gain) of a node's sums by (feature, bin); ties go to the first."""
    left_g, left_h = np.cumsum(g, 1)[:, :-1], np.cumsum(h, 1)[:, :-1]
    total_g, total_h = g.sum(1, keepdims=True), h.sum(1, keepdims=True)
    right_g, right_h = total_g - left_g, total_h - left_h
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = left_g ** 2 / (left_h + p.l2) + right_g ** 2 / (right_h + p.l2) - total_g ** 2 / (total_h + p.l2)
    gain[(left_h < p.min_weight) | (right_h < p.min_weight) | (left_h + p.l2 <= 0) | (right_h + p.l2 <= 0)] = -np.inf
    gain[~allowed] = -np.inf
    if not gain.size:
        return None
    gain = np.where(gain > -np.inf, np.round(gain, 9), gain)  # sums differ by their order of summing
    f, cut = np.unravel_index(int(gain.argmax()), gain.shape)
    return (int(f), int(cut), float(gain[f, cut])) if gain[f, cut] > max(p.gain, 1e-9) else None


def fit(df: DataFrame, features: Sequence[str], models: Sequence[Params], uses: Column, label: str = "label",
        keys: Sequence[str] = ("sym", "date"), bins: int = 64) -> Ensemble:
    """One ensemble for each of ``models``.

    ``uses`` is an array of booleans: the models that a row trains.  Rows are sampled by the hash of
    ``keys`` and the round, so a lost task draws the same rows again.  A missing feature counts as the
    lowest bin; rows without a label train nothing.
    """
    if not 1 < bins <= 256:
        raise ValueError("a bin's number is one byte")
    df = materialise(df.where(c(label).isNotNull()))
    edges = quantile_edges(df, features, bins)
    width, n_models, n_features = max(map(len, edges), default=0) + 1, len(models), len(features)
    out = Ensemble(list(features), edges, [[] for _ in models])

    def prepare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            used = np.array(b.column("uses").to_pylist(), np.uint8).reshape(len(b), n_models)
            yield pa.RecordBatch.from_arrays([_bytes(_binned(_matrix(b, features), edges)), b.column("y"), b.column("key"), _bytes(used),
                                              _bytes(np.zeros((len(b), n_models)))], ["bins", "y", "key", "uses", "margins"])

    schema = "bins binary, y double, key long, uses binary, margins binary"
    rows = df.select(*[c(f).cast("double").alias(f) for f in features], c(label).cast("double").alias("y"),
                     F.xxhash64(*keys).alias("key"), uses.alias("uses"))
    # a task for some hundred thousand rows: a level of few rows is one short task and no shuffle
    state = materialise(rows.coalesce(max(1, -(-df.count() // TASK_ROWS))).mapInArrow(prepare, schema))

    def parts(b: pa.RecordBatch, recent: list[list[Tree]]) -> tuple[np.ndarray, ...]:
        own = _rows(b.column("bins"), np.uint8, n_features)
        margins = _rows(b.column("margins"), np.float64, n_models).copy()
        for m, trees in enumerate(recent):
            for tree in trees:
                margins[:, m] += tree.values(own)
        return own, margins, _rows(b.column("uses"), np.uint8, n_models)

    def sums(growing: dict[int, tuple[Tree, list[int]]], recent: list[list[Tree]], level: int, turn: int) -> dict[int, np.ndarray]:
        """Sums of each model by (gradient or hessian, node of this level that may split, feature, bin)."""
        first = 2 ** level - 1
        slots, begins, size = {}, {}, 0
        for m, (_, nodes) in growing.items():
            slots[m] = np.full(2 ** level, -1)
            slots[m][np.array(nodes) - first] = np.arange(len(nodes))
            begins[m] = size
            size += len(nodes) * n_features * width

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros((2, size))
            for b in batches:
                own, margins, used = parts(b, recent)
                y, key = np.asarray(b.column("y")), np.asarray(b.column("key"))
                for m, (tree, nodes) in growing.items():
                    p = models[m]
                    at = np.flatnonzero((used[:, m] > 0) & _drawn(key, p.seed + 1000 * turn, p.rows))
                    node = tree.nodes(own[at], level) - first
                    slot = np.where(node >= 0, slots[m][np.maximum(node, 0)], -1)
                    at, slot = at[slot >= 0], slot[slot >= 0]
                    chance = 1 / (1 + np.exp(-margins[at, m]))
                    weight = np.where(y[at] > 0, p.positive, 1.0)
                    cell = ((slot * n_features)[:, None] + np.arange(n_features)) * width + own[at]
                    n = len(nodes) * n_features * width
                    for k, v in enumerate(((chance - y[at]) * weight, chance * (1 - chance) * weight)):
                        total[k, begins[m]:begins[m] + n] += np.bincount(cell.reshape(-1), np.repeat(v, n_features), n)
            cell = np.flatnonzero(total[1])
            yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(total[0, cell]), pa.array(total[1, cell])], ["cell", "g", "h"])

        rows = state.mapInArrow(run, "cell long, g double, h double").groupBy("cell").agg(F.sum("g").alias("g"), F.sum("h").alias("h")).toArrow()
        both = np.zeros((2, size))
        for k, name in enumerate("gh"):
            both[k, rows.column("cell").to_numpy()] = rows.column(name).to_numpy()
        ends = {m: begins[m] + len(nodes) * n_features * width for m, (_, nodes) in growing.items()}
        return {m: both[:, begins[m]:ends[m]].reshape(2, -1, n_features, width) for m in growing}

    def kept(recent: list[list[Tree]]):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                _, margins, _ = parts(b, recent)
                yield pa.RecordBatch.from_arrays([*[b.column(x) for x in ("bins", "y", "key", "uses")], _bytes(margins)], b.schema.names)
        return run

    recent: list[list[Tree]] = [[] for _ in models]
    for turn in range(max((p.rounds for p in models), default=0)):
        growing = {m: Tree.empty(p.depth) for m, p in enumerate(models) if turn < p.rounds}
        allowed = {m: _columns(models[m], turn, n_features) for m in growing}
        active = {m: (tree, [0]) for m, tree in growing.items()}
        for level in range(max(models[m].depth for m in growing)):
            active = {m: x for m, x in active.items() if level < models[m].depth and x[1]}
            if not active:
                break
            found = sums(active, recent, level, turn)
            for m, (tree, nodes) in active.items():
                g, h = found[m]
                below: list[int] = []
                for k, node in enumerate(nodes):
                    p = models[m]
                    if not level:
                        tree.weight[0] = leaf(p, g[0, 0], h[0, 0])
                    if (split := best_split(g[k], h[k], p, allowed[m])) is None:
                        continue
                    f, cut, _ = split
                    tree.feature[node], tree.cut[node] = f, cut
                    for child, part in ((2 * node + 1, slice(0, cut + 1)), (2 * node + 2, slice(cut + 1, None))):
                        tree.weight[child] = leaf(p, g[k, f, part], h[k, f, part])
                        below.append(child)
                active[m] = (tree, below)
        for m, tree in growing.items():
            out.trees[m].append(tree)
            recent[m].append(tree)
        if (turn + 1) % KEEP == 0:
            state, recent = materialise(state.mapInArrow(kept(recent), schema)), [[] for _ in models]
    return out


def _columns(p: Params, turn: int, n: int) -> np.ndarray:
    """The features a tree may split on."""
    rng = np.random.default_rng([p.seed, turn])
    out = np.zeros(n, bool)
    out[rng.permutation(n)[:max(1, round(p.columns * n))]] = True
    return out


def predict(df: DataFrame, ensemble: Ensemble, model: str = "model", name: str = "proba") -> DataFrame:
    """``df`` with the probability by the model whose number stands in column ``model``."""
    features, edges, trees = ensemble.features, ensemble.edges, ensemble.trees

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            bins, which = _binned(_matrix(b, features), edges), np.asarray(b.column(model))
            margin = np.zeros(len(b))
            for m in np.unique(which):
                at = np.flatnonzero(which == m)
                margin[at] = sum((t.values(bins[at]) for t in trees[m]), np.zeros(len(at)))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(1 / (1 + np.exp(-margin)))], [*b.schema.names, name])

    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField(name, T.DoubleType())]))
