"""Adaptive parameter search: a tree-structured Parzen estimator with successive halving over the splits.

Finished trials are parted into good and bad ones.  For each parameter two kernel densities are drawn,
candidates come from that of the good trials, and the one with the greatest ratio of the two is tried
next.  Trials go in groups; a group starts on the first split, and only its better half goes on to the
next.  The search sees trials, not data: a handful of numbers on the driver.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np


@dataclass(frozen=True)
class Range:
    """Values of one parameter from ``low`` to ``high``, whole numbers or not, on a log scale or not."""

    low: float
    high: float
    whole: bool = False
    log: bool = False

    def unit(self, value: float) -> float:
        f = math.log if self.log else float
        return (f(value) - f(self.low)) / (f(self.high) - f(self.low)) if self.high > self.low else 0.0

    def value(self, unit: float) -> float | int:
        unit = min(1.0, max(0.0, unit))
        out = math.exp(math.log(self.low) + unit * math.log(self.high / self.low)) if self.log else self.low + unit * (self.high - self.low)
        return min(int(self.high), max(int(self.low), round(out))) if self.whole else out


class Kernels:
    """Density on 0 to 1: a normal kernel at each point, as wide as the gaps to its neighbours, and a flat one."""

    def __init__(self, points: Sequence[float]):
        self.at = np.sort(np.array([0.5, *points]))
        edges = np.concatenate([[0.0], self.at, [1.0]])
        gap = np.maximum(edges[1:-1] - edges[:-2], edges[2:] - edges[1:-1])
        self.width = np.clip(gap, 1.0 / min(100, len(self.at) + 1), 1.0)
        self.width[np.searchsorted(self.at, 0.5)] = 1.0

    def draw(self, rng: np.random.Generator, n: int) -> np.ndarray:
        k = rng.integers(len(self.at), size=n)
        out = rng.normal(self.at[k], self.width[k])
        while (bad := (out < 0) | (out > 1)).any():
            out[bad] = rng.normal(self.at[k[bad]], self.width[k[bad]])
        return out

    def log_density(self, x: np.ndarray) -> np.ndarray:
        below = lambda v: np.array([0.5 * (1 + math.erf(t / math.sqrt(2))) for t in v])
        inside = below((1 - self.at) / self.width) - below(-self.at / self.width)
        z = (x[:, None] - self.at) / self.width
        return np.log((np.exp(-0.5 * z * z) / (self.width * math.sqrt(2 * math.pi) * inside)).mean(1) + 1e-12)


def propose(space: dict[str, Range], done: Sequence[tuple[dict, float]], rng: np.random.Generator,
            share: float = 0.25, candidates: int = 24) -> dict:
    """Parameters of the next trial, given (parameters, score) of the finished ones; higher scores are
    better, and a trial that is still running counts as bad with a score of minus infinity."""
    ranked = sorted(done, key=lambda t: -t[1])
    n_good = max(1, math.ceil(share * sum(s > -math.inf for _, s in ranked)))
    out = {}
    for name, span in space.items():
        good, bad = (Kernels([span.unit(p[name]) for p, _ in part]) for part in (ranked[:n_good], ranked[n_good:]))
        x = good.draw(rng, candidates)
        out[name] = span.value(float(x[np.argmax(good.log_density(x) - bad.log_density(x))]))
    return out


def search(space: dict[str, Range], evaluate: Callable[[list[tuple[int, dict]], int], dict[int, float]], trials: int = 30,
           splits: int = 3, startup: int = 10, group: int = 5, keep: float = 0.5, seed: int = 42) -> list[tuple[int, dict, int, float]]:
    """(trial, parameters, splits it was tried on, mean score), best first: more splits, then the mean.

    ``evaluate(trials, split)`` scores (number, parameters) of a group on one split.  The first
    ``startup`` trials are drawn evenly; each later group is proposed from all finished trials.
    """
    rng = np.random.default_rng(seed)
    scores: dict[int, list[float]] = {}
    params: dict[int, dict] = {}
    while len(params) < trials:
        done = [(params[t], float(np.mean(s))) for t, s in scores.items() if s]
        n = min(trials - len(params), group if done else startup)
        own = range(len(params), len(params) + n)
        for t in own:
            params[t] = propose(space, done, rng) if done else {k: r.value(rng.random()) for k, r in space.items()}
            if done:  # so that the next of the group looks elsewhere
                done.append((params[t], -math.inf))
        alive = list(own)
        for split in range(1, splits + 1):
            for t, score in evaluate([(t, params[t]) for t in alive], split).items():
                scores.setdefault(t, []).append(score)
            alive = sorted(alive, key=lambda t: (-float(np.mean(scores.get(t, [-math.inf]))), t))[:max(1, math.ceil(keep * len(alive)))]
    table = [(t, p, len(scores.get(t, [])), float(np.mean(scores[t])) if scores.get(t) else float("nan")) for t, p in params.items()]
    return sorted(table, key=lambda r: (-r[2], -r[3], r[0]))
