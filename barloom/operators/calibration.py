"""Isotonic calibration: pool-adjacent-violators in parallel, curves averaged over held-out splits.

Equal scores are summed first.  Scores are dealt out by range, each range pools its own violators, and
the ranges' blocks are dealt out again over fewer ranges until one is left.  A curve of n labels of 0
and 1 has at most about n to the power 2/3 blocks, since their means are different fractions; that is
what reaches the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.exprs import c
from ..session import materialise

BLOCK = "lo double, hi double, total double, n double"
#: Ranges that one range of the next pass takes in.
FAN_IN = 16


def pooled(lo: np.ndarray, hi: np.ndarray, total: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, ...]:
    """Neighbouring blocks whose means do not grow, as one, until all means grow."""
    while len(n) > 1:
        mean = total / n
        start = np.append(True, mean[1:] > mean[:-1])
        if start.all():
            break
        first = np.flatnonzero(start)
        last = np.append(first[1:], len(n)) - 1
        lo, hi, total, n = lo[first], hi[last], np.add.reduceat(total, first), np.add.reduceat(n, first)
    return lo, hi, total, n


def _pool(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held = tuple(np.zeros(0) for _ in range(4))
    for b in batches:
        own = (np.asarray(b.column(k).to_numpy(zero_copy_only=False), float) for k in range(4))
        held = pooled(*(np.concatenate(x) for x in zip(held, own)))
    yield pa.RecordBatch.from_arrays([pa.array(x) for x in held], ["lo", "hi", "total", "n"])


def isotonic_blocks(df: DataFrame, score: str = "proba", label: str = "label", ranges: int | None = None) -> DataFrame:
    """(lo, hi, total, n): the blocks of the isotonic fit of ``label`` on ``score``, in order.

    Rows without a score or a label are left out; no rows give no blocks.
    """
    ranges = ranges or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    blocks = df.where(c(score).isNotNull() & ~F.isnan(score) & c(label).isNotNull()) \
        .groupBy(c(score).cast("double").alias("lo")).agg(F.sum(c(label).cast("double")).alias("total"), F.count(F.lit(1)).cast("double").alias("n"))
    blocks = blocks.select("lo", c("lo").alias("hi"), "total", "n")
    while True:
        dealt = blocks.repartitionByRange(ranges, "lo") if ranges > 1 else blocks.coalesce(1)
        blocks = materialise(dealt.sortWithinPartitions("lo").mapInArrow(_pool, BLOCK))
        if ranges == 1:
            return blocks
        ranges = -(-ranges // FAN_IN)


class Curve:
    """A monotone map of scores: the blocks' means, straight lines between blocks, flat outside."""

    def __init__(self, blocks: DataFrame):
        rows = sorted(tuple(r) for r in blocks.collect())
        self.x = [v for lo, hi, _, _ in rows for v in (lo, hi)]
        self.y = [total / n for _, _, total, n in rows for _ in (0, 1)]

    def __call__(self, scores: np.ndarray) -> np.ndarray:
        return np.interp(scores, self.x, self.y) if self.x else np.full(len(scores), np.nan)


def apply(df: DataFrame, curves: dict[str, Curve], name: str = "proba") -> DataFrame:
    """``df`` without the score columns that are the keys of ``curves``, with the mean of their calibrated values."""
    keep = [f for f in df.schema.fields if f.name not in curves]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            values = [curve(np.asarray(b.column(s).to_numpy(zero_copy_only=False), float)) for s, curve in curves.items()]
            yield pa.RecordBatch.from_arrays([*[b.column(f.name) for f in keep], pa.array(np.mean(values, 0))], [*[f.name for f in keep], name])

    return df.mapInArrow(run, T.StructType([*keep, T.StructField(name, T.DoubleType())]))
