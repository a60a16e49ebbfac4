"""Exponentially weighted means as sums of affine maps, in window expressions only.

A row maps the mean y to a*y + b: a fresh value x gives a = w / (w + alpha) and b = alpha * x / (w + alpha)
with w = (1 - alpha) ** (rows since the last value), a missing value leaves y as it is.  Maps compose,
so y is the sum of all earlier b, each shrunk by the a after it: with L the running sum of -ln(a),
y = sum(b * exp(L_b - L)).  The series is cut where L passes multiples of ``DEPTH``; inside such a
segment the sum is a running one, and of what lies before only the last segment can weigh anything
in double precision.

A series is bounded by the calendar and shares one sort.  Long intraday series are cut into chunks
of rows: each chunk is scanned by itself, its map goes to a table of one row a chunk, this table is
scanned the same way, and every row takes over what its chunk starts with.  No run-up is needed.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .longseries import numbered

#: Segments of this much decay (what lies two back weighs less than exp(-200)), and the most that one row adds.
DEPTH, MOST = 200.0, 230.0


@dataclass(frozen=True)
class Ewm:
    """``out`` = exponentially weighted mean of a column."""

    out: str
    source: str
    alpha: float
    min_obs: int = 0


@dataclass(frozen=True)
class Derived:
    """A column computed from earlier ones, for means of means."""

    out: str
    source: Column


def span(out: str, source: str, n: int, min_obs: int = 0) -> Ewm:
    return Ewm(out, source, 2.0 / (n + 1), min_obs)


def wilder(out: str, source: str, n: int = 14) -> Ewm:
    return Ewm(out, source, 1.0 / n, n)


def affine_scan(df: DataFrame, maps: Mapping[str, tuple[Column, Column]], by: Sequence[str], order: str) -> DataFrame:
    """Append ``out`` = exp(-decay) * (``out`` of the row before) + addend, and ``out_decay``, the sum of
    all decays so far, for every (decay, addend) of ``maps``; decays are 0 to ``MOST``."""
    rows = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    df = df.withColumns({f"{o}_decay": F.sum(decay).over(rows) for o, (decay, _) in maps.items()})
    df = df.withColumns({f"_s_{o}": F.floor(F.col(f"{o}_decay") / DEPTH) for o in maps})
    df = df.withColumns({f"_t_{o}": addend * F.exp(F.col(f"{o}_decay") - DEPTH * F.col(f"_s_{o}"))
                         for o, (_, addend) in maps.items()})
    out = {}
    for o in maps:
        segment, term = F.col(f"_s_{o}"), F.col(f"_t_{o}")
        here = F.sum(term).over(Window.partitionBy(*by, f"_s_{o}").orderBy(order)
                                .rowsBetween(Window.unboundedPreceding, Window.currentRow))
        before = F.sum(term).over(Window.partitionBy(*by).orderBy(f"_s_{o}").rangeBetween(-1, -1))
        out[o] = F.exp(DEPTH * segment - F.col(f"{o}_decay")) * (here + F.coalesce(before, F.lit(0.0)) * math.exp(-DEPTH))
    return df.withColumns(out).drop(*[f"_{x}_{o}" for o in maps for x in "st"])


def _value(source: str) -> Column:
    x = F.col(source).cast("double")
    return F.when(~F.isnan(x), x)


def _decay(rows: Column, alpha: float) -> Column:
    """-ln(a) of a value that comes ``rows`` after the last one."""
    if alpha >= 1:
        return F.lit(MOST)
    return F.least(F.log(F.pow(F.lit(1 - alpha), rows) + alpha) - rows * math.log1p(-alpha), F.lit(MOST))


def _earlier(out: str) -> Column:
    """What the segments before a row's own still weigh."""
    return F.aggregate("_ends", F.lit(0.0), lambda y, end: y + end[out]["total"] * F.exp(
        end[out]["decay"] - F.col(f"{out}_decay")))


def _short_scan(df: DataFrame, maps: Mapping[str, tuple[Column, Column]], by: Sequence[str], order: str,
                rows: int) -> DataFrame:
    """``affine_scan`` of many columns with one sort: segments of ``rows`` rows are shared by all, and a row
    adds up all segments before its own, which are few in a series that the calendar bounds."""
    upto = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    segment = F.floor((F.col("_row") - 1) / rows)
    df = df.withColumns({"_s": segment, **{f"{o}_decay": F.sum(decay).over(upto) for o, (decay, _) in maps.items()}})
    inside = Window.partitionBy(*by, "_s").orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    df = df.withColumns({f"_l_{o}": F.min(f"{o}_decay").over(inside) for o in maps})
    df = df.withColumns({f"_t_{o}": F.sum(addend * F.exp(F.col(f"{o}_decay") - F.col(f"_l_{o}"))).over(inside)
                         for o, (_, addend) in maps.items()})
    last = F.when(F.col("_row") % rows == 0, F.struct(*[
        F.struct(F.col(f"_t_{o}").alias("total"), F.col(f"_l_{o}").alias("decay")).alias(o) for o in maps]))
    df = df.withColumn("_ends", F.collect_list(last).over(
        Window.partitionBy(*by).orderBy("_s").rangeBetween(Window.unboundedPreceding, -1)))
    out = {}
    for o in maps:
        out[o] = F.col(f"_t_{o}") * F.exp(F.col(f"_l_{o}") - F.col(f"{o}_decay")) + _earlier(o)
    return df.withColumns(out).drop("_s", "_ends", *[f"_{x}_{o}" for o in maps for x in "lt"])


def _pass(df: DataFrame, steps: Sequence[Ewm], by: Sequence[str], order: str, row: str, short: bool) -> DataFrame:
    """Append the means inside each group of ``by``, with ``_n_`` (values so far), ``_p_`` (row of the value
    before this row) and the decay since the first value."""
    before = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    seen, maps = {}, {}
    for source in dict.fromkeys(s.source for s in steps):
        x = _value(source)
        seen[f"_before_{source}"] = F.last(F.when(x.isNotNull(), F.col(row)), ignorenulls=True).over(before)
        seen[f"_count_{source}"] = F.count(x).over(upto)
    df = df.withColumns(seen).withColumns({f"_{x}_{s.out}": F.col(f"_{name}_{s.source}") for s in steps
                                           for x, name in (("p", "before"), ("n", "count"))}).drop(*seen)
    for s in steps:
        x, last = _value(s.source), F.col(f"_p_{s.out}")
        gap, fresh = F.col(row) - last, x.isNotNull() & last.isNotNull()
        weight = F.pow(F.lit(1 - s.alpha), gap)
        maps[s.out] = (F.when(fresh, _decay(gap, s.alpha)).otherwise(0.0),
                       F.when(fresh, s.alpha * x / (weight + s.alpha)).otherwise(F.coalesce(x, F.lit(0.0))))
    fastest = max(MOST if s.alpha >= 1 else -math.log1p(-s.alpha) for s in steps)
    if short and fastest <= DEPTH / 8:
        return _short_scan(df, maps, by, order, int(DEPTH / fastest))
    return affine_scan(df, maps, by, order)


def _carried(df: DataFrame, steps: Sequence[Ewm], key: str, order: str) -> DataFrame:
    """Means of rows that have ``_chunk`` and ``_row``: chunk by chunk, then what each chunk starts with."""
    df = _pass(df, steps, [key, "_chunk"], order, "_row", False)
    facts = []
    for s in steps:
        value = _value(s.source)
        at = F.when(value.isNotNull(), F.col("_row"))
        facts += [F.min_by(value, at).alias(f"_f_{s.out}"), F.min(at).alias(f"_a_{s.out}"), F.max(at).alias(f"_z_{s.out}"),
                  F.max_by(s.out, "_row").alias(f"_y_{s.out}"), F.max(f"_n_{s.out}").alias(f"_c_{s.out}"),
                  F.max(f"{s.out}_decay").alias(f"_d_{s.out}")]
    chunks = df.groupBy(key, "_chunk").agg(*facts)
    before = Window.partitionBy(key).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    chunks = chunks.withColumns({
        **{f"_p_{s.out}": F.last(f"_z_{s.out}", ignorenulls=True).over(before) for s in steps},
        **{f"_m_{s.out}": F.coalesce(F.sum(f"_c_{s.out}").over(before), F.lit(0)) for s in steps}})
    # decay of the chunk's first value; a chunk without values or with nothing before it carries nothing into its values
    first = {s.out: F.when(F.col(f"_a_{s.out}").isNotNull() & F.col(f"_p_{s.out}").isNotNull(),
                           _decay(F.col(f"_a_{s.out}") - F.col(f"_p_{s.out}"), s.alpha)) for s in steps}
    chunks = chunks.withColumns({f"_e_{o}": d for o, d in first.items()})
    total = {s.out: F.when(F.col(f"_e_{s.out}").isNotNull(), F.least(F.col(f"_d_{s.out}") + F.col(f"_e_{s.out}"), F.lit(MOST)))
             for s in steps}
    chunks = affine_scan(chunks, {f"_k_{o}": (
        F.coalesce(d, F.lit(0.0)),
        F.when(F.col(f"_a_{o}").isNull(), 0.0).otherwise(F.col(f"_y_{o}") - F.coalesce(F.exp(-d) * F.col(f"_f_{o}"), F.lit(0.0))))
        for o, d in total.items()}, [key], "_chunk")
    starts = Window.partitionBy(key).orderBy("_chunk")
    chunks = chunks.select(F.col(key).alias("_key"), F.col("_chunk").alias("_at"), *[x for s in steps for x in (
        F.lag(f"_k_{s.out}").over(starts).alias(f"_k_{s.out}"), F.col(f"_m_{s.out}"), F.col(f"_e_{s.out}"), F.col(f"_f_{s.out}"))])
    df = df.join(chunks, F.col(key).eqNullSafe(F.col("_key")) & (F.col("_chunk") == F.col("_at")))
    new = {}
    for s in steps:
        carry = F.col(f"_k_{s.out}")
        grown = F.col(s.out) + F.exp(-F.col(f"{s.out}_decay") - F.col(f"_e_{s.out}")) * (carry - F.col(f"_f_{s.out}"))
        new[s.out] = F.when(F.col(f"_m_{s.out}") == 0, F.col(s.out)).when(F.col(f"_n_{s.out}") == 0, carry).otherwise(grown)
        new[f"_n_{s.out}"] = F.col(f"_n_{s.out}") + F.col(f"_m_{s.out}")
    return df.withColumns(new)


def ewm(df: DataFrame, steps: Sequence[Ewm | Derived], key: str = "sym", order: str = "date",
        drop: Sequence[str] = (), block_rows: int | None = None,
        unit: str = "month") -> DataFrame:
    """Append the means of ``steps`` (evaluated in turn) to every row.

    Missing values (null and NaN) keep the mean and age it; a mean of fewer than ``min_obs`` values is
    null.  ``block_rows``: cut each series into chunks of so many rows (rows are unique by ``order``).
    """
    names = df.columns
    if block_rows is None:
        df = df.withColumn("_row", F.row_number().over(Window.partitionBy(key).orderBy(order)).cast("long"))
    else:
        df = numbered(df, key, order, unit, "_row").withColumn("_row", F.col("_row").cast("long"))
        df = df.withColumn("_chunk", F.floor((F.col("_row") - 1) / block_rows))
    some: list[Ewm] = []

    def flush(df: DataFrame) -> DataFrame:
        if some:
            df = _pass(df, some, [key], order, "_row", True) if block_rows is None else _carried(df, some, key, order)
            df = df.withColumns({s.out: F.when(F.col(f"_n_{s.out}") >= max(s.min_obs, 1), F.col(s.out)) for s in some})
            aside = [f"{s.out}_decay" for s in some] + [f"_{x}_{s.out}" for s in some for x in "npkmef"]
            df = df.drop(*aside, "_key", "_at")
            some.clear()
        return df

    for step in steps:
        if isinstance(step, Derived):
            df = flush(df).withColumn(step.out, step.source)
        else:
            if step.source in [s.out for s in some]:
                df = flush(df)
            some.append(step)
    return flush(df).select(*names, *[s.out for s in steps if s.out not in drop])
