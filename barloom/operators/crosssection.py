"""Cross-sectional operators: ranks, quantiles, buckets and scores within a date.

How many names share a date is not bounded by the calendar, so every operator takes ``bound``: the
caller's statement of how many rows a group has at most.  With one the group is one window partition.
Without one the split path runs: equal values collapse to cells, cells are dealt out by ranges of
(group, value), ranges are counted in parallel, and the few range totals are accumulated per group.
No task then sees more than about one range, however large a date is.  Both paths give the same rows,
with missing scores, repeated keys and NaN too; only the caller chooses between them.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.exprs import c, ratio
from ..session import materialise

RANGE_CELLS = 1_000_000
TIE_DIGITS = 12


def fits(bound: int | None) -> bool:
    return bound is not None


def _list(x: str | Sequence[str]) -> list[str]:
    return [x] if isinstance(x, str) else list(x)


def same(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Join on equal keys, a missing key being equal to a missing key; the left keys stay."""
    renamed = right.withColumnsRenamed({k: f"_right_{k}" for k in keys})
    on = F.lit(True)
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"_right_{k}"))
    return left.join(renamed, on, how).drop(*[f"_right_{k}" for k in keys])


def numbered_rows(df: DataFrame) -> DataFrame:
    """The rows with a number ``_row`` of their own, checkpointed so that every reader sees the same."""
    return materialise(df.withColumn("_row", F.monotonically_increasing_id()))


# ---- the primitive -------------------------------------------------------------------------
def below(cells: DataFrame, group: Sequence[str], value: str, measures: Sequence[str],
          bound: int | None = None, range_cells: int = RANGE_CELLS,
          stable: bool = False) -> DataFrame:
    """For unique (group, value) cells: each measure summed over smaller values, and its total.

    Adds ``<m>_below`` and ``<m>_total``.  The split path counts the cells to choose the number of
    ranges and deals them out, so they are checkpointed unless the caller already works on ``stable``
    (checkpointed) rows.
    """
    group = _list(group)
    if fits(bound):
        ordered = Window.partitionBy(*group).orderBy(value)
        before = ordered.rowsBetween(Window.unboundedPreceding, -1)
        whole = ordered.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        out = {}
        for m in measures:
            out[f"{m}_below"] = F.coalesce(F.sum(m).over(before), F.lit(0))
            out[f"{m}_total"] = F.sum(m).over(whole)
        return cells.withColumns(out)

    cells = cells if stable else materialise(cells)
    ranges = max(int(cells.sparkSession.conf.get("spark.sql.shuffle.partitions")),
                 -(-cells.count() // range_cells))
    placed = materialise(cells.repartitionByRange(ranges, *group, value)
                         .withColumn("_range", F.spark_partition_id()))
    inside = (Window.partitionBy(*group, "_range").orderBy(value)
              .rowsBetween(Window.unboundedPreceding, -1))
    local = placed.withColumns(
        {f"_{m}_local": F.coalesce(F.sum(m).over(inside), F.lit(0)) for m in measures})
    totals = placed.groupBy(*group, "_range").agg(*[F.sum(m).alias(m) for m in measures])
    across = Window.partitionBy(*group).orderBy("_range")
    starts = totals.select(
        *group, "_range",
        *[F.coalesce(F.sum(m).over(across.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
          .alias(f"_{m}_start") for m in measures],
        *[F.sum(m).over(across.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
          .alias(f"{m}_total") for m in measures])
    joined = same(local, starts, [*group, "_range"])
    return joined.select(
        *cells.columns,
        *[(F.col(f"_{m}_start") + F.col(f"_{m}_local")).alias(f"{m}_below") for m in measures],
        *[F.col(f"{m}_total") for m in measures])


def _value_counts(rows: DataFrame, group: Sequence[str], value: str, range_cells: int,
                  stable: bool = True) -> DataFrame:
    cells = rows.groupBy(*group, value).agg(F.count(F.lit(1)).alias("ties"))
    return below(cells, group, value, ["ties"], None, range_cells, stable)


def _pct(smaller, ties, n) -> Column:
    """Average-rank percentile."""
    return (smaller + 1 + (ties - 1) / 2.0) / n


def peers(x: str, by: Sequence[str]) -> Column:
    """Average-rank percentile of a bounded group as one window expression."""
    ordered = Window.partitionBy(*by).orderBy(F.col(x).asc_nulls_last())
    ties = F.count(x).over(ordered.rangeBetween(Window.currentRow, Window.currentRow))
    n = F.count(x).over(ordered.rangeBetween(Window.unboundedPreceding,
                                             Window.unboundedFollowing))
    return F.when(F.col(x).isNotNull(), _pct(F.rank().over(ordered) - 1, ties, n))


# ---- ranks ---------------------------------------------------------------------------------
def rank_pct(df: DataFrame, ranks: Mapping[str, str], by: str | Sequence[str] = "date",
             bound: int | None = None, range_cells: int = RANGE_CELLS) -> DataFrame:
    """Append average-rank percentiles ``{new column: ranked column}`` within each group.

    Missing values keep a missing rank and do not count.
    """
    by = _list(by)
    if fits(bound):
        return df.withColumns({out: peers(x, by) for out, x in ranks.items()})
    df = numbered_rows(df)
    return df.join(_split_ranks(df, ranks, by, ["_row"], range_cells), "_row", "left").drop("_row")


def _split_ranks(stable: DataFrame, ranks: Mapping[str, str], by: Sequence[str],
                 keys: Sequence[str], range_cells: int) -> DataFrame:
    """(keys, ranks) of checkpointed rows; all ranked columns share one set of shuffles."""
    pairs = F.array(*[F.struct(F.lit(i).alias("_name"), c(x).cast("double").alias("_v"))
                      for i, x in enumerate(ranks.values())])
    extra = [b for b in by if b not in keys]
    long = stable.select(*keys, *extra, F.inline(pairs)).where(F.col("_v").isNotNull())
    counts = _value_counts(long, [*by, "_name"], "_v", range_cells)
    ranked = same(long, counts, [*by, "_name", "_v"]).withColumn(
        "_pct", _pct(F.col("ties_below"), F.col("ties"), F.col("ties_total")))
    return ranked.groupBy(*keys).agg(
        *[F.max(F.when(F.col("_name") == i, F.col("_pct"))).alias(out) for i, out in enumerate(ranks)])


Composites = Mapping[str, tuple[Callable, Sequence[str]]]


def narrow_ranks(df: DataFrame, ranks: Mapping[str, str], by: str | Sequence[str] = "date",
                 composites: Composites | None = None) -> DataFrame:
    """The ranks of ``rank_pct`` with a bound, the composites and the ranks of these, ``rank_<composite>``.

    ``composites`` is ``{name: (formula, rank columns)}``; a value is rounded to ``TIE_DIGITS``.  Every row
    moves once, to its group, and a group is ranked column by column as plain numbers in one task, so
    neither the ranked columns nor the composites are sorted or written along with whole rows.  The bound
    states what such a task holds: about 25 numbers for each row of a group.
    """
    composites = composites or {}
    out = [*ranks, *composites, *[f"rank_{name}" for name in composites]]
    schema = T.StructType([*df.schema.fields, *[T.StructField(name, T.DoubleType()) for name in out]])

    def ranked(rows: pa.Table) -> pa.Table:
        found = {name: _percentiles(*_numbers(rows[x])) for name, x in ranks.items()}
        for name, (formula, inputs) in composites.items():
            found[name] = half_up(formula(*[found[x] for x in inputs]), TIE_DIGITS)
        for name in composites:
            found[f"rank_{name}"] = _percentiles(found[name], ~np.isnan(found[name]))
        for name in out:
            rows = rows.append_column(name, pa.array(found[name], from_pandas=True))
        return rows

    return df.groupBy(*_list(by)).applyInArrow(ranked, schema)


def _numbers(x: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Values and where they are known; NaN is a value."""
    return x.cast(pa.float64(), safe=False).to_numpy(), x.is_valid().to_numpy()


def _percentiles(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    """``peers`` of one group, NaN where nothing is known: NaN is the largest value, 0.0 is -0.0."""
    out, x = np.full(len(values), np.nan), values[known]
    if len(x):
        order = np.argsort(x, kind="stable")
        x = x[order]
        new = np.append(True, (x[1:] != x[:-1]) & ~(np.isnan(x[1:]) & np.isnan(x[:-1])))
        smaller = np.flatnonzero(new)
        ties = np.diff(np.append(smaller, len(x)))
        out[np.flatnonzero(known)[order]] = np.repeat(_pct(smaller, ties, len(x)), ties)
    return out


def half_up(x: np.ndarray, digits: int) -> np.ndarray:
    """``F.round`` of numbers, to at most 12 digits; NaN stays."""
    size, scale = np.abs(x), 10.0 ** digits
    with np.errstate(invalid="ignore"):
        scaled = size * scale
        out = np.copysign(np.floor(scaled + 0.5) / scale, x)
        # where the product is too coarse to tell, the decimal form of the number decides
        near = np.abs(scaled - np.floor(scaled) - 0.5) < 0.001 * max(1.0, np.fmax.reduce(size, initial=0.0))
    unit = Decimal(1).scaleb(-digits)
    out[near] = [float(Decimal(repr(v)).quantize(unit, ROUND_HALF_UP)) for v in x[near].tolist()]
    return out + 0.0  # no negative zero


def ordinal(df: DataFrame, score: str, by: str | Sequence[str] = "date", tie: str = "sym",
            bound: int | None = None, name: str = "rank",
            range_cells: int = RANGE_CELLS) -> DataFrame:
    """1, 2, 3, ... by falling score, ties by ``tie`` rising; missing scores come last.

    Rows alike in group, score and ``tie`` are numbered in no given order.
    """
    by = _list(by)
    if fits(bound):
        order = Window.partitionBy(*by).orderBy(F.col(score).desc(), F.col(tie).asc())
        return df.withColumn(name, F.row_number().over(order).cast("bigint"))
    # a missing score is below all others, a missing tie before all others, a row's own number decides last
    known = lambda x: F.struct(F.col(x).isNotNull().alias("known"), F.col(x).alias("value"))
    df = numbered_rows(df)
    rows = df.select("_row", *by, known(score).alias("_s"), F.struct(known(tie).alias("tie"), "_row").alias("_t"))
    counts = _value_counts(rows, by, "_s", range_cells).select(
        *by, "_s", (F.col("ties_total") - F.col("ties_below") - F.col("ties")).alias("_above"))
    within = _value_counts(rows, [*by, "_s"], "_t", range_cells).select(
        F.col("_t._row").alias("_row"), *by, "_s", F.col("ties_below").alias("_before"))
    places = same(within, counts, [*by, "_s"]).select("_row", (F.col("_above") + F.col("_before") + 1).alias(name))
    return df.join(places, "_row").drop("_row")


def top_k(df: DataFrame, score: str, k: int, by: str | Sequence[str] = "date", tie: str = "sym",
          ascending: bool = False, name: str = "pick") -> DataFrame:
    """The k best rows per group; Spark cuts to k rows per task before the shuffle."""
    best = F.col(score).asc() if ascending else F.col(score).desc()
    order = Window.partitionBy(*_list(by)).orderBy(best, F.col(tie).asc())
    return (df.where(F.col(score).isNotNull()).withColumn(name, F.row_number().over(order))
            .where(F.col(name) <= k))


# ---- quantiles and buckets -----------------------------------------------------------------
def quantile_table(df: DataFrame, value: str, qs: Sequence[float], by: str | Sequence[str] = "date",
                   bound: int | None = None, range_cells: int = RANGE_CELLS) -> DataFrame:
    """One row per group with linearly interpolated quantiles in the array ``q``."""
    by = _list(by)
    if fits(bound):
        return (df.where(F.col(value).isNotNull()).groupBy(*by)
                .agg(F.percentile(value, F.array(*[F.lit(float(q)) for q in qs])).alias("q")))
    if not by:
        whole = quantile_table(df.withColumn("_all", F.lit(0)), value, qs, "_all", None, range_cells)
        return whole.drop("_all")
    rows = df.where(F.col(value).isNotNull()).select(*by, value)
    counts = _value_counts(rows, by, value, range_cells, stable=False)
    last = F.col("ties_below") + F.col("ties") - 1
    cols = []
    for i, q in enumerate(qs):
        at = (F.col("ties_total") - 1) * F.lit(float(q))
        for side, p in (("lo", F.floor(at)), ("hi", F.ceil(at))):
            hit = (F.col("ties_below") <= p) & (p <= last)
            cols.append(F.max(F.when(hit, F.col(value))).alias(f"{side}{i}"))
    sides = counts.groupBy(*by).agg(F.max("ties_total").alias("n"), *cols)

    def between(i: int, q: float) -> Column:
        at = (F.col("n") - 1) * F.lit(float(q))
        lo, hi = F.col(f"lo{i}"), F.col(f"hi{i}")
        return F.when(lo == hi, lo).otherwise(
            (F.ceil(at) - at) * lo + (at - F.floor(at)) * hi)

    return sides.select(*by, F.array(*[between(i, q) for i, q in enumerate(qs)]).alias("q"))


def with_quantiles(df: DataFrame, value: str, named: Mapping[str, float],
                   by: str | Sequence[str] = "date", bound: int | None = None,
                   range_cells: int = RANGE_CELLS) -> DataFrame:
    """Append group quantiles as columns ``{name: q}``."""
    by = _list(by)
    qs = list(named.values())
    if fits(bound):
        arr = F.percentile(value, F.array(*[F.lit(float(q)) for q in qs])).over(
            Window.partitionBy(*by))
        return df.withColumn("_q", arr).withColumns(
            {n: F.col("_q")[i] for i, n in enumerate(named)}).drop("_q")
    table = quantile_table(df, value, qs, by, None, range_cells).select(
        *by, *[F.col("q")[i].alias(n) for i, n in enumerate(named)])
    return same(df, table, by, "left")


def bucket_of(x: Column, edges: Column) -> Column:
    """Right-closed bucket index for linear-quantile edges; equal edges merge."""
    distinct = F.array_distinct(F.transform(edges, lambda e: e + F.lit(0.0)))  # -0.0 is 0.0
    return F.when(x.isNotNull(), F.greatest(
        F.size(F.filter(distinct, lambda e: e < x)) - 1, F.lit(0)))


def quantile_cut(df: DataFrame, value: str, n: int = 5, by: str | Sequence[str] = "date",
                 bound: int | None = None, name: str = "bucket",
                 range_cells: int = RANGE_CELLS) -> DataFrame:
    """Equal-frequency buckets 0..n-1 per group (or overall with ``by=()``)."""
    by = _list(by)
    qs = [i / n for i in range(n + 1)]
    if fits(bound):
        edges = F.percentile(value, F.array(*[F.lit(q) for q in qs])).over(
            Window.partitionBy(*by))
        return df.withColumn("_e", edges).withColumn(
            name, bucket_of(F.col(value), F.col("_e"))).drop("_e")
    table = quantile_table(df, value, qs, by, None, range_cells).withColumnRenamed("q", "_e")
    joined = same(df, table, by, "left") if by else df.withColumn("_e", table.select("_e").scalar())
    return joined.withColumn(name, bucket_of(F.col(value), F.col("_e"))).drop("_e")


# ---- scores --------------------------------------------------------------------------------
def zscore(df: DataFrame, columns: Sequence[str], by: str = "date", bound: int | None = None,
           missing: float | None = 0.0, suffix: str = "") -> DataFrame:
    """(x - mean) / sample deviation per group; 0 where the group has no spread."""

    def scaled(x, mu, sd, lo, hi):
        z = F.when(hi > lo, ratio(c(x) - mu, sd)).otherwise(F.when(c(x).isNotNull(), F.lit(0.0)))
        return z if missing is None else F.coalesce(z, F.lit(missing))

    if fits(bound):
        w = Window.partitionBy(by)
        return df.withColumns({x + suffix: scaled(
            x, F.avg(x).over(w), F.stddev_samp(x).over(w), F.min(x).over(w), F.max(x).over(w))
            for x in columns})
    stats = df.groupBy(by).agg(*[f(x).alias(f"_{n}_{x}") for x in columns for n, f in (
        ("mu", F.avg), ("sd", F.stddev_samp), ("lo", F.min), ("hi", F.max))])
    joined = same(df, stats, [by], "left")
    scored = joined.withColumns({x + suffix: scaled(
        x, c(f"_mu_{x}"), c(f"_sd_{x}"), c(f"_lo_{x}"), c(f"_hi_{x}")) for x in columns})
    return scored.drop(*[f"_{n}_{x}" for x in columns for n in ("mu", "sd", "lo", "hi")])


def mean_mr(mom, rev):
    """Momentum plus reversal, of columns or numbers."""
    return (mom + rev) / 2


def mean_fund3(rev, flow, value):
    """Reversal, inverted delivery flow and earnings yield, of columns or numbers."""
    return (rev + (1 - flow) + value) / 3


#: The composites as ``narrow_ranks`` takes them.
COMPOSITES: Composites = {"score_mr": (mean_mr, ("rank_mom_12_1", "rank_rev")),
                          "score_fund3": (mean_fund3, ("rank_rev", "rank_deliv_x_ret", "rank_earn_yield"))}


def composite_mr(mom: str = "rank_mom_12_1", rev: str = "rank_rev") -> Column:
    """Rounded so that equal rank sums tie exactly."""
    return F.round(mean_mr(c(mom), c(rev)), TIE_DIGITS)


def composite_fund3(rev: str = "rank_rev", flow: str = "rank_deliv_x_ret",
                    value: str = "rank_earn_yield") -> Column:
    return F.round(mean_fund3(c(rev), c(flow), c(value)), TIE_DIGITS)


def correlation(x: str, y: str) -> Column:
    """Pearson correlation as an aggregate; missing for a constant side."""
    return F.covar_pop(x, y) / F.nullif(F.stddev_pop(x) * F.stddev_pop(y), F.lit(0.0))


def factor_ic(df: DataFrame, factor: str, target: str = "fwd_excess", method: str = "spearman",
              by: str = "date", min_names: int = 6, bound: int | None = None,
              key: str = "sym") -> DataFrame:
    """One row: mean correlation per date and the number of dates it is known for.

    Dates overlap when the target spans several of them; test significance on every h-th date.
    """
    if method == "spearman":
        per = information_coefficient(df, [factor], target, by, min_names, bound, key=key)
    elif method == "pearson":
        known = df.where(c(factor).isNotNull() & c(target).isNotNull())
        per = (known.groupBy(by).agg(correlation(factor, target).alias("ic"),
                                     F.count(F.lit(1)).alias("n"))
               .where((F.col("n") >= min_names) & F.col("ic").isNotNull()))
    else:
        raise ValueError(f"unknown method {method!r}")
    return per.agg(F.avg("ic").alias("mean_ic"), F.count(F.lit(1)).alias("n_dates"))


def information_coefficient(df: DataFrame, factors: Sequence[str], target: str = "fwd_excess",
                            by: str = "date", min_names: int = 6, bound: int | None = None,
                            range_cells: int = RANGE_CELLS, key: str = "sym") -> DataFrame:
    """Rank correlation of each factor with the target per group: (by, factor, ic, n).

    Ranks are taken among rows where factor and target are both known; groups with fewer than
    ``min_names`` such rows are left out, as are constant groups.
    """
    pairs = F.array(*[F.struct(F.lit(f).alias("factor"), c(f).cast("double").alias("x"))
                      for f in factors])
    long = (df.where(c(target).isNotNull())
            .select(key, by, c(target).cast("double").alias("y"), F.inline(pairs))
            .where(F.col("x").isNotNull()))
    group = [by, "factor"]
    if fits(bound):
        ranked = long.withColumns({"rx": peers("x", group), "ry": peers("y", group)})
    else:
        ranked = _split_ranks(numbered_rows(long), {"rx": "x", "ry": "y"}, group, ["_row", *group],
                              range_cells)
    return (ranked.groupBy(*group)
            .agg(correlation("rx", "ry").alias("ic"), F.count(F.lit(1)).alias("n"))
            .where((F.col("n") >= min_names) & F.col("ic").isNotNull()))
