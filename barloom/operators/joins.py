"""Join operators: benchmark alignment, point-in-time fundamentals, lookups, date sampling.

No side is forced to broadcast here: the calendar-sized tables are small, Spark checks their size at run
time and falls back to a shuffled join beyond the threshold.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import windows as w
from ..functions.exprs import c, ratio


def benchmark_forward(bench: DataFrame, horizon: int, x: str = "bench") -> DataFrame:
    """(date, bench_fwd) on the benchmark's own calendar; a table as long as the calendar."""
    order = Window.orderBy("date")
    return bench.select("date", (ratio(F.lead(x, horizon).over(order), x) - 1).alias("bench_fwd"))


def excess_by_benchmark_calendar(df: DataFrame, bench: DataFrame, horizon: int) -> DataFrame:
    """Forward excess return; the benchmark is shifted first, then joined."""
    df = df.withColumn("fwd_ret", w.forward("close", horizon))
    df = df.join(benchmark_forward(bench, horizon), "date", "left")
    return df.withColumn("fwd_excess", c("fwd_ret") - c("bench_fwd"))


def excess_by_symbol_calendar(df: DataFrame, bench: DataFrame, horizon: int) -> DataFrame:
    """Forward excess return; the benchmark is joined first, then shifted along the symbol."""
    df = df.join(bench.select("date", "bench"), "date", "left")
    return df.withColumns({
        "fwd_ret": w.forward("close", horizon), "bench_fwd": w.forward("bench", horizon)}) \
        .withColumn("fwd_excess", c("fwd_ret") - c("bench_fwd"))


def benchmark_features(df: DataFrame, bench: DataFrame) -> DataFrame:
    order = Window.orderBy("date")
    b = bench.withColumns({
        "bench_ret_1": ratio("bench", F.lag("bench", 1).over(order)) - 1,
        "bench_ret_20": ratio("bench", F.lag("bench", 20).over(order)) - 1})
    last = order.rowsBetween(-19, 0)
    b = b.withColumn("bench_vol", F.when(F.count("bench_ret_1").over(last) >= 10,
                                         F.stddev_samp("bench_ret_1").over(last)))
    b = b.select("date", "bench_ret_1", "bench_ret_20", "bench_vol")
    return df.join(b, "date", "left").withColumn("rel_ret_20", c("ret_20") - c("bench_ret_20"))


def attach_fundamentals(daily: DataFrame, fund: DataFrame, load_order: str = "fy_end",
                        columns: Sequence[str] = ("avail_date", "eps", "roe", "earn_growth",
                                                  "profit_margin")) -> DataFrame:
    """As-of backward join: each row sees the last statement published on or before its date.

    Symbols without any statement are dropped; rows before the first one keep missing values.  Both
    sides are stacked and the last statement is carried along the series, so each row is shuffled
    once and nothing is multiplied; several statements on one day resolve to the last loaded.
    """
    names = [f.name for f in daily.schema.fields]
    types = {f.name: f.dataType for f in daily.schema.fields}
    published = fund.select(
        "sym", F.col("avail_date").alias("date"), F.lit(0).alias("_kind"),
        F.col(load_order).alias("_seq"),
        F.struct(*columns).alias("_info"),
        *[F.lit(None).cast(types[n]).alias(n) for n in names if n not in ("sym", "date")])
    info = published.schema["_info"].dataType
    seq = published.schema["_seq"].dataType
    rows = daily.select("*", F.lit(1).alias("_kind"), F.lit(None).cast(seq).alias("_seq"),
                        F.lit(None).cast(info).alias("_info"))
    stacked = rows.unionByName(published)
    ordered = Window.partitionBy("sym").orderBy("date", "_kind", "_seq")
    order = ordered.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = ordered.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)  # one window for both
    carried = (stacked.withColumn("_asof", F.last("_info", ignorenulls=True).over(order))
               .withColumn("_any", F.min("_kind").over(whole))
               .where((F.col("_kind") == 1) & (F.col("_any") == 0)))
    return carried.select(*names, *[F.col(f"_asof.{n}").alias(n) for n in columns])


def attach_by_interval(daily: DataFrame, fund: DataFrame, load_order: str = "fy_end") -> DataFrame:
    """The same as-of join as an equi-join on the symbol with a validity interval."""
    order = Window.partitionBy("sym").orderBy("avail_date", load_order)
    valid = fund.withColumn("_until", F.lead("avail_date").over(order)).drop(load_order)
    known = fund.select("sym").distinct()
    d, f = daily.join(known, "sym", "left_semi").alias("d"), valid.alias("f")
    on = ((F.col("d.sym") == F.col("f.sym")) & (F.col("d.date") >= F.col("f.avail_date"))
          & (F.col("f._until").isNull() | (F.col("d.date") < F.col("f._until"))))
    return d.join(f, on, "left").select("d.*", *[f"f.{n}" for n in valid.columns
                                                 if n not in ("sym", "_until")])


def every_hth_date(df: DataFrame, step: int, date: str = "date") -> DataFrame:
    """Every step-th distinct date; the numbering window sees one row per date."""
    dates = df.select(date).distinct()
    k = F.row_number().over(Window.orderBy(date))
    return dates.withColumn("_k", k).where((F.col("_k") - 1) % step == 0).select(date)


def on_rebalance_dates(df: DataFrame, step: int, date: str = "date") -> DataFrame:
    return df.join(every_hth_date(df, step, date), date, "left_semi")


def context_features(df: DataFrame, context: DataFrame, names: Sequence[str],
                     lags: Sequence[int] = (1, 5, 10), vol_min_obs: int | None = 5) -> DataFrame:
    """Returns and volatility of context series, joined by date first and computed afterwards.

    ``context`` is (symbol, date, close); prefixes drop ``^`` and ``=`` and turn ``-`` and ``/``
    to ``_``.
    """
    labels = {n: n.translate(str.maketrans({"^": None, "=": None, "-": "_", "/": "_"}))
              for n in names}
    wide = context.groupBy("date").agg(
        *[F.max(F.when(F.col("symbol") == n, F.col("close"))).alias(f"_{labels[n]}")
          for n in names])
    df = df.join(wide, "date", "left")
    for n in names:
        p = labels[n]
        df = df.withColumns({f"{p}_ret_{k}": w.change(f"_{p}", k) for k in lags})
        if vol_min_obs is not None:
            df = df.withColumn(f"_{p}_r1", w.change(f"_{p}", 1))
            df = df.withColumn(f"{p}_vol_20", w.std(f"_{p}_r1", 20, vol_min_obs))
    return df.drop(*[f"_{labels[n]}" for n in names], *[f"_{labels[n]}_r1" for n in names])


def soon(rows: DataFrame, calendar: DataFrame, days: int = 12, as_of: str = "as_of",
         lower: bool = False) -> DataFrame:
    """Flag rows whose symbol has an event date up to ``days`` after as_of.

    Past events count unless ``lower`` is set.  The calendar is reduced to one row per symbol
    before the join, so no symbol multiplies rows.
    """
    if lower:
        dates = calendar.groupBy("sym").agg(F.sort_array(F.collect_set("event_date")).alias("_d"))
        hit = F.exists("_d", lambda d: (d >= F.col(as_of)) & (d <= F.date_add(F.col(as_of), days)))
    else:
        dates = calendar.groupBy("sym").agg(F.min("event_date").alias("_d"))
        hit = F.col("_d") <= F.date_add(F.col(as_of), days)
    return (rows.join(dates, "sym", "left")
            .withColumn("earnings_soon", F.coalesce(hit, F.lit(False))).drop("_d"))


def with_names(df: DataFrame, names: DataFrame, key: str = "sym") -> DataFrame:
    """Display names, the key itself where none is known."""
    return df.join(names.select(key, "name"), key, "left").withColumn(
        "name", F.coalesce("name", key))
