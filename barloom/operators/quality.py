"""Data-quality gates of a release: (gate, passed, detail) rows."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.exprs import c

# Required columns of the released tables.
PANEL_COLUMNS = ("date", "sym", "close", "volume", "deliv_pct")
FUNDAMENTAL_COLUMNS = ("sym", "fy_end", "avail_date", "eps", "roe")


class GateFailure(ValueError):
    """A release did not pass its gates."""


def coverage(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Share of known values per column: (factor, coverage); one pass over the table."""
    wide = df.agg(*[F.avg(c(x).isNotNull().cast("double")).alias(x) for x in columns])
    return wide.unpivot([], list(columns), "factor", "coverage")


def missing_bars(bars: DataFrame, calendar: DataFrame) -> DataFrame:
    """(sym, date) of the calendar without a bar.

    Each symbol's known dates are a calendar-sized set, taken out of the calendar's own set.
    """
    have = bars.groupBy("sym").agg(F.collect_set("date").alias("_have"))
    full = calendar.agg(F.collect_set("date")).scalar()
    gaps = have.withColumn("_all", full)
    return gaps.select("sym", F.explode(F.array_except("_all", "_have")).alias("date"))


def schema_gate(panel: DataFrame, fund: DataFrame) -> DataFrame:
    absent = sorted((set(PANEL_COLUMNS) - set(panel.columns))
                    | (set(FUNDAMENTAL_COLUMNS) - set(fund.columns)))
    if absent:
        row = ("schema", False, f"missing columns: {absent}")
    elif not isinstance(panel.schema["date"].dataType, (T.DateType, T.TimestampType,
                                                        T.TimestampNTZType)):
        row = ("schema", False, "panel.date is not a date")
    else:
        row = ("schema", True, f"{len(panel.columns)} panel columns")
    return panel.sparkSession.createDataFrame([row], "gate string, passed boolean, detail string")


def no_look_ahead(fund: DataFrame) -> DataFrame:
    """Statements become visible only after their fiscal year ends."""
    bad = F.count_if(c("avail_date") <= c("fy_end"))
    return fund.agg(bad.alias("n")).select(
        F.lit("no_lookahead").alias("gate"), (c("n") == 0).alias("passed"),
        F.concat(c("n"), F.lit(" rows with avail_date <= fy_end")).alias("detail"))


def return_sanity(factors: DataFrame, columns: Sequence[str] = ("ret_20", "fwd_excess"),
                  spike: float = 10.0) -> DataFrame:
    """No return below -100% and none beyond the spike limit."""
    worst = factors.agg(*[F.count_if(c(x) < -1.0).alias(f"low_{x}") for x in columns],
                        *[F.max(F.abs(x)).alias(f"max_{x}") for x in columns])
    bad = reduce(lambda a, b: a | b, [
        (c(f"low_{x}") > 0) | F.coalesce(c(f"max_{x}") > spike, F.lit(False)) for x in columns])
    low = reduce(lambda a, b: a + b, [c(f"low_{x}") for x in columns])
    return worst.select(F.lit("returns_sanity").alias("gate"), (~bad).alias("passed"),
                        F.concat(low, F.lit(" values below -100%")).alias("detail"))


def duplicates(panel: DataFrame) -> DataFrame:
    per_key = panel.groupBy("sym", "date").agg(F.count(F.lit(1)).alias("k"))
    extra = F.coalesce(F.sum(c("k") - 1), F.lit(0))
    return per_key.agg(extra.alias("n")).select(
        F.lit("duplicates").alias("gate"), (c("n") == 0).alias("passed"),
        F.concat(c("n"), F.lit(" duplicate (sym, date) rows")).alias("detail"))


def coverage_gate(factors: DataFrame, columns: Sequence[str], least: float = 0.30) -> DataFrame:
    weak = coverage(factors, columns).agg(
        F.count_if(c("coverage") < least).alias("n"),
        F.array_join(F.array_sort(F.collect_list(F.when(c("coverage") < least, c("factor")))), ", ")
        .alias("names"))
    return weak.select(F.lit("coverage").alias("gate"), (c("n") == 0).alias("passed"),
                       F.concat(F.lit("below limit: "), c("names")).alias("detail"))


def all_gates(panel: DataFrame, fund: DataFrame, factors: DataFrame,
              ranked: Sequence[str]) -> DataFrame:
    gates = [schema_gate(panel, fund), no_look_ahead(fund), return_sanity(factors),
             duplicates(panel), coverage_gate(factors, ranked)]
    return reduce(DataFrame.unionByName, gates)


def enforce(gates: DataFrame) -> None:
    """Raise when a gate failed; there are five rows to look at."""
    failed = [r["gate"] for r in gates.where(~c("passed")).collect()]
    if failed:
        raise GateFailure(f"gates failed: {', '.join(sorted(failed))}")
