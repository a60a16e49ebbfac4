"""Point-in-time fundamentals from raw statement lines."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import ratio
from .tables import REPORT_LAG_DAYS

# Item names of a statement in order of preference.
NET_INCOME = ("Net Income Common Stockholders",
              "Net Income From Continuing Operation Net Minority Interest")
EPS = ("Diluted EPS", "Basic EPS")
REVENUE = ("Total Revenue", "Operating Revenue")
EQUITY = ("Stockholders Equity", "Common Stock Equity", "Total Equity Gross Minority Interest")


def first_item(names: Sequence[str]) -> Column:
    """Value of the first item of the list that exists, as an aggregate."""
    return F.coalesce(*[F.max(F.when(F.col("item") == n, F.col("value"))) for n in names])


def pick_items(lines: DataFrame) -> DataFrame:
    """(sym, period, ni, eps, rev, eq) from (sym, statement, item, period, value)."""
    return lines.groupBy("sym", "period").agg(
        first_item(NET_INCOME).alias("ni"), first_item(EPS).alias("eps"),
        first_item(REVENUE).alias("rev"), first_item(EQUITY).alias("eq"))


def fundamentals(lines: DataFrame, lag_days: int = REPORT_LAG_DAYS) -> DataFrame:
    """One row per symbol and fiscal year end known in both income and balance statements.

    Figures become visible ``lag_days`` after the year end.  Return on equity needs a positive
    equity; growth is against the previous period with an income figure.
    """
    per_year = Window.partitionBy("sym").orderBy("period")
    items = pick_items(lines).where(F.col("ni").isNotNull())
    items = items.withColumn("prev", F.lag("ni").over(per_year)).where(F.col("eq").isNotNull())
    return items.select(
        "sym", F.col("period").alias("fy_end"),
        F.date_add("period", lag_days).alias("avail_date"), "eps",
        F.when(F.col("eq") > 0, F.col("ni") / F.col("eq")).alias("roe"),
        (ratio("ni", "prev") - 1).alias("earn_growth"), ratio("ni", "rev").alias("profit_margin"))
