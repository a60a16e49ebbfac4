"""Train and test splits over time: purged walk-forward, sliding windows, expanding blocks.

Fold tables are small (at most one fold per month); rows are matched to folds by arithmetic on the
row number or by date ranges, never by looping over rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import c, ratio


def walk_forward_folds(df: DataFrame, test_months: int = 2, embargo_days: int = 10,
                       first: int = 12, min_train: int = 5000, date: str = "date") -> DataFrame:
    """Purged expanding folds: (fold, train_end, test_start, test_end, n_train, n_test).

    The first ``first`` months only train; a test block covers ``test_months`` of the months that
    occur; training stops ``embargo_days + 5`` days before the test; a last month alone starts no
    fold; folds with too few training rows or no test row are left out before numbering.
    """
    days = df.groupBy(date).agg(F.count(F.lit(1)).alias("_n"))
    months = days.select(F.trunc(date, "month").alias("m")).distinct()
    order = Window.orderBy("m")
    months = months.withColumns({
        "pos": F.row_number().over(order) - 1, "total": F.count(F.lit(1)).over(Window.partitionBy()),
        "last": F.max("m").over(order.rowsBetween(0, test_months - 1))})
    start = ((c("pos") >= first) & ((c("pos") - first) % test_months == 0)
             & (c("pos") < c("total") - 1))
    folds = months.where(start).select(
        c("pos"), F.date_sub("m", embargo_days + 5).alias("train_end"), c("m").alias("test_start"),
        F.last_day("last").alias("test_end"))
    # Rows before each border: borders are stacked with the days and one running sum serves all.
    border = lambda name, day: F.struct(F.lit(name).alias("b"), day.alias("_d"))
    borders = folds.select("*", F.inline(F.array(
        border("train", c("train_end")), border("from", c("test_start")),
        border("to", F.date_add("test_end", 1)))))
    stacked = days.select(c(date).alias("_d"), "_n").unionByName(
        borders.withColumn("_n", F.lit(0)), allowMissingColumns=True)
    before = F.sum("_n").over(Window.orderBy("_d", c("b").isNull())
                              .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    at = stacked.withColumn("_before", before).where(c("b").isNotNull())
    count = lambda name: F.max(F.when(c("b") == name, c("_before")))
    sized = at.groupBy("pos", "train_end", "test_start", "test_end").agg(
        count("train").alias("n_train"), (count("to") - count("from")).alias("n_test"))
    kept = sized.where((c("n_train") >= min_train) & (c("n_test") > 0))
    return kept.select(F.row_number().over(Window.orderBy("pos")).alias("fold"), "train_end",
                       "test_start", "test_end", "n_train", "n_test")


def _numbered(df: DataFrame) -> DataFrame:
    w = Window.partitionBy("sym")
    return df.withColumns({"_i": F.row_number().over(w.orderBy("date")) - 1,
                           "_n": F.count(F.lit(1)).over(w)})


def sliding_windows(df: DataFrame, train: int, test: int) -> DataFrame:
    """Rows with (fold, role): fixed training window, next ``test`` rows, moved by ``test``.

    A row trains in every fold whose window covers it, so it is repeated train / test times.
    """
    rows = _numbered(df)
    last = F.floor((c("_n") - train) / test).cast("int")
    tested = F.floor((c("_i") - train) / test).cast("int") + 1
    lo = F.greatest(F.lit(1), F.ceil((c("_i") - train + 1) / test).cast("int") + 1)
    hi = F.least(last, F.floor(c("_i") / test).cast("int") + 1)
    trains = F.when(hi >= lo, F.sequence(lo, hi)).otherwise(F.array().cast("array<int>"))
    roles = F.concat(
        F.transform(trains, lambda f: F.struct(f.alias("fold"), F.lit("train").alias("role"))),
        F.when((c("_i") >= train) & (tested <= last),
               F.array(F.struct(tested.alias("fold"), F.lit("test").alias("role"))))
        .otherwise(F.array().cast("array<struct<fold:int,role:string>>")))
    return rows.select(*df.columns, F.inline(roles))


def steps(df: DataFrame, start: int, step: int, horizon: int) -> DataFrame:
    """Every step-th row of a series from ``start`` on that still has ``horizon`` rows ahead."""
    rows = _numbered(df)
    ok = ((c("_i") >= start) & (c("_i") < c("_n") - horizon) & ((c("_i") - start) % step == 0))
    return rows.where(ok).drop("_i", "_n")


def tail_split(df: DataFrame, share: float = 0.8, longest: int = 100, least: int = 30) -> DataFrame:
    """Rows with role core or validation: the last fifth, at most ``longest``, at least ``least``."""
    rows = _numbered(df)
    cut = F.greatest(F.floor(c("_n") * share), c("_n") - longest)
    cut = F.when(c("_n") - cut < least, c("_n") - least).otherwise(cut)
    role = F.when(c("_i") < cut, F.lit("core")).otherwise(F.lit("validation"))
    return rows.withColumn("role", role).drop("_i", "_n")


def expanding_blocks(df: DataFrame, splits: int = 3) -> DataFrame:
    """Rows with (split, role): equal test blocks at the end, all earlier rows train."""
    rows = _numbered(df)
    size = F.floor(c("_n") / (splits + 1))
    roles = []
    for k in range(1, splits + 1):
        start = c("_n") - (splits - k + 1) * size
        roles.append(F.when(c("_i") < start, F.lit("train"))
                     .when(c("_i") < start + size, F.lit("test")))
    cells = F.filter(F.array(*[F.struct(F.lit(k).alias("split"), r.alias("role"))
                               for k, r in enumerate(roles, 1)]), lambda x: x["role"].isNotNull())
    return rows.select(*df.columns, F.inline(cells))


def calendar_blocks(df: DataFrame, splits: int = 3) -> DataFrame:
    """(split, test_start, test_end): equal test blocks of the newest dates that occur, by the calendar and not by symbol."""
    order = Window.orderBy("date")  # one row for each date
    days = df.select("date").distinct().withColumns({
        "_i": F.row_number().over(order) - 1, "_n": F.count(F.lit(1)).over(Window.partitionBy())})
    size = F.nullif(F.floor(c("_n") / (splits + 1)), F.lit(0))
    days = days.withColumn("split", (splits - F.floor((c("_n") - 1 - c("_i")) / size)).cast("int"))
    return days.where(c("split").between(1, splits)).groupBy("split").agg(
        F.min("date").alias("test_start"), F.max("date").alias("test_end"))


def purged_blocks(df: DataFrame, splits: int = 3, embargo_days: int = 5, end: str = "label_end", both_sides: bool = False) -> DataFrame:
    """Rows with (split, role): calendar test blocks, and training rows whose label shares nothing with them.

    A label spans the days from ``date`` to ``end``.  A test block spans its first date to the last day
    that its labels reach, and the embargo lies on both sides of it.  A row trains where its span ends
    before all that; with ``both_sides`` also where it begins behind it.  Rows whose label is not known
    yet (no ``end``) take no part.
    """
    df = df.where(c(end).isNotNull())
    blocks = [(r["split"], r["test_start"], r["test_end"]) for r in calendar_blocks(df, splits).orderBy("split").collect()]
    if not blocks:
        return df.withColumns({"split": F.lit(0), "role": F.lit("")}).limit(0)
    reach = df.agg(*[F.max(F.when(c("date").between(F.lit(a), F.lit(b)), c(end))).alias(f"_{k}") for k, a, b in blocks]).first()
    cells = []
    for k, a, b in blocks:
        free = c(end) < F.date_sub(F.lit(a), embargo_days)
        if both_sides:
            free = free | (c("date") > F.date_add(F.lit(reach[f"_{k}"]), embargo_days))
        role = F.when(c("date").between(F.lit(a), F.lit(b)), F.lit("test")).when(free, F.lit("train"))
        cells.append(F.struct(F.lit(k).alias("split"), role.alias("role")))
    return df.select(*df.columns, F.inline(F.filter(F.array(*cells), lambda x: x["role"].isNotNull())))


def class_weights(df: DataFrame, by: list[str], label: str = "label") -> DataFrame:
    """(by, pos, neg, weight): negatives per positive, both at least one."""
    n = df.groupBy(*by).agg(F.greatest(F.lit(1), F.sum(label)).alias("pos"),
                            F.count(F.lit(1)).alias("_n"))
    n = n.withColumn("neg", F.greatest(F.lit(1), c("_n") - c("pos")))
    return n.select(*by, "pos", "neg", ratio("neg", "pos").alias("weight"))
