"""Direction streaks of the latest rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import windows as w
from ..functions.exprs import c


def direction_streak(df: DataFrame, n: int = 5) -> DataFrame:
    """Rows among the last n moving the same way as the current one, and the true run length."""
    move = w.diff("close", 1)
    df = df.withColumn("up", F.when(move >= 0, F.lit(1)).when(move < 0, F.lit(0)))
    ups = F.sum("up").over(w.trailing(n))
    known = F.count("up").over(w.trailing(n))
    df = df.withColumns({
        "matches_5": F.when(c("up") == 1, ups).when(c("up") == 0, known - ups),
        "_row": F.row_number().over(w.series()),
        "_turn": F.when(~w.shift("up", 1).eqNullSafe(c("up")), F.row_number().over(w.series()))})
    start = F.max("_turn").over(w.running())
    return df.withColumn("run_length", F.when(
        c("up").isNotNull(), (c("_row") - F.coalesce(start, F.lit(1)) + 1).cast("int"))) \
        .drop("_row", "_turn")


def session_state(df: DataFrame) -> DataFrame:
    """Latest VWAP direction (against five rows before), streak direction, count and flip flag."""
    from ..functions.indicators import vwap
    df = direction_streak(vwap(df))
    df = df.withColumn("vwap_dir", F.when(c("vwap_all") > w.shift("vwap_all", 5), F.lit("UP"))
                       .otherwise(F.lit("DOWN")))
    last = df.groupBy("sym").agg(
        F.max_by(F.struct("vwap_dir", "up", "matches_5"), "date").alias("s"),
        F.count(F.lit(1)).alias("n"))
    enough = F.col("n") >= 6
    return last.select(
        "sym", F.when(enough, F.col("s.vwap_dir")).otherwise(F.lit("NEU")).alias("vwap"),
        F.when(enough, F.when(F.col("s.up") == 1, F.lit("UP")).otherwise(F.lit("DOWN")))
        .otherwise(F.lit("NEU")).alias("streak"),
        F.when(enough, F.col("s.matches_5")).otherwise(F.lit(0)).alias("count"),
        (enough & (F.col("s.matches_5") >= 3)).alias("flip"))
