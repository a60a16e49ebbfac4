"""Positions and closed trades as tables: sizing, levels, exits, P&L, performance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import c, clip, ratio

# Risk settings of the ledger.
MAX_POSITION, FLOOR_VALUE, STOP, TARGET, MAX_HOLD = 0.10, 10000.0, 0.03, 0.06, 10


def shares(confidence: str = "confidence", price: str = "price",
           capital: str = "capital") -> Column:
    """Whole shares from a Kelly-like fraction of the largest position; no edge, no shares."""
    kelly = clip((c(confidence) / 100 - 0.5) * 2, 0.0, 1.0)
    most = c(capital) * MAX_POSITION
    value = F.greatest(most * kelly, F.least(F.lit(FLOOR_VALUE), most))
    return F.when((kelly > 0) & (c(price) > 0), F.floor(value / c(price))).otherwise(
        F.lit(0).cast("bigint"))


def with_levels(df: DataFrame, price: str = "entry_price", stop: float = STOP,
                target: float = TARGET) -> DataFrame:
    """Stop and target on the right side of the entry, in cents."""
    up = c("direction") == "UP"
    sign = F.when(up, F.lit(1.0)).otherwise(F.lit(-1.0))
    return df.withColumns({"stop_loss": F.bround(c(price) * (1 - sign * stop), 2),
                           "target": F.bround(c(price) * (1 + sign * target), 2)})


#: Bars of a block of the skip index, and blocks of a block above.
NEAR_BARS = 16


def _outcome(high: Column, low: Column) -> tuple[Column, Column]:
    """Status and exit price of one bar; inside a bar the stop counts before the target."""
    up = c("direction") == "UP"
    stopped = F.when(up, low <= c("stop_loss")).otherwise(high >= c("stop_loss"))
    reached = F.when(up, high >= c("target")).otherwise(low <= c("target"))
    status = F.when(stopped, F.lit("CLOSED_SL")).when(reached, F.lit("CLOSED_TP"))
    return status, F.when(stopped, c("stop_loss")).otherwise(c("target"))


def _skip_index(rows: DataFrame, longest: int, fan: int) -> list[DataFrame]:
    """Blocks (_s, _block, _kids) in levels: ``fan`` bars a block, then ``fan`` blocks a block.

    A kid has its number ``i`` in its own level, its first date, its highest high and its lowest low,
    so a barrier that no kid crosses is crossed by no bar below it.
    """
    levels, unit, size = [], rows.select("sym", c("_row").alias("i"), "date", "high", "low"), 1
    while True:
        size *= fan
        level = unit.groupBy("sym", F.floor(c("i") / fan).alias("_block")).agg(
            F.array_sort(F.collect_list(F.struct("i", "date", "high", "low"))).alias("_kids"),
            F.min("date").alias("date"), F.max("high").alias("high"), F.min("low").alias("low"))
        levels.append(level.select(c("sym").alias("_s"), "_block", "_kids"))
        if size >= longest:
            return levels
        unit = level.select("sym", c("_block").alias("i"), "date", "high", "low")


def exits(positions: DataFrame, bars: DataFrame, max_hold: int = MAX_HOLD,
          near: int = NEAR_BARS) -> DataFrame:
    """First exit of each position over its bars (entry bar included).

    Without a hit a position expires at its last close once ``max_hold`` bars exist, else it stays
    open.  The search goes over a skip index with ``near`` kids a block: first the rest of the entry
    bar's block, then the rest of the block of blocks that holds it, and so on upwards until a kid
    crosses a barrier, and from there down to the bar.  Each step joins a position with one block, so
    the work grows with the logarithm of the bars that follow.
    """
    keys, near = list(positions.columns), max(near, 2)
    at = Window.partitionBy("sym").orderBy("date")
    whole = at.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = bars.select(
        "sym", "date", "high", "low", (F.row_number().over(at) - 1).cast("bigint").alias("_row"),
        F.count(F.lit(1)).over(whole).alias("_all"), F.last("close").over(whole).alias("_last"),
        F.last("date").over(whole).alias("_end"))
    longest = bars.groupBy("sym").count().agg(F.max("count")).first()[0] or 0
    levels = _skip_index(rows, longest, near)
    held = positions.join(rows.select(
        "sym", c("date").alias("entry_date"), c("_row").alias("_at"), c("_row").alias("_entry"),
        (c("_all") - c("_row")).alias("bars"), "_last", "_end"), ["sym", "entry_date"])
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    kid = f"struct<i:bigint,date:{kinds['date']},high:{kinds['high']},low:{kinds['low']}>"
    held = held.withColumns({"_unit": F.lit(None).cast("int"), "_spot": F.lit(None).cast(kid)})

    def looked(df: DataFrame, level: DataFrame, wanted: Column, block: Column, first: Column) -> DataFrame:
        """``_seen``: the first kid of the block, from number ``first`` on, that crosses a barrier.

        Positions that look for nothing get keys of their own, which spreads them."""
        df = df.withColumn("_b", F.when(wanted, block).otherwise(-1 - c("_entry")))
        crossing = F.filter("_kids", lambda x: (x["i"] >= first) & _outcome(x["high"], x["low"])[0].isNotNull())
        return df.join(level, (c("sym") == c("_s")) & (c("_b") == c("_block")), "left") \
            .withColumn("_seen", F.get(crossing, F.lit(0))).drop("_s", "_block", "_kids", "_b")

    for unit, level in enumerate(levels):
        block = F.floor(c("_at") / near)
        held = looked(held, level, c("_unit").isNull(), block, c("_at")).withColumns({
            "_unit": F.coalesce("_unit", F.when(c("_seen").isNotNull(), F.lit(unit))),
            "_spot": F.coalesce("_spot", "_seen"), "_at": block + 1}).drop("_seen")
    for unit in range(len(levels) - 1, 0, -1):
        here = c("_unit") == unit
        held = looked(held, levels[unit - 1], F.coalesce(here, F.lit(False)), c("_spot.i"), F.lit(0)).withColumns({
            "_unit": F.when(here, F.lit(unit - 1)).otherwise(c("_unit")),
            "_spot": F.when(here, c("_seen")).otherwise(c("_spot"))}).drop("_seen")

    status, price = _outcome(c("_spot.high"), c("_spot.low"))
    closed, old = c("_spot").isNotNull(), c("bars") >= max_hold
    return held.select(
        *keys, F.when(closed, status).when(old, F.lit("CLOSED_EXPIRY"))
        .otherwise(F.lit("OPEN")).alias("status"),
        F.when(closed, price).when(old, c("_last")).alias("exit_price"),
        F.when(closed, c("_spot.date")).when(old, c("_end")).alias("exit_date"), "bars",
        c("_last").alias("last_close"))


def profit(exit_price: str = "exit_price") -> Column:
    move = c(exit_price) - c("entry_price")
    return F.when(c("direction") == "UP", move).otherwise(-move) * c("shares")


def trade_records(closed: DataFrame) -> DataFrame:
    """P&L, percent, days held (at least one) and reason of every closed position."""
    done = closed.where(c("status") != "OPEN")
    pnl = profit()
    return done.select(
        "sym", "direction", "entry_price", "exit_price", "shares", F.bround(pnl, 2).alias("pnl"),
        F.bround(ratio(pnl, c("entry_price") * c("shares")) * 100, 2).alias("pnl_pct"),
        "entry_date", "exit_date",
        F.greatest(F.lit(1), F.date_diff("exit_date", "entry_date")).alias("hold_days"),
        c("status").alias("reason"))


def open_value(exited: DataFrame) -> DataFrame:
    """Unrealised P&L of open positions at their last close, per symbol."""
    return (exited.where(c("status") == "OPEN").groupBy("sym")
            .agg(F.sum(profit("last_close")).alias("open_pnl"), F.count(F.lit(1)).alias("n_open")))


def performance(trades: DataFrame, capital: float) -> DataFrame:
    """Win rate, P&L, drawdown of additive equity and Sharpe scaled by the mean holding time.

    Trades closed on one day are booked together, so the ordered part has one row per day.
    """
    daily = trades.groupBy("exit_date").agg(F.sum("pnl").alias("p"))
    so_far = Window.orderBy("exit_date").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    curve = daily.withColumn("equity", capital + F.sum("p").over(so_far))
    peak = F.greatest(F.max("equity").over(so_far), F.lit(capital))
    worst = curve.withColumn("dd", (peak - c("equity")) / peak * 100).agg(
        F.greatest(F.max("dd"), F.lit(0.0))).scalar()
    r = c("pnl_pct") / 100
    out = trades.agg(
        F.count(F.lit(1)).alias("total_trades"), F.count_if(c("pnl") > 0).alias("winning_trades"),
        F.sum("pnl").alias("_p"), F.avg("hold_days").alias("_hold"), F.avg(r).alias("_m"),
        F.stddev_samp(r).alias("_s"))
    per_year = 252 / F.greatest(F.lit(1.0), c("_hold"))
    sharpe = F.coalesce(ratio(c("_m") * per_year, c("_s") * F.sqrt(per_year)), F.lit(0.0))
    return out.select(
        "total_trades", "winning_trades",
        (c("total_trades") - c("winning_trades")).alias("losing_trades"),
        F.bround(c("winning_trades") / c("total_trades") * 100, 2).alias("win_rate"),
        F.bround("_p", 2).alias("total_pnl"),
        F.bround(c("_p") / c("total_trades"), 2).alias("avg_pnl"),
        F.bround(worst, 2).alias("max_drawdown"), F.bround("_hold", 1).alias("mean_hold_days"),
        F.bround(sharpe, 2).alias("sharpe_ratio"),
        F.bround(c("_p") / capital * 100, 2).alias("total_return"))
