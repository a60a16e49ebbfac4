"""Structured Streaming jobs (STR-*), run to the end of their input.

The oracles compute the same result in one batch; windows still open at the last watermark are not
emitted, exactly as in a running stream, and stateful operators handle rows once the watermark has
passed them.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.exprs import c, rounded, tz_free
from ..plans import ranking as weekly
from ..sources import tables as src
from ..streaming import bars as sb
from ..streaming import refresh, runner, stateful
from .base import block, query, r, sql


def tick_stream(t):
    return runner.ticks(runner.event_stream(t.spark, t.folder))


@query("STR-1_each_bar_once", sql("", "SELECT DISTINCT event_type AS sym, ts FROM events"))
def _(t):
    out = runner.to_table(sb.each_bar_once(tick_stream(t)).select("sym", "ts"), "once")
    return tz_free(out)


WINDOWED = """SELECT sym, s AS start, e AS end, open, high, low, close, volume FROM (
SELECT event_type AS sym, time_bucket(INTERVAL '{size}', ts) AS s, time_bucket(INTERVAL '{size}', ts) + INTERVAL '{size}' AS e,
  arg_min(value, (ts, event_id)) AS open, max(value) AS high, min(value) AS low, arg_max(value, (ts, event_id)) AS close, CAST(count(*) AS DOUBLE) AS volume
FROM events GROUP BY 1, 2, 3) WHERE e <= (SELECT max(ts) FROM events) - INTERVAL 1 HOUR"""


@query("STR-2_ticks_to_bars", sql("", WINDOWED.format(size="1 hour")))
def _(t):
    return tz_free(runner.to_table(sb.to_bars(tick_stream(t)), "bars"))


@query("STR-2_ticks_to_sliding_bars", sql("", """SELECT sym, s AS start, s + INTERVAL 1 HOUR AS end, open, high, low, close, volume FROM (
SELECT event_type AS sym, time_bucket(INTERVAL '30 minutes', ts) - INTERVAL 30 MINUTE * k AS s,
  arg_min(value, (ts, event_id)) AS open, max(value) AS high, min(value) AS low, arg_max(value, (ts, event_id)) AS close, CAST(count(*) AS DOUBLE) AS volume
FROM events, range(2) g(k) GROUP BY 1, 2) WHERE s + INTERVAL 1 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 1 HOUR"""))
def _(t):
    return tz_free(runner.to_table(sb.to_bars(tick_stream(t), "1 hour", "30 minutes"), "sliding"))


@query("STR-3_session_vwap", sql("", f"""SELECT sym, start, end_ AS end, {r('vwap')}, ticks FROM (
SELECT sym, min(ts) AS start, max(ts) + INTERVAL 30 MINUTE AS end_, sum(CAST(round(value * 100) AS BIGINT)) / 100.0::DOUBLE / count(*) AS vwap, count(*) AS ticks FROM (
  SELECT *, sum(brk) OVER (PARTITION BY sym ORDER BY ts, event_id) AS grp FROM (SELECT event_type AS sym, ts, event_id, value,
    CASE WHEN ts >= lag(ts) OVER (PARTITION BY event_type ORDER BY ts, event_id) + INTERVAL 30 MINUTE THEN 1 ELSE 0 END AS brk FROM events))
  GROUP BY sym, grp) WHERE end_ <= (SELECT max(ts) FROM events) - INTERVAL 1 HOUR"""))
def _(t):
    return rounded(tz_free(runner.to_table(sb.session_vwap(tick_stream(t)), "sessions")))


block("passed", "", "SELECT * FROM events WHERE ts <= (SELECT max(ts) FROM events) - INTERVAL 1 HOUR")


@query("STR-3_direction_streak", sql("passed", """SELECT sym, event_id, CASE WHEN up THEN 'UP' ELSE 'DOWN' END AS direction,
  CAST(rn - max(CASE WHEN turn THEN rn END) OVER (PARTITION BY sym ORDER BY rn) + 1 AS INTEGER) AS run
FROM (SELECT *, coalesce(up <> lag(up) OVER (PARTITION BY sym ORDER BY rn), TRUE) AS turn FROM (
  SELECT event_type AS sym, event_id, row_number() OVER w AS rn, value >= lag(value) OVER w AS up FROM passed
  WINDOW w AS (PARTITION BY event_type ORDER BY ts, event_id)) WHERE up IS NOT NULL)"""))
def _(t):
    return runner.to_table(stateful.direction_streaks(tick_stream(t)), "direction")


@query("STR-4_miss_streak_flip", sql("passed", """SELECT sym, event_id, CASE WHEN hit THEN NULL ELSE actual END AS miss_dir,
  CASE WHEN hit THEN 0 ELSE CAST(row_number() OVER (PARTITION BY sym, grp ORDER BY rn) AS INTEGER) END AS miss_count,
  NOT hit AND row_number() OVER (PARTITION BY sym, grp ORDER BY rn) >= 3 AS flip
FROM (SELECT *, sum(CASE WHEN st IS DISTINCT FROM prev THEN 1 ELSE 0 END) OVER (PARTITION BY sym ORDER BY rn) AS grp FROM (
  SELECT *, lag(st) OVER (PARTITION BY sym ORDER BY rn) AS prev FROM (
  SELECT event_type AS sym, event_id, CASE WHEN value >= 30 THEN 'UP' ELSE 'DOWN' END AS actual, (user_id % 2 = 0) = (value >= 30) AS hit,
    CASE WHEN (user_id % 2 = 0) = (value >= 30) THEN 'HIT' WHEN value >= 30 THEN 'UP' ELSE 'DOWN' END AS st,
    row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS rn FROM passed WHERE value > 5)))"""))
def _(t):
    word = lambda cond: F.when(cond, F.lit("UP")).otherwise(F.lit("DOWN"))
    events = runner.event_stream(t.spark, t.folder).select(
        c("event_type").alias("sym"), "ts", "event_id", word(c("user_id") % 2 == 0).alias("pred"),
        word(c("value") >= 30).alias("actual"), (c("value") > 5).alias("tradeable"))
    return runner.to_table(stateful.miss_streaks(events), "misses")


def outcomes(t):
    price = F.greatest("value", F.lit(0.01))
    events = runner.event_stream(t.spark, t.folder)
    predictions = events.where(c("event_type") == "click").select(
        c("user_id").alias("key"), c("ts").alias("pred_ts"), price.alias("last"),
        (price * F.when(c("event_id") % 2 == 0, 1.05).otherwise(0.95)).alias("pred_price"))
    bars = runner.event_stream(t.spark, t.folder).where(c("event_type") == "purchase").select(
        c("user_id").alias("key"), c("ts").alias("bar_ts"), price.alias("price"))
    return sb.prediction_outcomes(predictions, bars)


block("outc", "", """SELECT p.user_id AS key, p.ts AS pred_ts, b.ts AS bar_ts, (p.pp >= p.value) = (b.value >= p.value) AS is_hit, abs(p.pp - b.value) / b.value * 100 AS mape
FROM (SELECT user_id, ts, greatest(value, 0.01::DOUBLE) AS value, greatest(value, 0.01::DOUBLE) * CASE WHEN event_id % 2 = 0 THEN 1.05::DOUBLE ELSE 0.95::DOUBLE END AS pp FROM events WHERE event_type = 'click') p
JOIN (SELECT user_id, ts, greatest(value, 0.01::DOUBLE) AS value FROM events WHERE event_type = 'purchase') b
  ON p.user_id = b.user_id AND b.ts > p.ts AND b.ts <= p.ts + INTERVAL 1 DAY""")


@query("STR-5_prediction_outcomes", sql("outc", f"SELECT key, pred_ts, bar_ts, is_hit, {r('mape')} FROM outc"))
def _(t):
    return rounded(tz_free(runner.to_table(outcomes(t), "outcomes")))


@query("STR-5_running_accuracy", sql("outc", f"""SELECT day, n, hits, {r('winrate=sum(hits) OVER w / sum(n) OVER w * 100; running_mape=sum(mape * n) OVER w / sum(n) OVER w')}
FROM (SELECT date_trunc('day', bar_ts)::TIMESTAMP AS day, count(*) AS n, count(*) FILTER (is_hit) AS hits, avg(mape) AS mape FROM outc GROUP BY 1)
WINDOW w AS (ORDER BY day)"""))
def _(t):
    from pyspark.sql import Window
    per_day = runner.to_table(outcomes(t), "accuracy").groupBy(F.date_trunc("day", "bar_ts").alias("day")).agg(
        F.count(F.lit(1)).alias("n"), F.count_if("is_hit").alias("hits"), F.avg("mape").alias("mape"))
    so_far = Window.orderBy("day")
    out = per_day.select("day", "n", "hits", (F.sum("hits").over(so_far) / F.sum("n").over(so_far) * 100).alias("winrate"),
                         (F.sum(c("mape") * c("n")).over(so_far) / F.sum("n").over(so_far)).alias("running_mape"))
    return rounded(tz_free(out))


@query("STR-6_position_monitor", sql("passed", f"""SELECT CAST(key AS VARCHAR) AS key, position, closed_by, reason, {r('exit_price')}, CAST(k AS INTEGER) AS ticks FROM (
SELECT *, row_number() OVER (PARTITION BY position ORDER BY k) AS first FROM (
  SELECT key, position, tid AS closed_by, k, CASE WHEN v <= entry * (1 - 0.5::DOUBLE) THEN 'CLOSED_SL' WHEN v >= entry * (1 + 1.0::DOUBLE) THEN 'CLOSED_TP' WHEN k >= 10 THEN 'CLOSED_EXPIRY' END AS reason,
    CASE WHEN v <= entry * (1 - 0.5::DOUBLE) THEN entry * (1 - 0.5::DOUBLE) WHEN v >= entry * (1 + 1.0::DOUBLE) THEN entry * (1 + 1.0::DOUBLE) ELSE v END AS exit_price
  FROM (SELECT o.user_id AS key, o.event_id AS position, o.value AS entry, x.event_id AS tid, x.value AS v,
      row_number() OVER (PARTITION BY o.event_id ORDER BY x.ts, x.event_id) AS k
    FROM passed o JOIN passed x ON o.user_id = x.user_id AND x.event_type <> 'purchase' AND (x.ts, x.event_id) > (o.ts, o.event_id)
    WHERE o.event_type = 'purchase') WHERE k <= 10) WHERE reason IS NOT NULL) WHERE first = 1"""))
def _(t):
    events = runner.event_stream(t.spark, t.folder).select(
        c("user_id").cast("string").alias("key"), "ts", "event_id", c("value").alias("price"),
        (c("event_type") == "purchase").alias("is_open"))
    return rounded(runner.to_table(stateful.position_monitor(events, 0.5, 1.0, 10), "monitor"))


block("tk", "passed", "SELECT event_type AS sym, event_id, value, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS rn FROM passed")
block("tke", "tk", """SELECT sym, event_id, rn, value::DOUBLE FROM tk WHERE rn = 1 UNION ALL
  SELECT k.sym, k.event_id, k.rn, (1 - 2::DOUBLE / 13) * e.ema + (2::DOUBLE / 13) * k.value FROM tke e JOIN tk k ON k.sym = e.sym AND k.rn = e.rn + 1""",
      columns="sym, event_id, rn, ema")


@query("STR-7_streaming_ewm", sql("tke", f"SELECT sym, event_id, {r('ema')} FROM tke"))
def _(t):
    return rounded(runner.to_table(stateful.running_mean(tick_stream(t), 2.0 / 13), "ema"))


@query("STR-8_ranking_refresh", sql("ranked", "SELECT rank, sym, as_of, close, mom_12_1_pct, ret20_pct, score FROM ranked"))
def _(t):
    part = t.table("part").select("p_partkey", c("p_brand").alias("sym"))
    raw = runner.table_stream(t.spark, t.folder, "lineitem", t.table("lineitem").schema)

    def sums(batch):
        return src.daily_sums(src.priced(batch).join(part, c("l_partkey") == c("p_partkey")))

    def build(seen):
        bars = src.bars_from_daily(src.daily_sums(seen).repartition("sym"))
        ranked = weekly.ranking(bars, None, t.bound, skip=4, back=52)
        return ranked.select("rank", "sym", "as_of", "close", "mom_12_1_pct", "ret20_pct", "score")

    return refresh.refresh_on_arrival(raw, sums, build, "ranking")
