"""Streams continue where they stopped and equal the batch result."""

import datetime as dt
from types import SimpleNamespace

import numpy as np
import pandas as pd
import pytest

from barloom.session import new_path
from barloom.streaming import bars as sb
from barloom.streaming import runner, stateful

COLUMNS = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"


def write(spark, folder, rows, files=1):
    spark.createDataFrame(rows, COLUMNS).repartition(files).write.mode("append").parquet(f"{folder}/events.parquet")


@pytest.fixture()
def two_files(spark):
    folder = new_path(spark, "ticks")
    base = dt.datetime(2024, 1, 1)
    rows = [(i, base + dt.timedelta(minutes=10 * i), i % 3, "ab"[i % 2], float((i * 7) % 11 + 1), None) for i in range(60)]
    return folder, rows


def test_state_survives_between_runs(spark, two_files):
    folder, rows = two_files
    out, state = new_path(spark, "ema"), new_path(spark, "ema-state")

    def run():
        stream = runner.ticks(runner.event_stream(spark, folder))
        return runner.to_table(stateful.running_mean(stream, 0.3), "ema", state, out)

    write(spark, folder, rows[:35])
    assert run().count() == 29  # the last hour waits for the watermark
    write(spark, folder, rows[35:])
    got = run().toPandas().sort_values("event_id").set_index("event_id")
    frame = pd.DataFrame(rows, columns=["event_id", "ts", "u", "sym", "price", "p"])
    want = frame.groupby("sym")["price"].transform(lambda s: s.ewm(alpha=0.3, adjust=False).mean())
    assert list(got.index) == list(range(54))
    assert (got["ema"] - want.iloc[:54]).abs().max() < 1e-12


def test_bars_wait_for_the_watermark(spark, two_files):
    folder, rows = two_files
    write(spark, folder, rows)
    stream = runner.ticks(runner.event_stream(spark, folder))
    got = runner.to_table(sb.to_bars(stream, "1 hour", delay="30 minutes"), "bars")
    last = max(r[1] for r in rows) - dt.timedelta(minutes=30)
    assert got.count() == 2 * sum(1 for h in range(10) if dt.datetime(2024, 1, 1, h) + dt.timedelta(hours=1) <= last)


def test_duplicates_arrive_once(spark, two_files):
    folder, rows = two_files
    write(spark, folder, rows + rows[:20])
    stream = runner.ticks(runner.event_stream(spark, folder))
    assert runner.to_table(sb.each_bar_once(stream), "once").count() == 60


def test_positions_close_once(spark):
    folder = new_path(spark, "positions")
    base = dt.datetime(2024, 1, 1)
    values = [("purchase", 100.0), ("view", 101.0), ("view", 96.0), ("purchase", 50.0), ("view", 54.0), ("view", 40.0)]
    values += [("view", 40.0)] * 70  # time goes on until the watermark has passed
    write(spark, folder, [(i, base + dt.timedelta(minutes=i), 1, k, v, None) for i, (k, v) in enumerate(values)])
    from pyspark.sql import functions as F
    events = runner.event_stream(spark, folder).select(
        F.lit("K").alias("key"), "ts", "event_id", F.col("value").alias("price"),
        (F.col("event_type") == "purchase").alias("is_open"))
    got = runner.to_table(stateful.position_monitor(events), "monitor").orderBy("position").collect()
    assert [(r.position, r.closed_by, r.reason) for r in got] == [(0, 2, "CLOSED_SL"), (3, 4, "CLOSED_TP")]


def test_silent_positions_close_by_age(spark):
    from pyspark.sql import functions as F
    folder = new_path(spark, "positions")
    base = dt.datetime(2024, 1, 1)
    rows = [(0, base, 1, "purchase", 100.0, None), (1, base + dt.timedelta(minutes=5), 1, "view", 101.0, None),
            (2, base + dt.timedelta(days=3), 2, "view", 1.0, None)]
    write(spark, folder, rows)
    events = runner.event_stream(spark, folder).select(
        F.col("user_id").cast("string").alias("key"), "ts", "event_id", F.col("value").alias("price"),
        (F.col("event_type") == "purchase").alias("is_open"))
    got = runner.to_table(stateful.position_monitor(events, max_age_ms=86_400_000), "aged").collect()
    assert [(r.position, r.closed_by, r.reason, r.exit_price, r.ticks) for r in got] == [(0, None, "CLOSED_AGE", 101.0, 1)]


def test_late_rows_are_dropped_and_disorder_is_mended(spark):
    """Batches a little out of order give the ordered result; rows behind the watermark do not count."""
    folder, out, state = (new_path(spark, x) for x in ("ticks", "ema", "ema-state"))
    base = dt.datetime(2024, 1, 1)
    rows = [(i, base + dt.timedelta(minutes=10 * i), 0, "a", float(i % 7), None) for i in range(48)]
    swapped = [*rows[:20], *rows[24:30], *rows[20:24], *rows[30:]]

    def run():
        stream = runner.ticks(runner.event_stream(spark, folder))
        return runner.to_table(stateful.running_mean(stream, 0.3, "2 hours"), "ema", state, out)

    for part in (swapped[:26], swapped[26:]):
        write(spark, folder, part)
        run()
    write(spark, folder, [(99, base, 0, "a", 1000.0, None)])
    got = {r.event_id: r.ema for r in run().collect()}
    want = pd.Series([r[4] for r in rows]).ewm(alpha=0.3, adjust=False).mean()
    assert sorted(got) == list(range(36))
    assert all(abs(got[i] - want[i]) < 1e-12 for i in got)


class Kept(dict):
    """A map state, a value state and a handle in memory."""

    getValue, iterator, removeKey, updateValue = dict.get, lambda self: iter(list(self.items())), dict.__delitem__, dict.__setitem__
    exists, update = dict.__len__, lambda self, v: self.__setitem__((), v)
    getMapState = getValueState = lambda self, name, *schemas: self.setdefault(name, Kept())
    registerTimer = lambda self, ms: self.__setitem__("timer", ms)

    def get(self):
        return self[()]

    def __eq__(self, other):
        return self is other


def times(ms):
    return SimpleNamespace(getCurrentWatermarkInMs=lambda: ms)


def test_a_step_of_the_watermark_is_handled_in_bounded_pieces():
    """Whatever a step releases for a key, few rows are in memory; order and arrival order of equal rows hold."""
    handle, mean = Kept(), stateful.RunningMean(0.3)
    mean.run_rows, mean.chunk_rows = 500, 20
    mean.init(handle)
    pieces, by = [], mean.handle_in_order
    mean.handle_in_order = lambda key, frame: (pieces.append(frame), by(key, frame))[1]
    rng = np.random.default_rng(1)
    base = pd.Timestamp("2024-01-01")
    rows = pd.DataFrame({"ts": base + pd.to_timedelta(rng.integers(0, 900, 5000), "s"), "event_id": rng.integers(0, 40, 5000),
                         "price": np.where(rng.random(5000) < 0.2, np.nan, rng.random(5000))})
    got = []
    for part, mark in ((rows[:3000], 300), (rows[3000:], 600)):
        part = part[part["ts"] > base + pd.Timedelta(seconds=mark - 300)] if mark > 300 else part
        mean.handleInputRows(("a",), (part[i:i + 70] for i in range(0, len(part), 70)),
                             times(0 if mark == 300 else int(base.value // 10**6) + 300_000))
        got += list(mean.handleExpiredTimer(("a",), times(int(base.value // 10**6) + mark * 1000), None))
        assert handle["timer"] > int(base.value // 10**6) + mark * 1000
    early = rows["ts"] <= base + pd.Timedelta(seconds=300)
    want = rows[(rows["ts"] <= base + pd.Timedelta(seconds=600)) & ~(early & (rows.index >= 3000))]
    want = want.sort_values(["ts", "event_id"], kind="stable")
    got = pd.concat(got, ignore_index=True)
    assert list(got["event_id"]) == list(want["event_id"])
    assert np.allclose(got["ema"], want["price"].ewm(alpha=0.3, adjust=False).mean(), rtol=0, atol=1e-12, equal_nan=True)
    assert max(map(len, pieces)) <= 2 * 20 * 11 and max(len(x) for x, in handle["chunks"].values()) < 4_000
    list(mean.handleExpiredTimer(("a",), times(1 << 50), None))
    assert not handle["chunks"] and not handle["runs"] and sum(map(len, pieces)) == len(want) + (rows["ts"] > base + pd.Timedelta(seconds=600)).sum()


def test_runs_of_a_stream_merge(spark):
    """Runs of a few rows, several batches, missing prices: the figures of one pass over the whole."""
    folder, out, state = (new_path(spark, x) for x in ("ticks", "ema", "ema-state"))
    base, rng = dt.datetime(2024, 1, 1), np.random.default_rng(3)
    rows = [(i, base + dt.timedelta(seconds=int(s)), 0, "ab"[i % 2], None if i % 9 == 0 else float(i % 31), None)
            for i, s in enumerate(rng.integers(0, 86_400, 3000))]
    cut = [r for r in rows if r[1].hour < 12], [r for r in rows if r[1].hour >= 12]
    for part in cut:
        write(spark, folder, part, 3)
        mean = stateful.RunningMean(0.3)
        mean.run_rows, mean.chunk_rows = 100, 9
        stream = runner.ticks(runner.event_stream(spark, folder))
        got = runner.to_table(stateful._run(stream, "sym", mean, "sym string, event_id bigint, ema double", "1 hour"), "ema", state, out)
    got = got.toPandas().set_index("event_id")["ema"]
    frame = pd.DataFrame(rows, columns=["event_id", "ts", "u", "sym", "price", "p"]).sort_values(["ts", "event_id"])
    want = frame.groupby("sym")["price"].transform(lambda s: s.ewm(alpha=0.3, adjust=False).mean())
    passed = frame[frame["ts"] <= frame["ts"].max() - pd.Timedelta(hours=1)].index
    assert sorted(got.index) == sorted(passed)
    assert np.allclose(got.sort_index(), want[sorted(passed)], rtol=0, atol=1e-12, equal_nan=True)


@pytest.mark.parametrize("name", ["STR-1_each_bar_once", "STR-2_ticks_to_bars", "STR-3_session_vwap", "STR-3_direction_streak",
                                  "STR-4_miss_streak_flip", "STR-5_prediction_outcomes", "STR-6_position_monitor",
                                  "STR-7_streaming_ewm", "STR-8_ranking_refresh"])
def test_tables_of_part_files_out_of_order(spark, many_files, name):
    """A table of shuffled part files gives the rows of the table in one file."""
    import __spark_entry__ as entry
    folder = "/root/testdata/sf0.001"
    one, many = (sorted(map(repr, entry.queries()[name](spark, f).collect())) for f in (folder, many_files))
    assert one and one == many


@pytest.fixture(scope="module")
def many_files(spark):
    folder = new_path(spark, "many-files")
    for table in ("events", "lineitem", "part", "supplier", "orders"):
        df = spark.read.parquet(f"/root/testdata/sf0.001/{table}.parquet")
        df.repartition(5).write.parquet(f"{folder}/{table}.parquet")
    return folder
