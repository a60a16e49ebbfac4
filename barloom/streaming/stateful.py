"""Per-key state machines on transformWithStateInPandas.

Rows wait in the state of their key until the watermark has passed them and are then handled in
event-time order, so files and batches may arrive out of order by up to the watermark's delay; rows
behind the watermark are dropped.  What waits is sorted outside memory: arriving rows become sorted
runs, stored as chunks, and a step of the watermark merges the runs chunk by chunk.  In memory at
once are one run, or two chunks of every run, however many rows a step releases for a key.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

FLIP_AFTER = 3
ARROW = {"string": pa.string(), "boolean": pa.bool_(), "double": pa.float64()}


def run_lengths(codes: np.ndarray, code: object, count: int) -> np.ndarray:
    """Length of the run of equal codes at every place, continuing a run of ``count`` times ``code``."""
    places = np.arange(len(codes))
    new = np.ones(len(codes), bool)
    new[1:] = codes[1:] != codes[:-1]
    begins = np.maximum.accumulate(np.where(new, places, 0))
    carried = count if len(codes) and count and codes[0] == code else 0
    return places - begins + 1 + np.where(begins == 0, carried, 0)


def in_order(rows: pa.Table) -> np.ndarray:
    """Places of the rows by (us, event_id), a missing id last; equal rows stay as they stand."""
    ids = rows["event_id"].fill_null(np.iinfo(np.int64).max).to_numpy()
    return np.lexsort((ids, rows["us"].to_numpy()))


class InOrder(StatefulProcessor):
    """Keeps rows (ts, event_id, ``columns``) until the watermark passes, then hands them on in order.

    ``handle_in_order`` gets them piece by piece and carries what it needs from one to the next in its
    state.
    """

    columns: dict[str, str] = {}
    run_rows, chunk_rows = 200_000, 4_096

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.runs = handle.getMapState("runs", "run bigint", "part int, parts int, ms bigint")
        self.chunks = handle.getMapState("chunks", "run bigint, part int", "rows binary")
        self.begin(handle)

    def begin(self, handle: StatefulProcessorHandle) -> None:
        raise NotImplementedError

    def handle_in_order(self, key, frame: pd.DataFrame) -> pd.DataFrame | None:
        raise NotImplementedError

    def handle_time(self, key, ms: int) -> pd.DataFrame | None:
        """What the passing of time alone brings about."""

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        mark, run, held, size = timerValues.getCurrentWatermarkInMs(), None, [], 0
        first = 1 << 62
        for frame in rows:
            us = frame["ts"].dt.as_unit("us").astype("int64").to_numpy()
            keep = us // 1000 > mark
            if keep.any():
                part = frame[keep]
                held.append(pa.table({"us": us[keep], "event_id": pa.array(part["event_id"], pa.int64(), from_pandas=True),
                                      **{c: pa.array(part[c], ARROW[t], from_pandas=True) for c, t in self.columns.items()}}))
                size += len(part)
            if size >= self.run_rows:
                run, ms = self._keep(held, run)
                first, held, size = min(first, ms), [], 0
        if held:
            run, ms = self._keep(held, run)
            first = min(first, ms)
        if run is not None:
            self.handle.registerTimer(first)
        return iter(())

    def _keep(self, held: list[pa.Table], before: int | None) -> tuple[int, int]:
        """Store the rows as the run after ``before``; its number and its first time."""
        run = 1 + (max((k[0] for k in self.runs.keys()), default=-1) if before is None else before)
        rows = pa.concat_tables(held)
        rows = rows.take(in_order(rows))
        starts = range(0, len(rows), self.chunk_rows)
        for part, start in enumerate(starts):
            self._put(run, part, rows.slice(start, self.chunk_rows))
        ms = rows["us"][0].as_py() // 1000
        self.runs.updateValue((run,), (0, len(starts), ms))
        return run, ms

    def _put(self, run: int, part: int, rows: pa.Table) -> None:
        to = pa.BufferOutputStream()
        with pa.ipc.new_stream(to, rows.schema) as stream:
            stream.write_table(rows)
        self.chunks.updateValue((run, part), (to.getvalue().to_pybytes(),))

    def _next(self, run: int, part: int, parts: int, mark: int) -> tuple[pa.Table, bool]:
        """Take the rows of a chunk that the watermark has passed out of the state; is there more of the run?"""
        rows = pa.ipc.open_stream(bytes(self.chunks.getValue((run, part))[0])).read_all()
        us = rows["us"].to_numpy()
        ready = int(np.searchsorted(us, (mark + 1) * 1000))
        if ready < len(us):
            if ready:
                self._put(run, part, rows.slice(ready))
            self.runs.updateValue((run,), (part, parts, int(us[ready]) // 1000))
            return rows.slice(0, ready), False
        self.chunks.removeKey((run, part))
        if part + 1 == parts:
            self.runs.removeKey((run,))
        return rows, part + 1 < parts

    def _merged(self, mark: int) -> Iterator[pd.DataFrame]:
        """The rows that the watermark has passed, in order; equal rows in the order of their arrival."""
        passed = sorted((k[0], *v) for k, v in self.runs.iterator() if v[2] <= mark)
        runs = [(run, parts) for run, _, parts, _ in passed]
        part = [p for _, p, _, _ in passed]
        more, loaded = [True] * len(runs), [None] * len(runs)
        while True:
            for i, (run, parts) in enumerate(runs):
                while more[i] and (loaded[i] is None or len(loaded[i]) < self.chunk_rows):
                    rows, more[i] = self._next(run, part[i], parts, mark)
                    part[i] += 1
                    loaded[i] = pa.concat_tables([loaded[i], rows]) if loaded[i] else rows
            sizes = np.array([len(x) for x in loaded], int)
            if not sizes.sum():
                return
            rows, ends = pa.concat_tables(loaded), np.cumsum(sizes)
            order = in_order(rows)
            place = np.empty(len(order), int)
            place[order] = np.arange(len(order))
            # what a run has yet to bring comes after the last of its loaded rows
            cut = min((place[end - 1] + 1 for end, m in zip(ends, more) if m), default=len(order))
            frame = rows.take(order[:cut]).to_pandas()
            frame.insert(0, "ms", frame["us"] // 1000)
            yield frame
            done = np.bincount(np.searchsorted(ends, order[:cut], side="right"), minlength=len(runs))
            loaded = [x.slice(n) for x, n in zip(loaded, done.tolist())]

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        mark = timerValues.getCurrentWatermarkInMs()
        for frame in self._merged(mark):
            out = self.handle_in_order(key, frame)
            if out is not None and len(out):
                yield out
        later = min((v[2] for v in self.runs.values()), default=None)
        if later is not None:
            self.handle.registerTimer(later)
        out = self.handle_time(key, mark)
        if out is not None and len(out):
            yield out

    def close(self) -> None:
        pass


class MissStreak(InOrder):
    """Counts misses in a row towards the same realised direction."""

    columns = {"pred": "string", "actual": "string", "tradeable": "boolean"}

    def begin(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("streak", "dir string, count int")

    def handle_in_order(self, key, frame: pd.DataFrame) -> pd.DataFrame | None:
        frame = frame[frame["tradeable"].astype(bool)]
        if frame.empty:
            return None
        before, count = self.state.get() if self.state.exists() else ("", 0)
        actual = frame["actual"].to_numpy(object)
        code = np.where((frame["pred"] == frame["actual"]).to_numpy(), "", actual)
        counts = np.where(code == "", 0, run_lengths(code, before, count)).astype(np.int32)
        self.state.update((str(code[-1]), int(counts[-1])))
        return pd.DataFrame({"sym": key[0], "event_id": frame["event_id"].to_numpy(), "miss_dir": [x or None for x in code],
                             "miss_count": counts, "flip": counts >= FLIP_AFTER})


class RunningMean(InOrder):
    """Exponential mean per key; the state is the last mean and its weight.

    The weight falls with every missing price since the last known one, as in pandas.
    """

    columns = {"price": "double"}

    def __init__(self, alpha: float):
        self.alpha = alpha

    def begin(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("mean", "value double, weight double")

    def handle_in_order(self, key, frame: pd.DataFrame) -> pd.DataFrame | None:
        price = frame["price"].to_numpy(float)
        known = np.flatnonzero(~np.isnan(price))
        before, weight = self.state.get() if self.state.exists() else (None, 1.0)
        if before is None or np.isnan(before):
            mean = self._mean(price)
        elif len(known):
            at = known[0]
            weight *= (1 - self.alpha) ** (at + 1)
            start = before if before == price[at] else (weight * before + self.alpha * price[at]) / (weight + self.alpha)
            mean = np.concatenate([np.full(at, before), self._mean(np.concatenate([[start], price[at + 1:]]))])
        else:
            mean = np.full(len(price), before)
        fade = (1 - self.alpha) ** (len(price) - 1 - known[-1]) if len(known) else weight * (1 - self.alpha) ** len(price)
        self.state.update((float(mean[-1]), float(fade)))
        return pd.DataFrame({"sym": key[0], "event_id": frame["event_id"].to_numpy(), "ema": mean})

    def _mean(self, price: np.ndarray) -> np.ndarray:
        return pd.Series(price).ewm(alpha=self.alpha, adjust=False).mean().to_numpy()


class DirectionStreak(InOrder):
    """Length of the run of equal price directions at every tick."""

    columns = {"price": "double"}

    def begin(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("run", "price double, up boolean, run int")

    def handle_in_order(self, key, frame: pd.DataFrame) -> pd.DataFrame | None:
        known = self.state.exists()
        last, up, run = self.state.get() if known else (None, False, 0)
        price = frame["price"].to_numpy(float)
        chain = np.concatenate([[last], price]) if known else price
        ups = chain[1:] >= chain[:-1]
        runs = run_lengths(ups, up, run).astype(np.int32)
        if len(ups):
            up, run = bool(ups[-1]), int(runs[-1])
        self.state.update((float(price[-1]), up, run))
        return pd.DataFrame({"sym": key[0], "event_id": frame["event_id"].to_numpy()[0 if known else 1:],
                             "direction": np.where(ups, "UP", "DOWN"), "run": runs})


class PositionMonitor(InOrder):
    """Open positions of a key, closed by stop, target, number of ticks, or age.

    Input rows are openings (``is_open``) or ticks.  A position sees at most ``hold`` ticks, so few
    are open at a time.  With ``max_age_ms`` a timer closes what is older when the watermark passes,
    at the last price of the key, so silent keys do not keep their state.
    """

    columns = {"price": "double", "is_open": "boolean"}

    def __init__(self, stop: float, target: float, hold: int, max_age_ms: int | None):
        self.stop, self.target, self.hold, self.max_age_ms = stop, target, hold, max_age_ms

    def begin(self, handle: StatefulProcessorHandle) -> None:
        self.open = handle.getMapState("open", "id bigint", "entry double, seen int, opened_ms bigint, last double")

    def _frame(self, rows: list[tuple]) -> pd.DataFrame:
        frame = pd.DataFrame(rows, columns=["key", "position", "closed_by", "reason", "exit_price", "ticks"])
        return frame.astype({"closed_by": "Int64"})

    def handle_in_order(self, key, frame: pd.DataFrame) -> pd.DataFrame | None:
        held = {k[0]: list(v) for k, v in self.open.iterator()}
        before, changed, out = set(held), set(), []
        for ms, event, price, is_open in zip(*[frame[c].tolist() for c in ("ms", "event_id", "price", "is_open")]):
            if is_open:
                held[event] = [price, 0, ms, price]
                changed.add(event)
                if self.max_age_ms is not None:
                    self.handle.registerTimer(ms + self.max_age_ms)
                continue
            for pid, pos in list(held.items()):
                pos[1], pos[3] = pos[1] + 1, price
                changed.add(pid)
                if price <= pos[0] * (1 - self.stop):
                    reason, at = "CLOSED_SL", pos[0] * (1 - self.stop)
                elif price >= pos[0] * (1 + self.target):
                    reason, at = "CLOSED_TP", pos[0] * (1 + self.target)
                elif pos[1] >= self.hold:
                    reason, at = "CLOSED_EXPIRY", price
                else:
                    continue
                out.append((key[0], pid, event, reason, at, pos[1]))
                del held[pid]
        for pid in before - set(held):
            self.open.removeKey((pid,))
        for pid in changed & set(held):
            entry, seen, opened, last = held[pid]
            self.open.updateValue((pid,), (float(entry), int(seen), int(opened), float(last)))
        return self._frame(out) if out else None

    def handle_time(self, key, ms: int) -> pd.DataFrame | None:
        if self.max_age_ms is None:
            return None
        old = [(k[0], *v) for k, v in self.open.iterator() if v[2] + self.max_age_ms <= ms]
        for pid, *_ in old:
            self.open.removeKey((pid,))
        return self._frame([(key[0], pid, None, "CLOSED_AGE", last, seen) for pid, _, seen, _, last in old]) if old else None


def _run(stream: DataFrame, key: str, processor: StatefulProcessor, schema: str, delay: str) -> DataFrame:
    return stream.withWatermark("ts", delay).groupBy(key).transformWithStateInPandas(
        statefulProcessor=processor, outputStructType=schema, outputMode="Append",
        timeMode="EventTime")


def miss_streaks(stream: DataFrame, delay: str = "1 hour") -> DataFrame:
    """stream: (sym, ts, event_id, pred, actual, tradeable)."""
    return _run(stream, "sym", MissStreak(),
                "sym string, event_id bigint, miss_dir string, miss_count int, flip boolean", delay)


def running_mean(stream: DataFrame, alpha: float, delay: str = "1 hour") -> DataFrame:
    return _run(stream, "sym", RunningMean(alpha), "sym string, event_id bigint, ema double", delay)


def direction_streaks(stream: DataFrame, delay: str = "1 hour") -> DataFrame:
    return _run(stream, "sym", DirectionStreak(),
                "sym string, event_id bigint, direction string, run int", delay)


def position_monitor(stream: DataFrame, stop: float = 0.03, target: float = 0.06,
                     hold: int = 10, max_age_ms: int | None = None, delay: str = "1 hour") -> DataFrame:
    """stream: (key, ts, event_id, price, is_open)."""
    return _run(stream, "key", PositionMonitor(stop, target, hold, max_age_ms),
                "key string, position bigint, closed_by bigint, reason string, "
                "exit_price double, ticks int", delay)
