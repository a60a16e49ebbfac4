import os
import sys

import numpy as np
import pandas as pd
import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from barloom.session import build_session  # noqa: E402

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = build_session("tests", "local[4]", {
        "spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "6g"})
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def panel_pd():
    """Six symbols with drift, gaps in the calendar and some missing volumes."""
    rng = np.random.default_rng(42)
    days = pd.bdate_range("2022-01-03", periods=420)
    frames = []
    for i, sym in enumerate(["AAA.NS", "BBB.NS", "CCC.NS", "DDD.NS", "EEE.NS", "FFF.NS"]):
        close = 100 * np.exp(np.cumsum(0.0004 * (i - 2.5) + rng.normal(0, 0.012, len(days))))
        frame = pd.DataFrame({
            "sym": sym, "date": days.date, "close": close,
            "high": close * (1 + rng.uniform(0.001, 0.01, len(days))),
            "low": close * (1 - rng.uniform(0.001, 0.01, len(days))),
            "volume": rng.integers(100_000, 5_000_000, len(days)).astype(float),
            "deliv_pct": rng.uniform(10, 90, len(days))})
        frame["open"] = frame["close"].shift(1).fillna(frame["close"])
        frames.append(frame.drop(index=frame.index[5 + i::37]))
    return pd.concat(frames, ignore_index=True)


@pytest.fixture(scope="session")
def panel(spark, panel_pd):
    return spark.createDataFrame(panel_pd).cache()


def frame_of(spark, rows, schema):
    return spark.createDataFrame(rows, schema)
