"""Window specifications and rolling aggregates over one bar series per symbol.

A series is keyed by (symbol, date) and the key is unique: the bar aggregation guarantees it.  The
rows of one series are therefore bounded by the calendar (about 260 trading days or 52 weeks a
year), whatever the number of raw rows behind a hot symbol, so a window partitioned by symbol never
grows with the data.  Windows partitioned by date have no such bound; see ``operators.crosssection``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, Window, WindowSpec
from pyspark.sql import functions as F

from .exprs import c, ratio


def series(key="sym", order="date") -> WindowSpec:
    keys = [key] if isinstance(key, str) else list(key)
    return Window.partitionBy(*keys).orderBy(order)


def trailing(n: int, key="sym", order="date") -> WindowSpec:
    return series(key, order).rowsBetween(-(n - 1), 0)


def running(key="sym", order="date") -> WindowSpec:
    return series(key, order).rowsBetween(Window.unboundedPreceding, 0)


def rolling(fn: Callable[[Column], Column], x, n: int, min_obs: int | None = None,
            key="sym", order="date") -> Column:
    """Aggregate of the last n rows, missing unless at least min_obs of them hold a value."""
    w = trailing(n, key, order)
    need = n if min_obs is None else min_obs
    value = fn(c(x)).over(w)
    return value if need <= 1 else F.when(F.count(c(x)).over(w) >= need, value)


def mean(x, n, min_obs=None, **kw) -> Column:
    return rolling(F.avg, x, n, min_obs, **kw)


def std(x, n, min_obs=None, **kw) -> Column:
    return rolling(F.stddev_samp, x, n, min_obs, **kw)


def total(x, n, min_obs=None, **kw) -> Column:
    return rolling(F.sum, x, n, min_obs, **kw)


def low(x, n, min_obs=None, **kw) -> Column:
    return rolling(F.min, x, n, min_obs, **kw)


def high(x, n, min_obs=None, **kw) -> Column:
    return rolling(F.max, x, n, min_obs, **kw)


def median(x, n, min_obs=None, **kw) -> Column:
    return rolling(lambda v: F.percentile(v, F.lit(0.5)), x, n, min_obs, **kw)


def slope(x, n, key="sym", order="date", row="row") -> Column:
    """Least-squares slope over the last n rows on the row number; only for full windows."""
    w = trailing(n, key, order)
    fit = F.regr_slope(c(x), F.col(row).cast("double")).over(w)
    return F.when(F.count(c(x)).over(w) == n, fit)


def shift(x, n: int, key="sym", order="date") -> Column:
    w = series(key, order)
    return F.lag(c(x), n).over(w) if n >= 0 else F.lead(c(x), -n).over(w)


def change(x, n: int = 1, key="sym", order="date") -> Column:
    """Relative change over n rows."""
    return ratio(c(x), shift(x, n, key, order)) - 1


def diff(x, n: int = 1, key="sym", order="date") -> Column:
    return c(x) - shift(x, n, key, order)


def filled(x, key="sym", order="date") -> Column:
    """Last known value."""
    return F.last(c(x), ignorenulls=True).over(running(key, order))


def forward(x, n: int, key="sym", order="date") -> Column:
    """Return over the next n rows."""
    return ratio(shift(x, -n, key, order), c(x)) - 1
