"""Small column helpers that keep the missing-value rules in one place.

Missing is NULL everywhere.  Comparisons with a missing value count as false, ratios over zero are
missing, clipping keeps missing values missing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x if isinstance(x, Column) else F.lit(x)


def ratio(a, b) -> Column:
    """a / b, missing where b is zero or missing."""
    return F.try_divide(c(a), c(b))


def zero_to_null(x) -> Column:
    return F.nullif(c(x), F.lit(0.0))


def nan_to_null(x) -> Column:
    return F.when(~F.isnan(c(x)), c(x))


def finite(x) -> Column:
    """NaN and the infinities become missing."""
    return F.when(~F.isnan(c(x)) & (F.abs(c(x)) < F.lit(float("inf"))), c(x))


def clip(x, lower=None, upper=None) -> Column:
    """Bound a value; ``greatest``/``least`` would replace a missing value by the bound."""
    out = c(x)
    if lower is not None:
        out = F.greatest(out, F.lit(lower))
    if upper is not None:
        out = F.least(out, F.lit(upper))
    return F.when(c(x).isNotNull(), out)


def flag(cond: Column) -> Column:
    """0/1 with missing comparisons as 0."""
    return F.coalesce(cond, F.lit(False)).cast("int")


def share(cond: Column) -> Column:
    """Share of rows where the condition holds."""
    return F.avg(F.coalesce(cond, F.lit(False)).cast("double"))


def tz_free(df: DataFrame) -> DataFrame:
    """Timestamps without zone in place of zoned ones."""
    zoned = [f.name for f in df.schema.fields if isinstance(f.dataType, T.TimestampType)]
    return df.withColumns({n: F.to_timestamp_ntz(F.date_format(n, "yyyy-MM-dd HH:mm:ss.SSSSSS"))
                           for n in zoned}) if zoned else df


def rounded(df: DataFrame, digits: int = 6, **per_column: int) -> DataFrame:
    """Round every double column; float sums differ in the last bits between engines."""
    cols = []
    for field in df.schema.fields:
        if isinstance(field.dataType, (T.DoubleType, T.FloatType)):
            n = per_column.get(field.name, digits)
            cols.append(F.round(f"`{field.name}`", n).alias(field.name))
        else:
            cols.append(F.col(f"`{field.name}`"))
    return df.select(*cols)
