"""Explicit table schemas; no reader infers anything."""

from __future__ import annotations

from pyspark.sql import types as T


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind, True) for name, kind in fields.items()])


S, D, I, L, DT, TS, B = (T.StringType(), T.DoubleType(), T.IntegerType(), T.LongType(),
                         T.DateType(), T.TimestampType(), T.BooleanType())

PANEL = _struct(sym=S, date=DT, close=D, high=D, low=D, volume=D, deliv_pct=D)
BARS = _struct(sym=S, date=DT, open=D, high=D, low=D, close=D, volume=D, deliv_pct=D)
FUNDAMENTALS = _struct(sym=S, fy_end=DT, avail_date=DT, eps=D, roe=D, earn_growth=D,
                       profit_margin=D)
SERIES = _struct(date=DT, close=D)
UNIVERSE = _struct(symbol=S, as_of=DT)
FLOWS = _struct(date=S, fii_net_cr=D, dii_net_cr=D)
FLOW_DOCUMENT = _struct(category=T.ArrayType(_struct(
    date=S, value=T.ArrayType(_struct(category=S, netCr=S)))))
RANKED_ROW = _struct(rank=I, symbol=S, close=D, mom_12_1_pct=D, ret20_pct=D, score=D,
                     earnings_soon=B)
SNAPSHOT = _struct(generated_at=S, as_of=S, model=S, universe_size=L,
                   fii_dii=_struct(source=S, date=S, fii_net_cr=D, dii_net_cr=D),
                   top=T.ArrayType(RANKED_ROW), bottom=T.ArrayType(RANKED_ROW))
EVENTS = _struct(event_id=L, ts=T.TimestampNTZType(), user_id=L, event_type=S, value=D, props=S)


def ddl(schema: T.StructType) -> str:
    return ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in schema.fields)
