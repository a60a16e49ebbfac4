"""Projections, filters and reshaping (PRJ-*)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import indicators as ind
from ..functions import windows as w
from ..functions.exprs import c, clip, finite, ratio, rounded, zero_to_null
from ..operators import rows as rw
from ..plans.ranking import latest_rows
from .base import block, div, fwd, lag, query, r, ret, roll, rows, sql
from .timeseries import VR, bar_sql, keep

@query("PRJ-1_derived_columns", bar_sql("mid=(high + low) / 2; spread=high - low; turnover=close * volume", 9))
def _(t):
    return keep(t.bars.withColumns({"mid": (c("high") + c("low")) / 2, "spread": c("high") - c("low"),
                                    "turnover": c("close") * c("volume")}),
                "mid", "spread", "turnover", digits=9)


@query("PRJ-2_zero_to_missing", bar_sql("deliv=nullif(deliv_pct, 0); spread=nullif(high - low, 0)"))
def _(t):
    return keep(t.bars.withColumns({"deliv": zero_to_null("deliv_pct"),
                                    "spread": zero_to_null(c("high") - c("low"))}), "deliv", "spread")


@query("PRJ-3_neutral_defaults", bar_sql(f"ret_20=coalesce({ret(20)}, 0); ratio=coalesce({VR}, 1)"))
def _(t):
    return keep(t.bars.withColumns({"ret_20": F.coalesce(w.change("close", 20), F.lit(0.0)),
                                    "ratio": F.coalesce(ind.volume_ratio(), F.lit(1.0))}), "ret_20", "ratio")


@query("PRJ-4_infinities_to_missing", bar_sql(
    "inv=CASE WHEN isfinite(x) THEN x END",
    src="(SELECT sym, date, CASE WHEN deliv_pct = 0 THEN 'inf'::DOUBLE ELSE 1 / deliv_pct END AS x FROM bars)", needs="bars"))
def _(t):
    x = F.when(c("deliv_pct") == 0, F.lit(float("inf"))).otherwise(1 / zero_to_null("deliv_pct"))
    return keep(t.bars.withColumn("x", x).withColumn("inv", finite("x")), "inv")


@query("PRJ-5_clip", bar_sql(
    f"up=CASE WHEN {ret(1)} IS NOT NULL THEN greatest({ret(1)}, 0) END; "
    f"capped=CASE WHEN {ret(1)} IS NOT NULL THEN least(greatest({ret(1)}, -0.1::DOUBLE), 0.1::DOUBLE) END"))
def _(t):
    df = ind.returns(t.bars, (1,))
    return keep(df.withColumns({"up": clip("ret_1", lower=0.0), "capped": clip("ret_1", -0.1, 0.1)}), "up", "capped")


@query("PRJ-6_conditional_keep", bar_sql("plus=CASE WHEN close > open THEN close - open ELSE 0 END"))
def _(t):
    keep_ = F.when(c("close") > c("open"), c("close") - c("open")).otherwise(F.lit(0.0))
    return keep(t.bars.withColumn("plus", keep_), "plus")


@query("PRJ-7_row_extremes", bar_sql("body_top=greatest(close, open); body_bottom=least(close, open)"))
def _(t):
    return keep(t.bars.withColumns({"body_top": F.greatest("close", "open"),
                                    "body_bottom": F.least("close", "open")}), "body_top", "body_bottom")


@query("PRJ-8_drop_missing", sql("rets", f"SELECT sym, date, {r('ret_1; ret_20')} FROM rets WHERE ret_1 IS NOT NULL AND ret_20 IS NOT NULL"))
def _(t):
    return keep(ind.returns(t.bars, (1, 20)).na.drop(subset=["ret_1", "ret_20"]), "ret_1", "ret_20")


@query("PRJ-9_missing_feature_columns", sql("rets", f"SELECT sym, date, {r('ret_1=coalesce(ret_1, 0)')}, 0.0::DOUBLE AS vix, 0.0::DOUBLE AS fx FROM rets"))
def _(t):
    df = ind.returns(t.bars, (1,)).withColumn("ret_1", F.coalesce("ret_1", F.lit(0.0)))
    return keep(rw.with_missing_columns(df, ["ret_1", "vix", "fx"]), "ret_1", "vix", "fx")


@query("PRJ-10_symbol_cleaning", sql("", """SELECT s_suppkey, regexp_replace(s, '\\.NS$', '') AS bare,
  translate(regexp_replace(s, '[\\^=]', '', 'g'), '-/', '__') AS prefix
FROM (SELECT s_suppkey, CASE s_suppkey % 3 WHEN 0 THEN 'S' || s_suppkey || '.NS' WHEN 1 THEN '^IDX-' || s_suppkey
  ELSE 'FX/' || s_suppkey || '=X' END AS s FROM supplier)"""))
def _(t):
    k = c("s_suppkey").cast("string")
    s = (F.when(c("s_suppkey") % 3 == 0, F.concat(F.lit("S"), k, F.lit(".NS")))
         .when(c("s_suppkey") % 3 == 1, F.concat(F.lit("^IDX-"), k))
         .otherwise(F.concat(F.lit("FX/"), k, F.lit("=X"))))
    df = t.table("supplier").withColumn("s", s)
    return df.select("s_suppkey", rw.bare_symbol("s").alias("bare"), rw.context_prefix("s").alias("prefix"))


@query("PRJ-11_recent_window", sql("bars", f"SELECT sym, date, {r('close')} FROM bars WHERE date >= (SELECT max(date) FROM bars) - INTERVAL 730 DAY"))
def _(t):
    return keep(rw.since(t.bars, 730), "close")


@query("PRJ-12_latest_cross_section", sql("bars", f"SELECT sym, date, {r('close')} FROM bars WHERE date = (SELECT max(date) FROM bars)"))
def _(t):
    return keep(latest_rows(t.bars), "close")


@query("PRJ-13_latest_rows_per_symbol", sql("bars", f"SELECT sym, date, {r('close')} FROM bars QUALIFY row_number() OVER (PARTITION BY sym ORDER BY date DESC) <= 2"))
def _(t):
    return keep(rw.latest_per_symbol(t.bars, 2), "close")


#: The brands of the part table.
BRANDS = [f"Brand#{k}" for k in range(1, 26)]
WIDE = ", ".join(f"""max(round(close, 6) + 0.0) FILTER (sym = '{b}') AS "{b}\"""" for b in BRANDS)


@query("PRJ-14_long_to_wide", sql("bars", f"SELECT date, {WIDE} FROM bars GROUP BY date"))
def _(t):
    return rounded(rw.wide(t.bars, "close"))


@query("PRJ-15_wide_to_long", sql("bars", "SELECT date, sym, round(close, 6) + 0.0 AS close FROM bars WHERE close IS NOT NULL"))
def _(t):
    return rounded(rw.long(rw.wide(t.bars, "close"), "close").select("date", "sym", "close"))


@query("PRJ-16_latest_price_card", sql("bars", f"""SELECT sym, date, {r('close; ret_5; ret_20')} FROM (SELECT sym, date, close,
  coalesce({ret(5)} * 100, 0) AS ret_5, coalesce({ret(20)} * 100, 0) AS ret_20 FROM bars)
QUALIFY row_number() OVER (PARTITION BY sym ORDER BY date DESC) = 1"""))
def _(t):
    return rounded(rw.latest_price_card(t.bars))
