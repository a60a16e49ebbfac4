"""Data-quality gates (DQ-*)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.exprs import c, rounded
from ..operators import quality
from .base import RANKED, block, query, r, sql


@query("DQ-1_schema_gate", sql("bars", """SELECT 'schema' AS gate, TRUE AS passed, (SELECT count(*) FROM (DESCRIBE bars)) || ' panel columns' AS detail,
  (SELECT count(*) FROM bars) AS rows"""))
def _(t):
    rows = t.bars.agg(F.count(F.lit(1)).alias("rows"))
    return quality.schema_gate(t.bars, t.fund).withColumn("rows", rows.scalar())


block("g_look", "fund", """SELECT 'no_lookahead' AS gate, count(*) FILTER (avail_date <= fy_end) = 0 AS passed,
  count(*) FILTER (avail_date <= fy_end) || ' rows with avail_date <= fy_end' AS detail FROM fund""")
block("g_ret", "factors", """SELECT 'returns_sanity' AS gate, NOT (a > 0 OR coalesce(ma > 10, FALSE) OR b > 0 OR coalesce(mb > 10, FALSE)) AS passed,
  (a + b) || ' values below -100%' AS detail FROM (SELECT count(*) FILTER (ret_20 < -1) AS a, count(*) FILTER (fwd_excess < -1) AS b,
  max(abs(ret_20)) AS ma, max(abs(fwd_excess)) AS mb FROM factors)""")
block("g_dup", "bars", """SELECT 'duplicates' AS gate, count(*) = count(DISTINCT (sym, date)) AS passed,
  (count(*) - count(DISTINCT (sym, date))) || ' duplicate (sym, date) rows' AS detail FROM bars""")
block("g_cov", "factors", "SELECT 'coverage' AS gate, count(*) FILTER (v < 0.3) = 0 AS passed, 'below limit: ' || "
      "coalesce(string_agg(f, ', ' ORDER BY f) FILTER (v < 0.3), '') AS detail FROM (" + " UNION ALL ".join(
          f"SELECT '{f}' AS f, avg(CAST({f} IS NOT NULL AS INTEGER)) AS v FROM factors" for f in RANKED) + ")")


@query("DQ-2_no_look_ahead", sql("g_look", "SELECT * FROM g_look"))
def _(t):
    return quality.no_look_ahead(t.fund)


@query("DQ-3_return_sanity", sql("g_ret", "SELECT * FROM g_ret"))
def _(t):
    return quality.return_sanity(t.factors)


@query("DQ-4_duplicates", sql("g_dup", "SELECT * FROM g_dup"))
def _(t):
    return quality.duplicates(t.bars)


@query("DQ-4_duplicates_in_raw_lines", sql("", """SELECT 'duplicates' AS gate, count(*) = count(DISTINCT (l_orderkey, l_linenumber)) AS passed,
  (count(*) - count(DISTINCT (l_orderkey, l_linenumber))) || ' duplicate (sym, date) rows' AS detail FROM lineitem"""))
def _(t):
    raw = t.table("lineitem").select(c("l_orderkey").alias("sym"), c("l_linenumber").alias("date"))
    return quality.duplicates(raw)


@query("DQ-5_coverage_gate", sql("g_cov", "SELECT * FROM g_cov"))
def _(t):
    return quality.coverage_gate(t.factors, RANKED)


@query("DQ-6_all_gates", sql("g_look g_ret g_dup g_cov", """SELECT 'schema' AS gate, TRUE AS passed, '8 panel columns' AS detail
UNION ALL SELECT * FROM g_look UNION ALL SELECT * FROM g_ret UNION ALL SELECT * FROM g_dup UNION ALL SELECT * FROM g_cov"""))
def _(t):
    return quality.all_gates(t.bars, t.fund, t.stored_factors, RANKED)


@query("DQ-7_delivery_coverage", sql("bars", f"SELECT {r('deliv_cov=avg(CAST(nullif(deliv_pct, 0) IS NOT NULL AS INTEGER)) * 100')} FROM bars"))
def _(t):
    known = F.nullif(c("deliv_pct"), F.lit(0.0)).isNotNull().cast("double")
    return rounded(t.bars.agg((F.avg(known) * 100).alias("deliv_cov")))
