"""Sinks (SNK-*): everything is written to the shared folder and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.exprs import c, rounded
from ..operators import metrics
from ..plans import factors as plan
from ..plans import ranking as weekly
from ..session import new_path
from ..sources import release, snapshots
from .aggregates import sided
from .base import RANKED, block, query, r, sql
from .crosssection import ranked
from .sourcing import VERSION, released
from .statistics import factor_ic, quintile_statistics


@query("SNK-1_release_tables", sql("bars fund factors", """SELECT 'panel' AS name, count(*) AS rows, count(DISTINCT sym) AS symbols FROM bars
UNION ALL SELECT 'fundamentals', count(*), count(DISTINCT sym) FROM fund UNION ALL SELECT 'factors', count(*), count(DISTINCT sym) FROM factors"""))
def _(t):
    root = released(t)
    parts = [release.load(t.spark, root, n).agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("sym").alias("symbols"))
             .select(F.lit(n).alias("name"), "rows", "symbols") for n in ("panel", "fundamentals", "factors")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("SNK-1_release_panel_rows", sql("bars", f"SELECT sym, date, {r('close; high; low; volume; deliv_pct', 9)} FROM bars"))
def _(t):
    return rounded(release.load_panel(t.spark, released(t)), 9)


@query("SNK-2_universe_csv", sql("bars", "SELECT DISTINCT sym AS symbol, (SELECT max(date) FROM bars) AS as_of FROM bars"))
def _(t):
    return release.universe(t.spark, released(t))


@query("SNK-3_coverage_csv", sql("factors", " UNION ALL ".join(
    f"SELECT '{f}' AS factor, round_even(avg(CAST({f} IS NOT NULL AS INTEGER)) * 100, 1) AS non_null_pct FROM factors" for f in RANKED)))
def _(t):
    return release.coverage(t.spark, released(t))


@query("SNK-4_manifest_json", sql("bars factors fund g_look g_ret g_dup g_cov", f"""SELECT '{VERSION}' AS version, CAST(30 AS INTEGER) AS horizon_days,
  count(DISTINCT sym) AS n_symbols, min(date) AS date_min, max(date) AS date_max, count(*) AS panel_rows, (SELECT count(*) FROM factors) AS factor_rows,
  (SELECT count(*) FROM fund) AS fund_rows, (SELECT count(*) FILTER (passed) + 1 FROM (SELECT passed FROM g_look UNION ALL SELECT passed FROM g_ret
  UNION ALL SELECT passed FROM g_dup UNION ALL SELECT passed FROM g_cov)) AS gates_passed FROM bars"""))
def _(t):
    m = release.manifest(t.spark, released(t))
    return m.select("version", "horizon_days", "n_symbols", "date_min", "date_max", c("rows.panel").alias("panel_rows"),
                    c("rows.factors").alias("factor_rows"), c("rows.fundamentals").alias("fund_rows"),
                    F.size(F.filter("validation", lambda g: g["passed"])).cast("bigint").alias("gates_passed"))


MILLIONTHS = "CAST(CAST(floor({} * 1000000.0::DOUBLE + 0.5::DOUBLE) AS BIGINT) AS VARCHAR)"
FINGERPRINTED = " || '|' || ".join(f"coalesce({x}, '~')" for x in [
    MILLIONTHS.format("close"), "CAST(date AS VARCHAR)", *map(MILLIONTHS.format, ("deliv_pct", "high", "low", "open")), "sym",
    MILLIONTHS.format("volume")])


@query("SNK-5_content_fingerprint", sql("bars", f"""SELECT substr(sha256(concat_ws('-', CAST(sum(CAST('0x' || substr(m, 1, 15) AS HUGEINT)) AS VARCHAR),
  CAST(sum(CAST('0x' || substr(m, 18, 15) AS HUGEINT)) AS VARCHAR), CAST(count(*) AS VARCHAR))), 1, 16) AS fingerprint
FROM (SELECT md5({FINGERPRINTED}) AS m FROM bars)"""))
def _(t):
    return release.fingerprint(t.bars)


@query("SNK-6_ranking_snapshot_json", sql("ranked", """SELECT * FROM (
  (SELECT 'top' AS side, CAST(as_of AS VARCHAR) AS as_of, rank, symbol, close, mom_12_1_pct, ret20_pct, score, earnings_soon FROM ranked ORDER BY rank LIMIT 20) UNION ALL
  (SELECT 'bottom', CAST(as_of AS VARCHAR), rank, symbol, close, mom_12_1_pct, ret20_pct, score, earnings_soon FROM ranked ORDER BY rank DESC LIMIT 20))"""))
def _(t):
    path = new_path(t.spark, "ranking")
    weekly.snapshot(ranked(t)).write.json(path)
    snap = snapshots.read_snapshots(t.spark, path)
    side = lambda s: snapshots.rows(snap, s).withColumn("side", F.lit(s))
    return side("top").unionByName(side("bottom"))


@query("SNK-7_fold_metrics_csv", sql("sided", f"""SELECT CAST(fold AS INTEGER) AS fold, {r('''coverage=avg(CAST(side <> 0 AS INTEGER)); trade_win_rate=coalesce(avg(CAST(net > 0 AS INTEGER)) FILTER (side <> 0), 0);
  avg_trade_ret_pct=coalesce(avg(net) FILTER (side <> 0) * 100, 0)''')}, count(*) FILTER (side <> 0) AS trades, count(*) FILTER (side = 1) AS longs,
  count(*) FILTER (side = -1) AS shorts FROM sided GROUP BY 1"""))
def _(t):
    path = new_path(t.spark, "folds")
    df = rounded(metrics.trading(sided(t), ["fold"]))
    df.write.option("header", True).csv(path)
    return t.spark.read.schema(df.schema).option("header", True).csv(path)


@query("SNK-8_model_payload", sql("cellstats", """SELECT sym, model, CAST(horizon AS VARCHAR) AS horizon, CASE WHEN sig >= 0.5 THEN 'LONG' ELSE 'SHORT' END AS direction,
  row_number() OVER (PARTITION BY model, horizon ORDER BY sig DESC, sym) AS rank, round_even(ae * 100, 1) AS acc_excess_pct, n FROM cellstats"""))
def _(t):
    path = new_path(t.spark, "payload")
    long = plan.model_bench(t.dataset, (5, 10, 20), t.bound)
    cell = F.struct("direction", "rank", "acc_excess_pct", "n")
    per_model = long.groupBy("sym", "model").agg(F.map_from_entries(F.collect_list(
        F.struct(c("horizon").cast("string").alias("key"), cell.alias("value")))).alias("by_horizon"))
    docs = per_model.groupBy("sym").agg(F.map_from_entries(F.collect_list(F.struct("model", "by_horizon"))).alias("by"))
    docs.write.json(path)
    kind = "sym string, by map<string, map<string, struct<direction: string, rank: bigint, acc_excess_pct: double, n: bigint>>>"
    back = t.spark.read.schema(kind).json(path)
    inner = back.select("sym", F.explode("by").alias("model", "h")).select("sym", "model", F.explode("h").alias("horizon", "v"))
    return inner.select("sym", "model", "horizon", "v.direction", "v.rank", "v.acc_excess_pct", "v.n")


@query("SNK-9_metrics_json", sql("factors q_mrc q_f3c fic_grid", f"""SELECT CAST(max(date) AS VARCHAR) AS as_of, count(*) AS n_rows, count(DISTINCT sym) AS n_symbols,
  round_even(avg(CAST(deliv_pct IS NOT NULL AS INTEGER)) * 100, 1) AS delivery_coverage_pct, (SELECT round(hit_rate, 5) FROM q_mrc) AS hit_mr, (SELECT round(hit_rate, 5) FROM q_f3c) AS hit_fund3,
  (SELECT count(*) FROM fic_grid) AS n_factors, (SELECT bool_or(coalesce(abs(t_nonovlp) >= 1.96::DOUBLE, FALSE)) FROM fic_grid) AS any_factor_significant FROM factors"""))
def _(t):
    from ..operators import joins, stats
    path = new_path(t.spark, "metrics")
    stored = t.stored_factors
    common = stored.na.drop(subset=["score_mr", "score_fund3"])
    hit = lambda s: quintile_statistics(t, common, s, 4).select(F.round("hit_rate", 5)).scalar()
    tests = stats.date_grid_tests(factor_ic(t, stored), joins.every_hth_date(stored, 10))
    ic = tests.agg(F.struct(F.count(F.lit(1)).alias("n"), F.bool_or("significant").alias("any"))).scalar()
    doc = stored.agg(
        F.max("date").cast("string").alias("as_of"), F.count(F.lit(1)).alias("n_rows"), F.count_distinct("sym").alias("n_symbols"),
        F.bround(F.avg(c("deliv_pct").isNotNull().cast("double")) * 100, 1).alias("delivery_coverage_pct"))
    doc = doc.select("*", F.struct(hit("score_mr").alias("score_mr"), hit("score_fund3").alias("score_fund3")).alias("hit_rate"), ic.alias("ic"))
    doc.write.json(path)
    kind = ("as_of string, n_rows bigint, n_symbols bigint, delivery_coverage_pct double, hit_rate struct<score_mr: double, score_fund3: double>, "
            "ic struct<n: bigint, any: boolean>")
    back = t.spark.read.schema(kind).json(path)
    return back.select("as_of", "n_rows", "n_symbols", "delivery_coverage_pct", c("hit_rate.score_mr").alias("hit_mr"),
                       c("hit_rate.score_fund3").alias("hit_fund3"), c("ic.n").alias("n_factors"), c("ic.any").alias("any_factor_significant"))
