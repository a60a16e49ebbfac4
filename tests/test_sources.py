"""Readers, normalisation, releases and gates."""

import datetime as dt

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from barloom.operators import quality, rows as rw
from barloom.plans import factors as plan
from barloom.session import new_path
from barloom.sources import flows, raw, release, snapshots, statements, tables, universe

D = dt.date


def test_universe_text(spark):
    text = ["# comment", "", "  TCS.NS, Tata  ", "^NSEI", "INFY", "INR=X,Rupee", "TCS.NS, Again", "GOLD=X"]
    lines = spark.createDataFrame([(x,) for x in text], "line string")
    assert [r.sym for r in universe.symbols(lines).collect()] == ["TCS.NS", "^NSEI", "TCS.NS"]
    got = {r.sym: r.name for r in universe.tickers(lines).select("sym", F.col("name")).collect() for r in [r]}
    assert set(got) == {"TCS.NS", "^NSEI", "INFY.NS", "INR=X", "GOLD=X"}


def test_accounting_numbers(spark):
    text = ["1,234.5", "₹ 7", "(2,000)", "n/a", "", None, "-3"]
    df = spark.createDataFrame([(x,) for x in text], "s string")
    assert [r.v for r in df.select(flows.accounting_number("s").alias("v")).collect()] == \
        [1234.5, 7.0, -2000.0, 0.0, 0.0, 0.0, -3.0]


def test_flow_documents(spark):
    doc = ('{"category": [{"date": "2024-01-02", "value": [{"category": "FII/FPI *", "netCr": "-12.5"}, '
           '{"category": "DII", "netCr": "-"}]}, {"date": "2024-01-03", "value": [{"category": "FPI"}]}]}')
    got = flows.flow_documents(spark.createDataFrame([(doc,)], "json string")).orderBy("date").collect()
    assert [tuple(r) for r in got] == [("2024-01-02", -12.5, 0.0), ("2024-01-03", 0.0, None)]


def test_flow_csv_needs_columns(spark):
    path = new_path(spark, "bad-flow")
    spark.createDataFrame([("a", 1)], "date string, x int").write.option("header", True).csv(path)
    with pytest.raises(ValueError, match="dii_net_cr"):
        flows.read_flow_csv(spark, path)


def test_raw_bars_keep_last_load_then_drop_missing(spark):
    df = spark.createDataFrame([("A", D(2024, 1, 1), 1, "10"), ("A", D(2024, 1, 1), 2, "bad"),
                                ("A", D(2024, 1, 2), 1, "bad"), ("A", D(2024, 1, 2), 2, "12")],
                               "sym string, date date, load_seq int, CLOSE string")
    got = raw.normalise(df, {"CLOSE": "close"}).collect()
    assert [(r.date.day, r.close) for r in got] == [(2, 12.0)]


def test_weekend_labels(spark):
    df = spark.createDataFrame([("A", D(2024, 1, 5), 1.0), ("A", D(2024, 1, 6), 2.0), ("A", D(2024, 1, 7), 3.0),
                                ("A", D(2024, 1, 14), 4.0)], "sym string, date date, close double")
    got = {r.date: r.close for r in raw.weekend_to_friday(df).collect()}
    assert got == {D(2024, 1, 5): 3.0, D(2024, 1, 12): 4.0}


def test_fundamentals_guard_equity_and_growth(spark):
    rows = [("A", "income", "Net Income Common Stockholders", D(2020, 12, 31), 0.0),
            ("A", "income", "Net Income Common Stockholders", D(2021, 12, 31), 5.0),
            ("A", "balance", "Common Stock Equity", D(2020, 12, 31), -1.0),
            ("A", "balance", "Common Stock Equity", D(2021, 12, 31), 10.0),
            ("A", "balance", "Common Stock Equity", D(2022, 12, 31), 10.0),
            ("A", "income", "Basic EPS", D(2021, 12, 31), 1.5)]
    df = spark.createDataFrame(rows, "sym string, statement string, item string, period date, value double")
    got = statements.fundamentals(df).orderBy("fy_end").collect()
    assert [r.fy_end.year for r in got] == [2020, 2021]
    assert got[0].roe is None and got[1].roe == 0.5 and got[1].earn_growth is None and got[1].eps == 1.5
    assert got[1].avail_date == D(2022, 3, 31)


def test_release_resolution(spark):
    v = lambda *names: spark.createDataFrame([(n,) for n in names], "version string")
    assert release.resolve(v("2024.01", "2024.03-sample", "2024.02")).first().version == "2024.02"
    assert release.resolve(v("2024.01-sample", "2024.03-sample")).first().version == "2024.03-sample"


def bench_and_fund(spark, panel):
    bench = panel.groupBy("date").agg(F.avg("close").alias("bench"))
    fund = panel.groupBy("sym").agg(F.lit(D(2021, 12, 31)).alias("fy_end"), F.lit(D(2022, 3, 31)).alias("avail_date"),
                                    F.lit(1.0).alias("eps"), F.lit(0.1).alias("roe"), F.lit(0.2).alias("earn_growth"),
                                    F.lit(0.3).alias("profit_margin"))
    return bench, fund


def test_release_round_trip(spark, panel):
    bench, fund = bench_and_fund(spark, panel)
    factors = plan.factor_table(panel, bench, fund, horizon=10, bound=6)
    root = new_path(spark, "release-test")
    cols = ["date", "sym", "close", "high", "low", "volume", "deliv_pct"]
    release.write_release(panel.select(cols), fund, factors, plan.RANKED, root, "2024.01", 10)
    back = release.load_panel(spark, root, "AAA.NS", "2022-02-01", "2022-02-28")
    assert back.count() == panel.where("sym = 'AAA.NS' and date between '2022-02-01' and '2022-02-28'").count()
    assert all("/panel/version=2024.01/" in f for f in back.inputFiles())
    assert "PushedFilters: [IsNotNull(sym)" in back._jdf.queryExecution().toString()
    two = release.load_factors(spark, root, columns=["rev"])
    assert two.columns == ["date", "sym", "rev"]
    with pytest.raises(release.UnknownColumns):
        release.load_factors(spark, root, columns=["nope"])
    m = release.manifest(spark, root).first()
    assert m.n_symbols == 6 and m.rows.panel == panel.count() and all(g.passed for g in m.validation)
    assert m.fingerprint.panel == release.fingerprint(panel.select(cols).repartition(7)).first()[0]


def test_releases_survive_each_other(spark, panel):
    bench, fund = bench_and_fund(spark, panel)
    factors = plan.factor_table(panel, bench, fund, horizon=10, bound=6)
    root = new_path(spark, "release-test")
    with pytest.raises(release.UnknownVersion):
        release.load_panel(spark, root)
    half = panel.where("sym < 'DDD.NS'")
    release.write_release(half, fund, factors, plan.RANKED, root, "2024.01", 10)
    release.write_release(panel, fund, factors, plan.RANKED, root, "2024.02", 10)
    with pytest.raises(quality.GateFailure, match="duplicates"):
        release.write_release(panel.unionByName(panel.limit(3)), fund, factors, plan.RANKED, root, "2024.03", 10)
    assert sorted(release.published(spark, root)) == ["2024.01", "2024.02"]
    assert release.load_panel(spark, root).count() == panel.count()
    assert release.load_panel(spark, root, version="2024.01").count() == half.count()
    assert release.universe(spark, root, "2024.01").count() == 3 and release.universe(spark, root).count() == 6
    assert release.coverage(spark, root, "2024.01").count() == len(plan.RANKED)
    with pytest.raises(release.UnknownVersion):
        release.load_factors(spark, root, version="2024.03")
    with pytest.raises(ValueError, match="exists"):
        release.write_release(half, fund, factors, plan.RANKED, root, "2024.02", 10)
    release.write_release(half, fund, factors, plan.RANKED, root, "2024.02", 10, replace=True)
    assert release.load_panel(spark, root).count() == half.count()


def test_releases_are_written_from_tables_built_once(spark, monkeypatch):
    """Three releases neither read the tables three times nor send the parts to the driver for each."""
    from barloom.catalog import base, sourcing
    given, write = [], release.write_release
    monkeypatch.setattr(release, "write_release", lambda *a, **k: (given.extend(a[:3]), write(*a, **k))[1])
    monkeypatch.setattr(sourcing, "RELEASES", {})
    sourcing.released(base.Inputs(spark, "/root/testdata/sf0.001"))
    assert len(given) == 9 and not any(df.inputFiles() for df in given)


def test_daily_benchmark_has_every_day(spark):
    from barloom.sources import tables as src
    folder = "/root/testdata/sf0.001"
    days = src.lines(spark, folder).select("day").distinct().count()
    daily = src.benchmark(spark, folder, "day")
    assert daily.count() == days and daily.where("date IS NULL").count() == 0


def test_gates_fail_loudly(spark, panel):
    bench, fund = bench_and_fund(spark, panel)
    late = fund.withColumn("avail_date", F.col("fy_end"))
    assert not quality.no_look_ahead(late).first().passed
    twice = panel.unionByName(panel.limit(3))
    assert quality.duplicates(twice).first().detail.startswith("3 ")
    assert not quality.schema_gate(panel.drop("volume"), fund).first().passed
    wild = panel.select(F.lit(-1.5).alias("ret_20"), F.lit(0.0).alias("fwd_excess"))
    assert not quality.return_sanity(wild).first().passed
    sparse = panel.select(F.when(F.col("sym") == "AAA.NS", 1.0).alias("rev"))
    gates = quality.coverage_gate(sparse, ["rev"])
    assert not gates.first().passed
    with pytest.raises(quality.GateFailure, match="coverage"):
        quality.enforce(gates)


def test_snapshot_history_and_lookup(spark, panel):
    scored = panel.withColumn("score", F.col("close"))
    path = new_path(spark, "snap-test")
    snapshots.history(scored, "score", 2).write.json(path)
    snap = snapshots.latest(snapshots.read_snapshots(spark, path))
    last = panel.agg(F.max("date")).first()[0]
    assert snap.first().as_of == str(last)
    order = [r.sym for r in panel.where(F.col("date") == F.lit(last)).orderBy(F.col("close").desc()).collect()]
    assert [r.symbol for r in snapshots.rows(snap).collect()] == order[:2]
    assert [r.symbol for r in snapshots.rows(snap, "bottom").collect()] == order[::-1][:2]
    assert snapshots.by_symbol(snap, order[0]).count() == 1


def test_wide_long_and_missing_columns(panel):
    wide = rw.wide(panel, "close", ["AAA.NS", "BBB.NS"])
    assert rw.long(wide, "close").count() == panel.where("sym in ('AAA.NS', 'BBB.NS')").count()
    assert rw.with_missing_columns(panel, ["close", "vix"]).select("vix").distinct().collect()[0][0] == 0.0


def test_closes_are_those_of_the_bars(spark):
    """Lines shrink to weeks before they move; keys, days and amounts may be missing."""
    days = [D(2024, 1, 1) + dt.timedelta(days=k) for k in range(40)] + [None]
    rows = [(None if k % 17 == 0 else k % 3, days[k * 7 % 41], None if k % 13 == 0 else 100 + k, None if k % 19 == 0 else 1 + k % 9,
             float(k), k % 4) for k in range(600)] + [(9, days[0], 5, None, 1.0, None)]
    items = spark.createDataFrame(rows, "l_suppkey long, day date, cents long, qty long, price double, final_qty long")
    got = tables.closes_from_lines(items, "l_suppkey")
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "MapInArrow" in plan
    weeks = [pa.RecordBatch.from_pylist([{"sym": 1, "date": days[k % 35], "cents": 2} for k in range(1000)])] * 1200
    pieces = list(tables.piece_sums(weeks))  # a hot symbol moves as one row a period and piece
    assert sum(x.num_rows for x in pieces) == 3 * 35 and sum(sum(x["cents"].to_pylist()) for x in pieces) == 2_400_000
    bars = tables.bars_from_lines(items.withColumn("sym", F.col("l_suppkey").cast("string")))
    assert got.dtypes == bars.select(*got.columns).dtypes
    assert sorted(map(repr, got.collect())) == sorted(map(repr, bars.select(*got.columns).collect()))
