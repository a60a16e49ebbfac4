"""Registry of queries and the shared SQL building blocks of their oracles."""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

from ..plans import factors as plan
from ..session import materialise
from ..sources import tables as src
from ..sources.statements import fundamentals

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: What these queries state about their panels: a date has at most this many brands or suppliers.  It is
#: not counted, and a false statement costs spilling (for suppliers' factors: memory of a task), not rows; the
#: ``*_unbounded`` queries state nothing.
NAMES_PER_DATE = 1_000_000


class Inputs:
    """Lazily built input tables of one folder."""

    def __init__(self, spark: SparkSession, folder: str):
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        self.spark, self.folder = spark, folder

    def table(self, name: str) -> DataFrame:
        return src.table(self.spark, self.folder, name)

    @cached_property
    def bars(self) -> DataFrame:
        return src.brand_bars(self.spark, self.folder)

    @cached_property
    def wide_bars(self) -> DataFrame:
        return src.supplier_bars(self.spark, self.folder)

    @cached_property
    def wide_closes(self) -> DataFrame:
        return src.supplier_closes(self.spark, self.folder)

    @cached_property
    def bench(self) -> DataFrame:
        return src.benchmark(self.spark, self.folder)

    @cached_property
    def hourly(self) -> DataFrame:
        return src.event_bars(self.spark, self.folder)

    @cached_property
    def statements(self) -> DataFrame:
        return src.statement_lines(self.spark, self.folder)

    @cached_property
    def fund(self) -> DataFrame:
        return fundamentals(self.statements)

    @cached_property
    def wide_fund(self) -> DataFrame:
        return fundamentals(src.statement_lines(self.spark, self.folder, "supplier"))

    @cached_property
    def wide_bound(self) -> int:
        return NAMES_PER_DATE

    @cached_property
    def factors(self) -> DataFrame:
        return plan.factor_table(self.bars, self.bench, self.fund, bound=self.bound)

    @cached_property
    def stored_factors(self) -> DataFrame:
        """The factor table written once, for queries that read it several times."""
        return materialise(self.factors)

    @cached_property
    def dataset(self) -> DataFrame:
        return plan.dataset(self.bars, self.bench, (5, 10, 20))

    @cached_property
    def signals(self) -> DataFrame:
        return plan.signals(self.bars, self.bench, bound=self.bound)

    @cached_property
    def stored_bars(self) -> DataFrame:
        return materialise(self.bars)

    @cached_property
    def stored_fund(self) -> DataFrame:
        return materialise(self.fund)

    @cached_property
    def stored_signals(self) -> DataFrame:
        return materialise(self.signals)

    @cached_property
    def bound(self) -> int:
        return NAMES_PER_DATE


def query(name: str, sql: str | None = None):
    """Register ``fn(inputs) -> DataFrame`` under ``name`` with its oracle."""

    def register(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = lambda spark, folder: fn(Inputs(spark, folder))
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


# --------------------------------------------------------------------------------------------
# SQL building blocks: name -> (names it needs, text)
# --------------------------------------------------------------------------------------------
BLOCKS: dict[str, tuple[list[str], str]] = {}


COLUMNS: dict[str, str] = {}


def block(name: str, needs: str, text: str, columns: str = "") -> None:
    """``columns`` is given for recursive tables only."""
    BLOCKS[name] = (needs.split(), text)
    COLUMNS[name] = columns


def _order(names: list[str], seen: list[str]) -> list[str]:
    for name in names:
        if name not in seen:
            _order(BLOCKS[name][0], seen)
            seen.append(name)
    return seen


def sql(needs: str, text: str) -> str:
    """``WITH`` the needed blocks in dependency order, then the text."""
    names = _order(needs.split(), [])
    parts = [f"{n}({COLUMNS[n]}) AS ({BLOCKS[n][1]})" if COLUMNS[n]
             else f"{n} AS MATERIALIZED ({BLOCKS[n][1]})" for n in names]
    return ("WITH RECURSIVE " + ",\n".join(parts) + "\n" if parts else "") + text


def r(cols: str, digits: int = 6) -> str:
    """Rounded select list from 'name' or 'name=expression' entries separated by ';'."""
    out = []
    for item in cols.split(";"):
        name, _, expr = item.strip().partition("=")
        out.append(f"round({expr or name}, {digits}) + 0.0 AS {name.strip()}")
    return ", ".join(out)


def div(a: str, b: str) -> str:
    return f"(({a}) / nullif({b}, 0))"


W = "PARTITION BY sym ORDER BY date"


def rows(n: int) -> str:
    return f"({W} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


def roll(fn: str, x: str, n: int, mp: int | None = None) -> str:
    mp = n if mp is None else mp
    return (f"CASE WHEN count({x}) OVER {rows(n)} >= {mp} THEN {fn}({x}) OVER {rows(n)} END")


def lag(x: str, n: int) -> str:
    return f"{'lag' if n >= 0 else 'lead'}({x}, {abs(n)}) OVER ({W})"


def ret(n: int, x: str = "close") -> str:
    return f"({x} / nullif({lag(x, n)}, 0) - 1)"


def fwd(n: int, x: str = "close") -> str:
    return f"({lag(x, -n)} / nullif({x}, 0) - 1)"


def prank(x: str, by: str = "date") -> str:
    """Average-rank percentile, missing stays missing."""
    return (f"CASE WHEN {x} IS NOT NULL THEN (rank() OVER (PARTITION BY {by} ORDER BY {x} ASC NULLS"
            f" LAST) + (count(*) OVER (PARTITION BY {by}, {x}) - 1) / 2.0)"
            f" / count({x}) OVER (PARTITION BY {by}) END")


_LINES = """SELECT {key} AS sym, CAST(l_shipdate AS DATE) AS day,
    CAST(round(l_extendedprice * 100) AS BIGINT) AS cents, CAST(l_quantity AS BIGINT) AS qty,
    l_extendedprice / l_quantity AS price,
    CASE WHEN l_linestatus = 'F' THEN CAST(l_quantity AS BIGINT) ELSE 0 END AS fq
  FROM lineitem{join}"""
_BARS = """SELECT sym, CAST(date_trunc('week', day) AS DATE) AS date,
    arg_min(c / 100.0::DOUBLE / q, day) AS open, max(hi) AS high, min(lo) AS low,
    CAST(sum(c) AS BIGINT) / 100.0::DOUBLE / CAST(sum(q) AS BIGINT) AS close,
    CAST(sum(q) AS DOUBLE) AS volume,
    100.0::DOUBLE * CAST(sum(fq) AS BIGINT) / CAST(sum(q) AS BIGINT) AS deliv_pct
  FROM (SELECT sym, day, CAST(sum(cents) AS BIGINT) AS c, CAST(sum(qty) AS BIGINT) AS q,
          max(price) AS hi, min(price) AS lo, CAST(sum(fq) AS BIGINT) AS fq
        FROM {src} GROUP BY sym, day)
  GROUP BY 1, 2"""
block("brand_lines", "", _LINES.format(key="p_brand", join=" JOIN part ON l_partkey = p_partkey"))
block("bars", "brand_lines", _BARS.format(src="brand_lines"))
block("supplier_lines", "", _LINES.format(key="CAST(l_suppkey AS VARCHAR)", join=""))
block("wbars", "supplier_lines", _BARS.format(src="supplier_lines"))
block("bench", "", """SELECT CAST(date_trunc('week', l_shipdate) AS DATE) AS date,
    CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS BIGINT) / 100.0::DOUBLE
      / CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS bench
  FROM lineitem GROUP BY 1""")
block("hourly", "", """SELECT event_type AS sym, date_trunc('hour', ts) AS date, max(value) AS high,
    min(value) AS low,
    CAST(sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT) / 100.0::DOUBLE / count(value) AS close,
    CAST(count(value) AS DOUBLE) AS volume
  FROM events GROUP BY 1, 2""")
block("yearly", "", """SELECT p_brand AS sym, CAST(year(l_shipdate) AS INTEGER) AS fy,
    CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)
      * (100 - CAST(round(l_discount * 100) AS BIGINT))) AS BIGINT) / 10000.0::DOUBLE AS ni,
    CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS BIGINT) / 100.0::DOUBLE AS rev,
    CAST(sum(CAST(l_quantity AS BIGINT)) AS DOUBLE) AS qty
  FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2""")
block("wyearly", "", BLOCKS["yearly"][1].replace("p_brand AS sym", "CAST(l_suppkey AS VARCHAR) AS sym")
      .replace(" JOIN part ON l_partkey = p_partkey", ""))
block("fund", "yearly", """SELECT sym, make_date(fy, 12, 31) AS fy_end,
    CAST(make_date(fy, 12, 31) + INTERVAL 90 DAY AS DATE) AS avail_date, ni / qty AS eps,
    CASE WHEN rev * 0.5::DOUBLE > 0 THEN ni / (rev * 0.5::DOUBLE) END AS roe,
    ni / nullif(lag(ni) OVER (PARTITION BY sym ORDER BY fy), 0) - 1 AS earn_growth,
    ni / nullif(rev, 0) AS profit_margin
  FROM yearly""")
block("wfund", "wyearly", BLOCKS["fund"][1].replace("FROM yearly", "FROM wyearly"))

MOM = div(lag("close", 21), lag("close", 252)) + " - 1"
RANKED = plan.RANKED

def factor_blocks(p: str, bars: str, fund: str) -> None:
    """Register <p>factors over a bar and a statement table."""
    block(p + "feat0", f"{bars} bench", f"""SELECT b.*, bench, volume * close AS vc, {ret(20)} AS ret_20,
    {MOM} AS mom_12_1, {ret(126)} AS mom_6m,
    deliv_pct - {roll('avg', 'deliv_pct', 20, 5)} AS deliv_chg20, {fwd(30)} AS fwd_ret
  FROM {bars} b LEFT JOIN bench USING (date)""")
    block(p + "feat", p + "feat0", f"""SELECT *, -ret_20 AS rev, {roll('avg', 'vc', 20)} AS liq,
    deliv_pct * ret_20 AS deliv_x_ret, fwd_ret - {fwd(30, 'bench')} AS fwd_excess FROM {p}feat0""")
    block(p + "fact0", f"{p}feat {fund}", f"""SELECT f.* EXCLUDE (bench, vc, fwd_ret), avail_date, eps, roe,
    earn_growth, profit_margin, eps / nullif(close, 0) AS earn_yield
  FROM {p}feat f ASOF LEFT JOIN {fund} u ON f.sym = u.sym AND f.date >= u.avail_date
  WHERE f.sym IN (SELECT sym FROM {fund})""")
    block(p + "fact1", p + "fact0", "SELECT *, " + ", ".join(
        f"{prank(f)} AS rank_{f}" for f in RANKED) + f" FROM {p}fact0")
    block(p + "fact2", p + "fact1", f"""SELECT *, round((rank_mom_12_1 + rank_rev) / 2, 12) AS score_mr,
    round((rank_rev + (1 - rank_deliv_x_ret) + rank_earn_yield) / 3, 12) AS score_fund3 FROM {p}fact1""")
    block(p + "factors", p + "fact2", f"""SELECT *, {prank('score_mr')} AS rank_score_mr,
    {prank('score_fund3')} AS rank_score_fund3 FROM {p}fact2""")


factor_blocks("", "bars", "fund")
factor_blocks("w", "wbars", "wfund")
block("ds0", "bars", f"""SELECT *, volume * close AS vc, {ret(20)} AS ret_20, {MOM} AS mom_12_1,
    {ret(126)} AS mom_6m, {fwd(5)} AS fwd_5, {fwd(10)} AS fwd_10, {fwd(20)} AS fwd_20,
    count(close) OVER (PARTITION BY sym) AS nb FROM bars""")
block("ds1", "ds0", f"SELECT *, {roll('avg', 'vc', 20)} AS liq FROM ds0")
block("ds", "ds1 bench", """SELECT ds1.*, fwd_5 - b5 AS exc_5, fwd_10 - b10 AS exc_10, fwd_20 - b20 AS exc_20
  FROM ds1 LEFT JOIN (SELECT date, lead(bench, 5) OVER w / bench - 1 AS b5,
      lead(bench, 10) OVER w / bench - 1 AS b10, lead(bench, 20) OVER w / bench - 1 AS b20
    FROM bench WINDOW w AS (ORDER BY date)) USING (date)
  WHERE nb >= 300 AND mom_12_1 IS NOT NULL AND mom_6m IS NOT NULL AND ret_20 IS NOT NULL
    AND liq IS NOT NULL""")
block("bfwd", "bench", """SELECT date, lead(bench, 10) OVER (ORDER BY date) / bench - 1 AS bench_fwd
  FROM bench""")
block("sig0", "bars bfwd", f"""SELECT sym, date, close, -{ret(20)} AS rev, {fwd(10)} AS fwd_ret,
    {fwd(10)} - bench_fwd AS fwd_excess FROM bars LEFT JOIN bfwd USING (date)
  QUALIFY rev IS NOT NULL AND fwd_excess IS NOT NULL""")
block("signals", "sig0", f"""SELECT *, {prank('rev')} AS proba, CAST(fwd_excess > 0 AS INTEGER) AS label,
    CAST(year(date) AS INTEGER) AS fold FROM sig0""")


def ic_blocks(name: str, src: str, factors, target: str, min_n: int, where: str = "TRUE",
              sign=None) -> None:
    """Register <name>: (date, factor, ic, n)."""
    sign = sign or {}
    union = " UNION ALL ".join(
        f"SELECT date, '{f}' AS factor, {'-' if sign.get(f, 1) < 0 else ''}{f} AS x, {target} AS y "
        f"FROM {src} WHERE {f} IS NOT NULL AND {target} IS NOT NULL AND {where}" for f in factors)
    block(name + "_l", src, union)
    block(name + "_r", name + "_l", f"SELECT *, {prank('x', 'date, factor')} AS rx, "
                                    f"{prank('y', 'date, factor')} AS ry FROM {name}_l")
    block(name, name + "_r", f"""SELECT date, factor, ic, n FROM (
      SELECT date, factor, covar_pop(rx, ry) / nullif(stddev_pop(rx) * stddev_pop(ry), 0) AS ic,
        count(*) AS n FROM {name}_r GROUP BY 1, 2) WHERE n >= {min_n} AND ic IS NOT NULL""")


def tests_blocks(name: str, src: str, key: str, order: str, x: str, horizon: int,
                 lags: str | None = None) -> None:
    """Register <name>: mean, n, t_naive, t_hac, t_nonoverlap, ... per key."""
    block(name + "_d", src, f"""SELECT {key}, {x} AS x, row_number() OVER w AS i,
      count(*) OVER (PARTITION BY {key}) AS n, {x} - avg({x}) OVER (PARTITION BY {key}) AS d
      FROM {src} WHERE {x} IS NOT NULL WINDOW w AS (PARTITION BY {key} ORDER BY {order})""")
    lag_expr = lags or str(max(1, 2 * horizon - 1))
    block(name + "_g", name + "_d", f"""SELECT a.{key}, b.i - a.i AS k, sum(a.d * b.d) / max(a.n) AS g,
      max(a.n) AS n, greatest(0, least(max({lag_expr.replace('n', 'a.n') if lags else lag_expr}),
        max(a.n) - 2)) AS lags
      FROM {name}_d a JOIN {name}_d b ON a.{key} = b.{key} AND b.i >= a.i GROUP BY 1, 2""")
    block(name + "_h", name + "_g", f"""SELECT {key}, max(n) AS n, max(lags) AS lags,
      sum(CASE WHEN k = 0 THEN g WHEN k <= lags THEN 2.0::DOUBLE * (1.0::DOUBLE - k / (lags + 1.0::DOUBLE)) * g
        ELSE 0 END) AS v FROM {name}_g GROUP BY 1""")
    block(name + "_se", name + "_h", f"""SELECT {key}, n, lags,
      CASE WHEN n >= 3 AND v > 0 THEN sqrt(v / n) END AS hac_se FROM {name}_h""")
    block(name + "_b", name + "_d", f"""SELECT {key}, avg(x) AS mean, count(x) AS n, stddev_samp(x) AS sd,
      avg(x) FILTER ((i - 1) % {horizon} = 0) AS sm, count(x) FILTER ((i - 1) % {horizon} = 0) AS sn,
      stddev_samp(x) FILTER ((i - 1) % {horizon} = 0) AS ss FROM {name}_d GROUP BY 1""")
    block(name, f"{name}_b {name}_se", f"""SELECT b.{key}, mean, b.n,
      round_even(b.n / {horizon}.0::DOUBLE, 1) AS n_effective,
      CASE WHEN b.n >= 3 THEN mean / nullif(sd / sqrt(b.n), 0) END AS t_naive,
      CASE WHEN b.n >= 3 THEN mean / nullif(hac_se, 0) END AS t_hac,
      CASE WHEN b.n >= 3 AND sn >= 3 THEN sm / nullif(ss / sqrt(sn), 0) END AS t_nonoverlap,
      CASE WHEN b.n >= 3 THEN (mean / nullif(sd / sqrt(b.n), 0)) / nullif(mean / nullif(hac_se, 0), 0)
        END AS inflation FROM {name}_b b JOIN {name}_se s ON b.{key} = s.{key}""")
