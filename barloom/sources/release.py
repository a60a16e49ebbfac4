"""Versioned dataset releases: writing, resolving and loading.

Every artefact of a release lies in ``<root>/<artefact>/version=<version>``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.exprs import c
from ..operators import quality

PANEL, FUNDAMENTALS, FACTORS = "panel", "fundamentals", "factors"


class UnknownColumns(KeyError):
    """A requested factor column does not exist."""


class UnknownVersion(KeyError):
    """A requested release was never published."""


# ---- loading -------------------------------------------------------------------------------
def slice_rows(df: DataFrame, symbols: Sequence[str] | str | None = None,
               start: str | None = None, end: str | None = None) -> DataFrame:
    """Symbol list and inclusive date range; both reach the file scan."""
    if symbols is not None:
        df = df.where(c("sym").isin([symbols] if isinstance(symbols, str) else list(symbols)))
    if start is not None:
        df = df.where(c("date") >= F.lit(start).cast("date"))
    if end is not None:
        df = df.where(c("date") <= F.lit(end).cast("date"))
    return df


def resolve(versions: DataFrame, version: str = "version") -> DataFrame:
    """One row: the newest full release; a sample wins only where no full release exists."""
    full = ~F.contains(F.lower(version), F.lit("sample"))
    return versions.agg(F.max(F.struct(full.alias("full"), c(version).alias("version"))).alias("b")) \
        .select("b.version")


def place(root: str, name: str, version: str) -> str:
    """Folder of one artefact of one release."""
    return f"{root}/{name}/version={version}"


def published(spark: SparkSession, root: str) -> list[str]:
    """Versions with a manifest; it is written last, so a release without one does not exist."""
    try:
        rows = manifest(spark, root, every=True).select("version").distinct().collect()
    except AnalysisException as absent:
        if absent.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return []
    return [r["version"] for r in rows]


def pick(spark: SparkSession, root: str, version: str | None = None) -> str:
    """The given version, or the newest, of the published ones."""
    have = published(spark, root)
    if version is None and have:
        return resolve(spark.createDataFrame([(v,) for v in have], "version string")).first()[0]
    if version not in have:
        raise UnknownVersion(f"no release {version}; published: {sorted(have)}")
    return version


def load(spark: SparkSession, root: str, name: str, version: str | None = None) -> DataFrame:
    return spark.read.parquet(place(root, name, pick(spark, root, version)))


def load_panel(spark, root, symbols=None, start=None, end=None, version=None) -> DataFrame:
    return slice_rows(load(spark, root, PANEL, version), symbols, start, end)


def load_factors(spark, root, symbols=None, start=None, end=None, columns=None,
                 version=None) -> DataFrame:
    df = load(spark, root, FACTORS, version)
    if columns is not None:
        keep = ["date", "sym", *[x for x in columns if x not in ("date", "sym")]]
        absent = [x for x in keep if x not in df.columns]
        if absent:
            raise UnknownColumns(f"unknown factor columns: {absent}")
        df = df.select(*keep)
    return slice_rows(df, symbols, start, end)


def load_fundamentals(spark, root, symbols=None, version=None) -> DataFrame:
    return slice_rows(load(spark, root, FUNDAMENTALS, version), symbols)


def universe(spark: SparkSession, root: str, version: str | None = None) -> DataFrame:
    return spark.read.schema("symbol string, as_of date").option("header", True).csv(
        place(root, "universe", pick(spark, root, version)))


def coverage(spark: SparkSession, root: str, version: str | None = None) -> DataFrame:
    return spark.read.schema("factor string, non_null_pct double").option("header", True).csv(
        place(root, "coverage", pick(spark, root, version)))


def manifest(spark: SparkSession, root: str, version: str | None = None, every: bool = False) -> DataFrame:
    """The manifest of one release (default: the newest), or of all of them."""
    rows = spark.read.schema(MANIFEST).option("recursiveFileLookup", True).json(f"{root}/manifest")
    return rows if every else rows.where(c("version") == pick(spark, root, version))


MANIFEST = ("version string, built_utc timestamp, horizon_days int, n_symbols bigint, date_min date, date_max date, "
            "rows struct<panel: bigint, factors: bigint, fundamentals: bigint>, "
            "validation array<struct<gate: string, passed: boolean, detail: string>>, "
            "fingerprint struct<panel: string, factors: string, fundamentals: string>")


# ---- writing -------------------------------------------------------------------------------
def fingerprint(df: DataFrame) -> DataFrame:
    """Order-free content hash: part files are not byte-stable, their rows are.

    A row's text has its values in the order of the column names, doubles as whole millionths; the first
    and the last 15 hex digits of its MD5 are summed up over all rows.
    """
    def text(name: str, kind: str) -> Column:
        value = F.floor(c(name) * 1e6 + 0.5).cast("string") if kind == "double" else c(name).cast("string")
        return F.coalesce(F.when(c(name).isNotNull(), value), F.lit("~"))

    code = F.md5(F.concat_ws("|", *[text(n, k) for n, k in sorted(df.dtypes)]))
    part = lambda start: F.sum(F.conv(F.substring(code, start, 15), 16, 10).cast("decimal(38,0)")).cast("string")
    return df.agg(F.concat_ws("-", part(1), part(18), F.count(F.lit(1)).cast("string")).alias("text")) \
        .select(F.substring(F.sha2("text", 256), 1, 16).alias("fingerprint"))


def write_release(panel: DataFrame, fund: DataFrame, factors: DataFrame, ranked: Sequence[str],
                  root: str, version: str, horizon: int, check: bool = True,
                  replace: bool = False) -> None:
    """Write a release into folders of its own; other releases stay as they are.

    The tables are written once, gates run over what was written, and only if they pass does the
    manifest follow, which publishes the release.  A published version is not touched unless
    ``replace`` is set; what a failed candidate left behind is not read and makes way for the next.
    """
    spark = panel.sparkSession
    if version in published(spark, root) and not replace:
        raise ValueError(f"release {version} exists; set replace to write it again")
    for name, df in ((PANEL, panel), (FUNDAMENTALS, fund), (FACTORS, factors)):
        df.write.mode("overwrite").parquet(place(root, name, version))
    p, f, u = (spark.read.parquet(place(root, n, version)) for n in (PANEL, FACTORS, FUNDAMENTALS))
    gates = quality.all_gates(p, u, f, ranked)
    if check:
        quality.enforce(gates)
    newest_day = p.agg(F.max("date")).scalar()
    (p.select(c("sym").alias("symbol")).distinct().withColumn("as_of", newest_day)
     .orderBy("symbol").write.mode("overwrite").option("header", True)
     .csv(place(root, "universe", version)))
    coverage_table(f, ranked).write.mode("overwrite").option("header", True).csv(
        place(root, "coverage", version))
    build_manifest(p, u, f, gates, version, horizon).write.mode("overwrite").json(
        place(root, "manifest", version))


def coverage_table(factors: DataFrame, ranked: Sequence[str]) -> DataFrame:
    return quality.coverage(factors, ranked).select(
        "factor", F.bround(c("coverage") * 100, 1).alias("non_null_pct"))


def build_manifest(panel: DataFrame, fund: DataFrame, factors: DataFrame, gates: DataFrame,
                   version: str, horizon: int) -> DataFrame:
    """One row with counts, dates, gate results and content hashes."""
    size = lambda df: df.agg(F.count(F.lit(1))).scalar()
    checks = gates.agg(F.array_sort(F.collect_list(F.struct("gate", "passed", "detail"))))
    base = panel.agg(F.count_distinct("sym").alias("n_symbols"), F.min("date").alias("date_min"),
                     F.max("date").alias("date_max"), F.count(F.lit(1)).alias("_rows"))
    return base.select(
        F.lit(version).alias("version"), F.current_timestamp().alias("built_utc"), F.lit(horizon).alias("horizon_days"), "n_symbols",
        "date_min", "date_max",
        F.struct(c("_rows").alias("panel"), size(factors).alias("factors"),
                 size(fund).alias("fundamentals")).alias("rows"),
        checks.scalar().alias("validation"),
        F.struct(fingerprint(panel).scalar().alias("panel"),
                 fingerprint(factors).scalar().alias("factors"),
                 fingerprint(fund).scalar().alias("fundamentals")).alias("fingerprint"))
