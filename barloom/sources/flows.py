"""Institutional flow tables from CSV and nested JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.exprs import c
from ..schemas import FLOW_DOCUMENT

COLUMNS = ("date", "fii_net_cr", "dii_net_cr")


def read_flow_csv(spark: SparkSession, path: str) -> DataFrame:
    """(date, fii_net_cr, dii_net_cr); header names may differ in case and blanks."""
    df = spark.read.option("header", True).csv(path)
    df = df.toDF(*[x.strip().lower() for x in df.columns])
    absent = [x for x in COLUMNS if x not in df.columns]
    if absent:
        raise ValueError(f"flow table must have columns {COLUMNS}, missing {absent}")
    return df.select("date", *[F.trim(x).try_cast("double").alias(x) for x in COLUMNS[1:]])


def latest_flow(flows: DataFrame, source: str = "csv") -> DataFrame:
    """One row: the newest date with both figures."""
    known = flows.na.drop(subset=list(COLUMNS[1:]))
    return known.agg(F.max_by(F.struct(*COLUMNS), "date").alias("r")).select(
        F.lit(source).alias("source"), "r.*").where(c("date").isNotNull())


def flow_documents(docs: DataFrame, text: str = "json") -> DataFrame:
    """Flatten nested documents to one row per date; dashes and gaps count as zero."""
    day = F.explode(F.from_json(text, FLOW_DOCUMENT)["category"]).alias("d")
    entry = docs.select(day).select(F.col("d.date").alias("date"), F.explode("d.value").alias("e"))
    value = F.coalesce(F.col("e.netCr").try_cast("double"), F.lit(0.0))
    foreign = F.coalesce(F.col("e.category").rlike("FII|FPI"), F.lit(False))
    return entry.groupBy("date").agg(F.max(F.when(foreign, value)).alias("fii_net_cr"),
                                     F.max(F.when(~foreign, value)).alias("dii_net_cr"))


def accounting_number(x: str | Column) -> Column:
    """"1,234", currency signs and (negative) parentheses; anything else is 0."""
    text = F.trim(F.regexp_replace(c(x), "[,₹]", ""))
    negative = text.rlike(r"^\(.*\)$")
    number = F.coalesce(F.regexp_replace(text, r"^[()]+|[()]+$", "").try_cast("double"), F.lit(0.0))
    return F.when(negative, -number).otherwise(number)
