"""The corpus pipeline: raw documents to packed token sequences in five stages.

Each stage works on what the one before kept and returns the columns of ``documents``; the last one
returns the pieces of the packed sequences.  Tokens cannot be had in SQL, so the pipeline has no
oracle; it is tested stage by stage against brute force.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.llm import decontaminate, linededup, minhash, packing, quality
from barloom.llm.registry import tokenizer_path
from barloom.llm.store import stored


def _as_documents(df: DataFrame, columns: list[str]) -> DataFrame:
    """The given columns, with the length of the text as it is now."""
    if "n_chars" in columns:
        df = df.withColumn("n_chars", F.char_length("text").cast("long"))
    return df.select(*columns)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go; of the others, the lines that failed a rule."""
    return _as_documents(quality.kept_documents(docs), docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of 40 code points or more in five documents or more stay in the last one only."""
    return _as_documents(linededup.dedup_lines(docs, min_chars=40, min_docs=5), docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays; a document without a doc_id stays."""
    gone = minhash.near_duplicates(docs, width=5, percent=75).where(~F.col("kept")).select("doc_id")
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a benchmark item in them go."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontaminate.without_leaks(docs, items, threshold=0.75)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of all documents in sequences of 1024: the ids themselves and their checksum."""
    pieces = packing.pack(docs, tokenizer_path("byte_bpe_50k.json"), window=1024, end_id=0)
    return pieces.withColumn("ids_crc32", F.crc32("ids"))


STAGES = [("quality_rules", quality_rules), ("line_dedup", line_dedup), ("near_dedup", near_dedup),
          ("decontamination", decontamination), ("packing", pack)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents, each written as Parquet in the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
