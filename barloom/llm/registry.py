"""Registered queries of this subpackage and, where SQL can say them, their oracles for DuckDB."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (binary, decontaminate, licenses, linededup, minhash, packing, periodicruns, prefixcounts, quality, secretscan,
               sharding, sketches, vectorcodes)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def register(fn: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn
    return register


def documents(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/documents.parquet")


def tokenizer_path(name: str) -> str:
    """Place of a public tokenizer's file, the same on every machine."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


OP7_SQL = """
WITH lines AS (
  SELECT doc_id, i AS place, parts[i] AS line,
         translate(regexp_replace(parts[i], '^[\\x20\\x09-\\x0D]+|[\\x20\\x09-\\x0D]+$', '', 'g'),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS line_key
  FROM (SELECT doc_id, parts, unnest(range(1, len(parts) + 1)) AS i
        FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents))),
common AS (
  SELECT line_key, max(doc_id) AS keeper FROM lines WHERE length(line_key) >= 40
  GROUP BY line_key HAVING count(DISTINCT doc_id) >= 5),
marked AS (
  SELECT l.doc_id, l.place, l.line, c.keeper IS NOT NULL AND c.keeper <> l.doc_id AS gone
  FROM lines l LEFT JOIN common c ON l.line_key = c.line_key)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (WHERE gone)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""


@query("op7_line_dedup", OP7_SQL)
def op7(spark: SparkSession, folder: str) -> DataFrame:
    out = linededup.dedup_lines(documents(spark, folder), min_chars=40, min_docs=5)
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.encode("text", "UTF-8"), 256).alias("kept_sha256"))


@query("op9_packing")
def op9(spark: SparkSession, folder: str) -> DataFrame:
    pieces = packing.pack(documents(spark, folder), tokenizer_path("byte_bpe_50k.json"), window=1024, end_id=0)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens",
                         "sequence_id", "offset")


@query("op1_token_binary_output")
def op1(spark: SparkSession, folder: str) -> DataFrame:
    return binary.materialise_order(documents(spark, folder), tokenizer_path("byte_bpe_50k.json"))


@query("op4_token_counts")
def op4(spark: SparkSession, folder: str) -> DataFrame:
    counts = prefixcounts.prefix_counts(documents(spark, folder), tokenizer_path("word_bpe_49k.json"))
    return prefixcounts.answers(counts, budget=2048) \
        .select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 2048).alias("over_limit"), "fit_chars")


@query("op10_quality_rules")
def op10(spark: SparkSession, folder: str) -> DataFrame:
    return quality.clean(documents(spark, folder)).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "lost_words")


@query("op2_minhash_near_dedup")
def op2(spark: SparkSession, folder: str) -> DataFrame:
    return minhash.near_duplicates(documents(spark, folder), width=5, percent=75)


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def license_sql(threshold: float) -> str:
    """Base places by word positions; labels by comparing every block of up to three lines with every template."""
    word = "[^\\x{0}-\\x{2F}\\x{3A}-\\x{60}\\x{7B}-\\x{7F}]+"
    phrases = ", ".join(f"({_quoted(p)}, {_quoted(label)})" for p, label in licenses.PHRASES.items())
    sets = ", ".join(f"({n}, {_quoted(label)}, [{', '.join(map(_quoted, tokens))}])"
                     for n, (label, tokens) in enumerate(licenses.template_sets(licenses.TEMPLATES)))
    return f"""
WITH lowered AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text
  FROM documents),
worded AS (SELECT doc_id, text, regexp_extract_all(text, '{word}') AS words FROM lowered),
phrases AS (SELECT string_split(phrase, ' ') AS parts, label FROM (VALUES {phrases}) v(phrase, label)),
spots AS (
  SELECT doc_id, label, i - 1 AS spot
  FROM (SELECT doc_id, words, unnest(range(1, len(words) + 1)) AS i FROM worded), phrases
  WHERE words[i:i + len(parts) - 1] = parts),
base AS (
  SELECT doc_id, count(*) AS n_base, min(spot) AS first_word, max(spot) AS last_word, list(DISTINCT label) AS base_labels
  FROM spots GROUP BY doc_id),
templates AS (SELECT * FROM (VALUES {sets}) v(nth, label, tokens)),
lines AS (
  SELECT doc_id, i, regexp_extract_all(parts[i], '{word}') AS one
  FROM (SELECT doc_id, parts, unnest(range(1, len(parts) + 1)) AS i
        FROM (SELECT doc_id, string_split(text, chr(10)) AS parts FROM lowered))),
next AS (
  SELECT doc_id, one, lead(one, 1) OVER after AS two, lead(one, 2) OVER after AS three
  FROM lines WINDOW after AS (PARTITION BY doc_id ORDER BY i)),
blocks AS (
  SELECT doc_id, list_distinct(one) AS tokens FROM next
  UNION ALL SELECT doc_id, list_distinct(list_concat(one, two)) FROM next WHERE len(one) > 0 AND len(two) > 0
  UNION ALL SELECT doc_id, list_distinct(list_concat(one, two, three)) FROM next
  WHERE len(one) > 0 AND len(two) > 0 AND len(three) > 0),
hits AS (
  SELECT l.doc_id, t.label, len(list_intersect(l.tokens, t.tokens)) / len(t.tokens) AS share
  FROM blocks l, templates t
  WHERE len(list_intersect(l.tokens, t.tokens)) >= ceil({threshold} * len(t.tokens) - 1e-9)),
method AS (SELECT doc_id, max(share) AS share, list(DISTINCT label) AS labels FROM hits GROUP BY doc_id)
SELECT w.doc_id, len(w.words)::BIGINT AS n_words, coalesce(b.n_base, 0)::BIGINT AS n_base,
       b.first_word::BIGINT AS first_word, b.last_word::BIGINT AS last_word,
       array_to_string(list_sort(coalesce(b.base_labels, [])), ',') AS base_labels,
       array_to_string(list_sort(list_distinct(list_concat(coalesce(b.base_labels, []), coalesce(m.labels, [])))), ',') AS labels,
       CASE WHEN b.n_base > 0 THEN 1.0::DOUBLE ELSE coalesce(m.share, 0.0)::DOUBLE END AS score
FROM worded w LEFT JOIN base b USING (doc_id) LEFT JOIN method m USING (doc_id)
"""


@query("op5_license_scan", license_sql(0.85))
def op5(spark: SparkSession, folder: str) -> DataFrame:
    return licenses.scan_licenses(documents(spark, folder), threshold=0.85).drop("blocks")


@query("op6_weighted_tree_sharding")
def op6(spark: SparkSession, folder: str) -> DataFrame:
    out = sharding.shard_documents(documents(spark, folder), sharding.even_tree(3, 2, 4))
    return out.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


@query("op3_benchmark_decontamination")
def op3(spark: SparkSession, folder: str) -> DataFrame:
    return decontaminate.find_leaks(documents(spark, folder), spark.read.parquet(f"{folder}/benchmark.parquet"), threshold=0.75)


@query("op8_secret_scan")
def op8(spark: SparkSession, folder: str) -> DataFrame:
    out = secretscan.scan_secrets(documents(spark, folder))
    # the secret itself stays out of the result
    return out.select("doc_id", "place", F.char_length("value").cast("long").alias("length"),
                      F.sha2(F.encode("value", "UTF-8"), 256).alias("value_sha256"), "label", "score", "finding")


@query("op13_vector_code_compression")
def op13(spark: SparkSession, folder: str) -> DataFrame:
    vectors = spark.read.parquet(f"{folder}/embeddings.parquet")
    return vectorcodes.compress(vectors, parts=16, entries=64, rounds=2, scale=256).drop("label")


@query("op12_periodic_runs")
def op12(spark: SparkSession, folder: str) -> DataFrame:
    out = periodicruns.find_runs(documents(spark, folder), fold_tails=True)
    sha = lambda c: F.sha2(F.encode(c, "UTF-8"), 256)
    return out.select("doc_id", "n_runs", "start", "length", "period", "exponent_milli",
                      sha("runs").alias("runs_sha256"), sha("collapsed").alias("collapsed_sha256"), "n_words")


@query("op11_document_fingerprints")
def op11(spark: SparkSession, folder: str) -> DataFrame:
    out = sketches.fingerprints(documents(spark, folder))
    return out.select("doc_id", "n_chars", F.sha2(F.encode("edited_text", "UTF-8"), 256).alias("edited_sha256"),
                      "fingerprint", "edited_fingerprint", "near_edited", "near_next")
