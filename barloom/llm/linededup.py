"""Line deduplication across documents.

Normalised lines are exploded and hashed, distinct documents are counted per hash, lines of hashes
at or over the threshold are dropped, and the rest is put together again by position.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .arrow import slices, utf8
from .store import free_name, stored

BLANKS = b" \t\n\x0b\x0c\r"


def line_hash(line: bytes, min_chars: int) -> bytes | None:
    """128 bits for the line's key, or none if the key is too short.

    Key: the line without ASCII white space at both ends, A-Z lower-cased (``bytes.lower`` leaves
    all other letters).  Two keys that share 128 bits by chance are not to be expected.
    """
    key = line.strip(BLANKS).lower()
    if len(key) < min_chars or (not key.isascii() and len(key.decode()) < min_chars):
        return None
    return hashlib.blake2b(key, digest_size=16).digest()


def dropped_lines(docs: DataFrame, min_chars: int, min_docs: int) -> DataFrame:
    """(doc_id, hashes of the lines that this document loses).

    Only keys of at least ``min_chars`` code points are exploded, once per row, and rows are summed
    before the shuffle: a line that every document has reaches its reducer as one row per task.  Where
    doc_ids repeat, what their rows count too often is taken off, so documents are counted, not rows.
    The largest doc_id of a key keeps its lines.
    """
    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = [{line_hash(line, min_chars) for line in set(text.split(b"\n"))} - {None}
                     for text in utf8(batch.column("text"))]
            flat = pa.array([h for some in found for h in some], pa.binary())
            offsets = np.concatenate([[0], np.cumsum([len(some) for some in found])]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.ListArray.from_arrays(pa.array(offsets), flat)], ["doc_id", "hashes"])

    schema = T.StructType([docs.schema["doc_id"], T.StructField("hashes", T.ArrayType(T.BinaryType()))])
    lines = docs.select("doc_id", "text").mapInArrow(hashes, schema).select("doc_id", F.explode("hashes").alias("hash"))
    # stored, so that the join below reads both sides from shuffles of its own and Spark can split a hot hash
    repeated = stored(docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1).select("doc_id"), "repeated-ids")
    extra = lines.join(repeated, "doc_id", "left_semi").groupBy("hash", "doc_id").agg((F.count(F.lit(1)) - 1).alias("n")) \
        .groupBy("hash").agg(F.sum("n").alias("extra")).where(F.col("extra") > 0)
    common = stored(lines.groupBy("hash").agg(F.count(F.lit(1)).alias("docs"), F.max("doc_id").alias("keeper"))
                    .where(F.col("docs") >= min_docs).join(extra, "hash", "left")
                    .where(F.col("docs") - F.coalesce("extra", F.lit(0)) >= min_docs).select("hash", "keeper"), "common-lines")
    return lines.join(common, "hash").where(F.col("doc_id") != F.col("keeper")) \
        .groupBy("doc_id").agg(F.collect_set("hash").alias("dropped"))


def dedup_lines(docs: DataFrame, min_chars: int = 40, min_docs: int = 5) -> DataFrame:
    """All columns of ``docs`` with ``text`` rebuilt from the lines that stay, plus ``n_lines``
    (before) and ``n_dropped``; columns of these two names in the input are replaced.

    A null or empty text is one empty line; null becomes empty.  Rows that repeat a doc_id are one
    document: they count once and all keep a line whose largest doc_id is theirs.
    Rows without a doc_id keep all their lines and are not counted.  Ties cannot occur: the keeper is
    a maximum.  An empty table gives an empty table.
    """
    base = docs.drop("n_lines", "n_dropped")
    own, bad_lines = (free_name(base.columns, n) for n in ("_id", "_dropped"))
    lost = dropped_lines(base.where(F.col("doc_id").isNotNull()), min_chars, min_docs) \
        .select(F.col("doc_id").alias(own), F.col("dropped").alias(bad_lines))
    names = base.columns

    def rebuild(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts, before, gone = [], [], []
            for text, bad in zip(utf8(batch.column("text")), batch.column(bad_lines).to_pylist()):
                lines = text.split(b"\n")
                before.append(len(lines))
                if bad:
                    bad = set(bad)
                    lines = [line for line in lines if line_hash(line, min_chars) not in bad]
                    text = b"\n".join(lines)
                gone.append(before[-1] - len(lines))
                texts.append(text)
            columns = [pa.array(texts, pa.binary()).cast(pa.string()) if n == "text" else batch.column(n) for n in names]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(before, pa.int64()), pa.array(gone, pa.int64())],
                                             [*names, "n_lines", "n_dropped"])

    schema = T.StructType([*base.schema.fields, T.StructField("n_lines", T.LongType()),
                           T.StructField("n_dropped", T.LongType())])
    return base.join(lost, base["doc_id"] == lost[own], "left").drop(own).mapInArrow(rebuild, schema)
