"""Packing by concatenation and cutting.

First pass: every partition turns its documents into token ids, notes where each document starts in
the partition, and is stored.  The partitions' totals, summed in order, give every partition its
place in one long row of tokens.  Second pass: that row is cut at multiples of the window; a document
that crosses a border leaves a record on each side.  No rows move between the passes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .arrow import slices, worker_cache
from .store import stored
from .tokenids import BATCH_BYTES, PieceEncoder


def tokenised(docs: DataFrame, tokenizer: str, end_id: int) -> DataFrame:
    """(doc_id, part, part_start, doc_tokens, ids): the first pass, stored in the shared folder.

    ``ids`` are little-endian unsigned integers of 16 bits (of 32 for vocabularies over 65,536),
    with ``end_id`` behind the text's own; ``part_start`` counts the ids before it in the partition.
    """
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = worker_cache(f"pieces-{tokenizer}", lambda: PieceEncoder(tokenizer))
        end = np.array([end_id], encoder.kind).tobytes()
        part, start = TaskContext.get().partitionId(), 0
        for batch in slices(batches, budget=BATCH_BYTES):
            ids = [x + end for x in encoder.encode(batch.column("text"))]
            sizes = np.array([len(x) // encoder.kind.itemsize for x in ids], np.int64)
            starts = start + np.cumsum(sizes) - sizes
            start += int(sizes.sum())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(np.full(len(ids), part)), pa.array(starts), pa.array(sizes),
                 pa.array(ids, pa.binary())], ["doc_id", "part", "part_start", "doc_tokens", "ids"])

    schema = T.StructType([docs.schema["doc_id"], T.StructField("part", T.LongType()),
                           T.StructField("part_start", T.LongType()), T.StructField("doc_tokens", T.LongType()),
                           T.StructField("ids", T.BinaryType())])
    return stored(docs.select("doc_id", "text").mapInArrow(encode, schema), "token-ids")


def part_bases(rows: DataFrame, amount: str) -> DataFrame:
    """(part, base, total): the sum of ``amount`` over the parts before, one row per part."""
    totals = rows.groupBy("part").agg(F.sum(amount).alias("_n"))
    order = Window.orderBy("part")
    return totals.select("part", (F.sum("_n").over(order) - F.col("_n")).alias("base"))


def pack(docs: DataFrame, tokenizer: str, window: int = 1024, end_id: int = 0) -> DataFrame:
    """Pieces of documents in sequences of ``window`` tokens; only the last sequence is shorter.

    Columns: doc_id, start (ids of its document before the piece), length, ids (binary,
    little-endian, 32 bits each), doc_tokens, sequence_id, offset (place in the sequence).  A null or
    empty text is the one id ``end_id``; every row is a document, repeated or not; an empty table
    gives no pieces.  Other columns are not carried.  The table of bases that is broadcast has a row
    for each input partition, whatever the number of documents.
    """
    tokens = tokenised(docs, tokenizer, end_id)
    placed = tokens.join(F.broadcast(part_bases(tokens, "doc_tokens")), "part") \
        .select("doc_id", "doc_tokens", (F.col("base") + F.col("part_start")).alias("at"), "ids")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "ids"):
            sizes = batch.column("doc_tokens").to_numpy()
            first = batch.column("at").to_numpy()
            pieces = (first + sizes - 1) // window - first // window + 1
            row = np.repeat(np.arange(len(sizes)), pieces)
            nth = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            sequence = first[row] // window + nth
            begin = np.maximum(first[row], sequence * window)
            stop = np.minimum((first + sizes)[row], (sequence + 1) * window)
            raw = batch.column("ids").to_pylist()
            wide = [np.frombuffer(x, f"<u{len(x) // n}").astype("<u4") for x, n in zip(raw, sizes)]
            out = [wide[r][a:b].tobytes() for r, a, b in zip(row, begin - first[row], stop - first[row])]
            for at in range(0, len(out), 4096):  # bounded output batches
                s = slice(at, at + 4096)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").take(pa.array(row[s])), pa.array((begin - first[row])[s]),
                     pa.array((stop - begin)[s]), pa.array(out[s], pa.binary()), pa.array(sizes[row][s]),
                     pa.array(sequence[s]), pa.array((begin - sequence * window)[s])],
                    ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"])

    longs = ["doc_tokens", "sequence_id", "offset"]
    schema = T.StructType([docs.schema["doc_id"], T.StructField("start", T.LongType()),
                           T.StructField("length", T.LongType()), T.StructField("ids", T.BinaryType()),
                           *[T.StructField(c, T.LongType()) for c in longs]])
    return placed.mapInArrow(cut, schema)


def sequences(pieces: DataFrame) -> DataFrame:
    """(sequence_id, length, ids): pieces put together; a sequence has at most ``window`` of them."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return pieces.groupBy("sequence_id").agg(F.sum("length").alias("length"), parts.alias("_p")) \
        .select("sequence_id", "length",
                F.aggregate("_p", F.lit(b"").cast("binary"), lambda a, p: F.concat(a, p["ids"])).alias("ids"))
