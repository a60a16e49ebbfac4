"""Training-order materialisation of token sequences as fixed-stride binary shards.

Sequences are numbered 0..N-1 by prefix sums over stored partitions; a keyed Feistel permutation of
the smallest even number of bits that holds N, walked along its cycle until it falls below N, gives
each sequence its slot in the training order.  Slots are dense and even, so ranges of slots are equal
partitions without sampling; every range writes its shards in order.  A reader that knows the slot
it stopped at continues from that shard and byte.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .arrow import slices, worker_cache
from .packing import part_bases
from .store import stored
from .tokenids import BATCH_BYTES, PieceEncoder

ROUNDS = 6
#: Bytes of payload that one range of slots (one task) writes.
RANGE_BYTES = 32 << 20


def _round(half: np.ndarray, key: int, nth: int, mask: np.uint64) -> np.ndarray:
    x = half + np.uint64((key * 0x9E3779B97F4A7C15 + nth * 0xD1B54A32D192ED03) % (1 << 64))
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xA0761D6478BD642F)
    return (x ^ (x >> np.uint64(32))) & mask


def permute(index: np.ndarray, total: int, key: int, back: bool = False) -> np.ndarray:
    """Slots of the sequences 0..total-1 (``back``: sequences of slots), a bijection of that range."""
    half = max(1, (max(total - 1, 1).bit_length() + 1) // 2)
    width, mask = np.uint64(half), np.uint64((1 << half) - 1)
    order = range(ROUNDS - 1, -1, -1) if back else range(ROUNDS)

    def once(x: np.ndarray) -> np.ndarray:
        left, right = x >> width, x & mask
        for nth in order:
            if back:
                left, right = right ^ _round(left, key, nth, mask), left
            else:
                left, right = right, left ^ _round(right, key, nth, mask)
        return left << width | right

    out = once(np.asarray(index).astype(np.uint64))
    while (far := out >= np.uint64(total)).any():
        out[far] = once(out[far])
    return out.astype(np.int64)


def token_sequences(docs: DataFrame, tokenizer: str, length: int, end_id: int) -> DataFrame:
    """(part, row, doc_id, nth, n_tokens, ids): documents cut into sequences, stored.

    A document is its text's ids and ``end_id``; its sequences have ``length`` ids, the last has the
    rest.  ``row`` numbers the sequences of a partition from 0.
    """
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = worker_cache(f"pieces-{tokenizer}", lambda: PieceEncoder(tokenizer))
        width = encoder.kind.itemsize
        end = np.array([end_id], encoder.kind).tobytes()
        part, row = TaskContext.get().partitionId(), 0
        for batch in slices(batches, budget=BATCH_BYTES):
            ids = [x + end for x in encoder.encode(batch.column("text"))]
            cuts = [range(0, len(x), length * width) for x in ids]
            flat = [x[a:a + length * width] for x, some in zip(ids, cuts) for a in some]
            source = np.repeat(np.arange(len(ids)), [len(some) for some in cuts])
            nth = np.concatenate([np.arange(len(some)) for some in cuts]) if ids else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(flat), part)), pa.array(np.arange(row, row + len(flat))),
                 batch.column("doc_id").take(pa.array(source)), pa.array(nth.astype(np.int64)),
                 pa.array(np.array([len(x) // width for x in flat], np.int64)), pa.array(flat, pa.binary())],
                ["part", "row", "doc_id", "nth", "n_tokens", "ids"])
            row += len(flat)

    longs = {c: T.StructField(c, T.LongType()) for c in ("part", "row", "nth", "n_tokens")}
    schema = T.StructType([longs["part"], longs["row"], docs.schema["doc_id"], longs["nth"], longs["n_tokens"],
                           T.StructField("ids", T.BinaryType())])
    return stored(docs.select("doc_id", "text").mapInArrow(encode, schema), "sequences")


def shards(sequences: DataFrame, length: int, key: int, per_shard: int, pad_id: int, token_bytes: int) -> DataFrame:
    """(shard, first_slot, n_sequences, payload, doc_ids, nths, n_tokens): one row per shard.

    ``payload``: the shard's sequences in slot order, each padded to ``length`` little-endian ids of
    ``token_bytes`` bytes, so slot s stands at byte (s mod per_shard) * length * token_bytes.
    ``doc_ids``, ``nths`` and ``n_tokens`` say, slot by slot, whose tokens they are and how many.
    ``sequences`` must be a stored table (it is read twice).  An empty table gives no shards.
    """
    stride = length * token_bytes
    rows = sequences.groupBy("part").agg(F.count(F.lit(1)).alias("rows"))
    total = rows.agg(F.coalesce(F.sum("rows"), F.lit(0))).first()[0]
    n_shards = -(-total // per_shard)
    ranges = max(1, min(n_shards, -(-total * stride // RANGE_BYTES)))
    per_range = max(1, -(-n_shards // ranges))
    bases = part_bases(rows.withColumnRenamed("rows", "_rows"), "_rows")
    kind = f"<u{token_bytes}"

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            slot = permute(batch.column("at").to_numpy(), total, key)
            yield pa.RecordBatch.from_arrays([pa.array(slot), *batch.columns[1:]], ["slot", *batch.schema.names[1:]])

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[tuple] = []
        ids: list[pa.DataType] = []

        def shard() -> pa.RecordBatch:
            first = waiting[0][0]
            if first % per_shard or [x[0] for x in waiting] != list(range(first, first + len(waiting))):
                raise ValueError(f"slots of the shard from {first} are not dense")
            filler = np.array([pad_id], kind).tobytes()
            payload = b"".join(x[4] + filler * (length - x[3]) for x in waiting)
            return pa.RecordBatch.from_arrays(
                [pa.array([first // per_shard]), pa.array([first]), pa.array([len(waiting)]),
                 pa.array([payload], pa.binary()), *[pa.array([[x[k] for x in waiting]], pa.list_(t)) for k, t in ((1, ids[0]), (2, pa.int64()), (3, pa.int64()))]],
                ["shard", "first_slot", "n_sequences", "payload", "doc_ids", "nths", "n_tokens"])

        for batch in slices(batches, "ids"):
            ids[:] = [batch.column("doc_id").type]
            for row in zip(*[batch.column(c).to_pylist() for c in ("slot", "doc_id", "nth", "n_tokens", "ids")]):
                if waiting and waiting[0][0] // per_shard != row[0] // per_shard:
                    yield shard()
                    waiting.clear()
                waiting.append(row)
        if waiting:
            yield shard()

    columns = ["doc_id", "nth", "n_tokens", "ids"]
    placed = sequences.join(F.broadcast(bases), "part").select((F.col("base") + F.col("row")).alias("at"), *columns)
    numbered = placed.mapInArrow(number, T.StructType([T.StructField("slot", T.LongType()), *[placed.schema[c] for c in columns]]))
    home = F.floor(F.floor(F.col("slot") / per_shard) / per_range).cast("int")
    many = T.ArrayType(T.LongType())
    return numbered.repartitionById(ranges, home).sortWithinPartitions("slot").mapInArrow(write, T.StructType(
        [T.StructField("shard", T.LongType()), T.StructField("first_slot", T.LongType()),
         T.StructField("n_sequences", T.LongType()), T.StructField("payload", T.BinaryType()),
         T.StructField("doc_ids", T.ArrayType(placed.schema["doc_id"].dataType)), T.StructField("nths", many), T.StructField("n_tokens", many)]))


def materialise_order(docs: DataFrame, tokenizer: str, length: int = 512, key: int = 20_240_229,
                      per_shard: int = 256, end_id: int = 50_256) -> DataFrame:
    """Shards of all documents in training order (see ``shards``), padded with ``end_id``.

    A null or empty text is one sequence with the one id ``end_id``; every row is a document,
    repeated or not.  A doc_id of any type, or null, is carried along; other columns are not.
    """
    cut = token_sequences(docs, tokenizer, length, end_id)
    from tokenizers import Tokenizer
    wide = Tokenizer.from_file(tokenizer).get_vocab_size(True) > 1 << 16
    return shards(cut, length, key, per_shard, end_id, 4 if wide else 2)


def write_shards(table: DataFrame, path: str) -> None:
    """Shards as Parquet files, each a range of slots in order."""
    table.write.parquet(path)


def read_slots(spark: SparkSession, path: str, first: int, count: int, length: int, per_shard: int,
               token_bytes: int = 2) -> list[np.ndarray]:
    """Sequences of the slots from ``first`` on, as a training job resumes; reads their shards only."""
    last = first + count
    rows = spark.read.parquet(path).where(
        F.col("shard").between(first // per_shard, (last - 1) // per_shard)).orderBy("shard") \
        .select("first_slot", "n_sequences", "payload").toLocalIterator()
    out: list[np.ndarray] = []
    for row in rows:
        table = np.frombuffer(row["payload"], f"<u{token_bytes}").reshape(row["n_sequences"], length)
        a = max(first - row["first_slot"], 0)
        out += list(table[a:last - row["first_slot"]])
    return out
