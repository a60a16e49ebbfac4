"""Product codes of vectors: codebooks by k-means per part, distances over a trie of distinct parts.

A vector of integers is cut into equal parts, and each part position has a codebook.  The distinct
parts of a block, in lexicographic order, are the leaves of a trie whose levels are the dimensions of
a part.  A node holds the squared distances of its prefix to all entries; a child adds one dimension
to its parent's, so what parts share at their beginning is summed once.  The trie is walked in
depth-first order, some thousand leaves at a time; leaves take the nearest entry, and their parts,
times how often they occur, go to that entry's sums.

Vectors stay where they lie: a round moves only the sums of each task.  The codebook (entries times
dimensions) is the one thing the driver holds.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .store import stored

#: Leaves of the trie that are walked at a time, and vectors whose parts make one trie.
LEAVES = 4096
BLOCK = 1 << 15
#: Integers beyond it could overflow a sum of squares.
LARGEST = 1 << 26


def kept_vectors(vectors: DataFrame, scale: int = 256) -> DataFrame:
    """(vec_id, label, v): the vectors whose components are all known and finite, as integers floor(scale * x).

    A component whose integer is beyond ``LARGEST`` ends in an error instead of a wrong distance.
    """
    x = F.col("embedding")
    finite = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))
    whole = lambda c: F.floor(c.cast("double") * scale)
    safe = F.forall(F.col("v"), lambda c: F.abs(c) <= LARGEST)
    return vectors.where(x.isNotNull() & F.forall(x, finite)) \
        .select("vec_id", "label", F.transform(x, whole).alias("v")) \
        .withColumn("v", F.when(F.assert_true(safe, F.lit("a component is too large for exact distances")).isNull(), F.col("v")))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """The rows' components; shorter rows end in zeros."""
    sizes = np.diff(np.asarray(column.offsets))
    flat = np.asarray(column.flatten()).astype(np.int64)
    if (sizes == width).all():
        return flat.reshape(len(sizes), width)
    out = np.zeros((len(sizes), width), np.int64)
    out[np.arange(width) < sizes[:, None]] = flat
    return out


def distinct_parts(parts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(distinct rows in lexicographic order, how often each occurs, which one each row is)."""
    if not parts.shape[1]:
        return parts[:1], np.array([len(parts)]), np.zeros(len(parts), np.int64)
    order = np.lexsort(parts.T[::-1])
    ranked = parts[order]
    new = np.ones(len(ranked), bool)
    new[1:] = (ranked[1:] != ranked[:-1]).any(1)
    nth = np.empty(len(parts), np.int64)
    nth[order] = np.cumsum(new) - 1
    return ranked[new], np.diff(np.append(np.flatnonzero(new), len(ranked))), nth


def nearest(leaves: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(entry, squared distance) nearest to each of the distinct parts in lexicographic order; ties
    go to the lower entry.

    ``leaves`` are walked in order.  At each level every distinct prefix of the walked leaves is one
    node: it takes its parent's distances and adds those of its own component.
    """
    entry, least = np.empty(len(leaves), np.int64), np.empty(len(leaves), np.int64)
    for low in range(0, len(leaves), LEAVES):
        some = leaves[low:low + LEAVES]
        node = np.zeros(len(some), np.int64)  # the node above each leaf at this level
        sums = np.zeros((1, len(book)), np.int64)
        opens = np.zeros(len(some), bool)  # whether the leaf's prefix differs from that of the leaf before
        opens[0] = True
        for d in range(leaves.shape[1]):
            opens[1:] |= some[1:, d] != some[:-1, d]
            first = np.flatnonzero(opens)
            gap = some[first, d][:, None] - book[:, d]
            gap *= gap
            gap += sums[node[first]]
            node, sums = np.cumsum(opens) - 1, gap
        best = sums.argmin(1)
        entry[low:low + LEAVES] = best[node]
        least[low:low + LEAVES] = sums[np.arange(len(best)), best][node]
    return entry, least


class Codebooks:
    """Entries by part position, all of integers: an array (parts, entries, width of a part)."""

    def __init__(self, entries: np.ndarray):
        self.entries = entries

    @property
    def width(self) -> int:
        return self.entries.shape[0] * self.entries.shape[2]

    def sha256(self) -> str:
        return hashlib.sha256(",".join(map(str, self.entries.reshape(-1).tolist())).encode()).hexdigest()

    def _parts(self, matrix: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        size = self.entries.shape[2]
        for p in range(len(self.entries)):
            yield p, matrix[:, p * size:(p + 1) * size]

    def sums(self, matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(counts, sums) of the parts that each entry is nearest to."""
        counts, totals = np.zeros(self.entries.shape[:2], np.int64), np.zeros(self.entries.shape, np.int64)
        for p, parts in self._parts(matrix):
            leaves, often, _ = distinct_parts(parts)
            entry, _ = nearest(leaves, self.entries[p])
            np.add.at(counts[p], entry, often)
            np.add.at(totals[p], entry, leaves * often[:, None])
        return counts, totals

    def encode(self, matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(entries by row and part, sum of the squared distances by row)."""
        codes, error = np.zeros((len(matrix), len(self.entries)), np.int64), np.zeros(len(matrix), np.int64)
        for p, parts in self._parts(matrix):
            leaves, _, nth = distinct_parts(parts)
            entry, least = nearest(leaves, self.entries[p])
            codes[:, p] = entry[nth]
            error += least[nth]
        return codes, error


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows in blocks of ``BLOCK``, so that a trie has many parts to share prefixes."""
    held: list[pa.RecordBatch] = []
    n = 0
    for batch in batches:
        held.append(batch)
        n += len(batch)
        if n >= BLOCK:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held, n = [], 0
    if n:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def first_codebooks(kept: DataFrame, parts: int, entries: int) -> Codebooks | None:
    """The parts of the rows with the smallest ids (ties by the vector); None without rows.

    Vectors that are shorter than the longest one, or whose length the parts do not divide, end in zeros.
    """
    longest = kept.agg(F.max(F.size("v"))).first()[0]
    if longest is None:
        return None
    size = -(-longest // parts)
    rows = kept.select("vec_id", "v").orderBy(F.col("vec_id").asc_nulls_last(), "v").limit(entries).collect()
    start = np.zeros((len(rows), parts * size), np.int64)
    for i, row in enumerate(rows):
        start[i, :len(row["v"])] = row["v"]
    return Codebooks(start.reshape(len(rows), parts, size).swapaxes(0, 1).copy())


def refined(kept: DataFrame, books: Codebooks) -> Codebooks:
    """One round: every part to its nearest entry, then every used entry to the floor of its parts' mean."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, totals = np.zeros(shape[:2], np.int64), np.zeros(shape, np.int64)
        for block in _blocks(batches):
            more = books.sums(_matrix(block.column("v"), books.width))
            counts += more[0]
            totals += more[1]
        used = np.argwhere(counts > 0)
        yield pa.RecordBatch.from_arrays(
            [pa.array(used[:, 0], pa.int64()), pa.array(used[:, 1], pa.int64()), pa.array(counts[used[:, 0], used[:, 1]], pa.int64()),
             pa.array(totals[used[:, 0], used[:, 1]].tolist(), pa.list_(pa.int64()))], ["part", "entry", "n", "total"])

    shape = books.entries.shape
    sums = kept.select("v").mapInArrow(run, "part long, entry long, n long, total array<long>").groupBy("part", "entry").agg(
        F.sum("n").alias("n"), *[F.sum(F.element_at("total", d + 1)).alias(f"d{d}") for d in range(shape[2])])
    out = books.entries.copy()
    for row in sums.collect():  # at most one row for each entry
        out[row["part"], row["entry"]] = [row[f"d{d}"] // row["n"] for d in range(shape[2])]
    return Codebooks(out)


def encoded(kept: DataFrame, books: Codebooks) -> DataFrame:
    """(vec_id, label, code, error): two hex digits for each part's entry, squared distance of all parts."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _blocks(batches):
            codes, error = books.encode(_matrix(block.column("v"), books.width))
            digits = codes.astype(np.uint8).tobytes().hex()
            n = 2 * codes.shape[1]
            yield pa.RecordBatch.from_arrays(
                [block.column("vec_id"), block.column("label"), pa.array([digits[i:i + n] for i in range(0, len(digits), n)], pa.string()),
                 pa.array(error, pa.int64())], ["vec_id", "label", "code", "error"])

    return kept.mapInArrow(run, T.StructType([kept.schema["vec_id"], kept.schema["label"],
                                              T.StructField("code", T.StringType()), T.StructField("error", T.LongType())]))


def compress(vectors: DataFrame, parts: int = 16, entries: int = 64, rounds: int = 2, scale: int = 256) -> DataFrame:
    """(vec_id, label, code, error, label_error, codebooks_sha256) of every kept vector.

    ``vectors`` has vec_id, embedding and label; other columns are ignored.  A null vector and one with
    a null, NaN or infinite component are dropped.  A codebook starts as the parts of the ``entries``
    smallest ids (fewer rows: fewer entries); equal ids are ordered by their vectors, null ids come
    last, and every row counts, repeated or not.  Vectors shorter than the longest one end in zeros, as
    does a length that ``parts`` does not divide.  ``label_error`` sums over equal labels, null being
    one.  No rows give no rows.
    """
    if entries > 256:
        raise ValueError("a code has two hex digits for a part")
    kept = stored(kept_vectors(vectors, scale), "vectors")
    books = first_codebooks(kept, parts, entries)
    if books is None:
        books = Codebooks(np.zeros((parts, 0, 0), np.int64))
    else:
        for _ in range(rounds):
            books = refined(kept, books)
    out = stored(encoded(kept, books), "vector-codes")
    by_label = out.groupBy("label").agg(F.sum("error").alias("label_error")).withColumnRenamed("label", "_label")
    return out.join(by_label, out["label"].eqNullSafe(by_label["_label"])) \
        .select("vec_id", "label", "code", "error", "label_error", F.lit(books.sha256()).alias("codebooks_sha256"))
