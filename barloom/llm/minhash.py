"""Near-duplicate documents by circulant MinHash, banding and exact verification.

One permutation scatters a document's shingles over 2**32 places; a second one, shifted by one place
for each coordinate, gives all coordinates of the signature (C-MinHash).  Bands of coordinates put
documents into buckets.  Documents with the same shingle set are one class from the start, so copies
are never compared.

Of each bucket, first every class is compared with the bucket's least one, its hub; what is linked
there becomes one component.  Then, for hubs whose buckets still hold several components, every class
outside the largest is compared with all of them, in blocks: a task gets two blocks of classes with
their sets, counts what each pair shares as a product of two matrices, and returns only links that
join components.  So each pair that shares a bucket is either compared on the full sets or already
joined by links; pairs are never written out, and no task holds more than two blocks.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .arrow import segment_ids, slices, utf8
from .components import components
from .store import stored
from .wordhash import hashed_words, mix, shingles

#: Coordinates per band and bands: a pair of similarity 0.75 shares no bucket once in 750,000 times.
ROWS, BANDS = 5, 50
BLOCK = 1 << 15
#: Most classes, and about the most shingles, of a block that is compared with another.
BLOCK_CLASSES, BLOCK_SHINGLES = 256, 400_000


def _permute(x: np.ndarray, spare: np.ndarray, factors: tuple[int, int]) -> None:
    """A bijection of 32-bit integers, in place."""
    for shift, factor in zip((16, 15), factors):
        np.right_shift(x, np.uint32(shift), out=spare)
        np.bitwise_xor(x, spare, out=x)
        np.multiply(x, np.uint32(factor), out=x)
    np.right_shift(x, np.uint32(16), out=spare)
    np.bitwise_xor(x, spare, out=x)


def signatures(places: np.ndarray, sizes: np.ndarray, n: int) -> np.ndarray:
    """(n, documents): coordinate k is the least value of the second permutation, shifted by k, over
    the document's places; ``places`` are the documents' shingles in a row, ``sizes`` all positive."""
    first = places.copy()
    _permute(first, np.empty_like(first), (0x7FEB352D, 0x846CA68B))
    out = np.full((n, len(sizes)), 0xFFFFFFFF, np.uint32)
    owner = segment_ids(sizes)
    for at in range(0, len(first), BLOCK):
        block, own = first[at:at + BLOCK], owner[at:at + BLOCK]
        starts = np.flatnonzero(np.diff(own, prepend=-1))
        docs = own[starts]
        value, spare = np.empty_like(block), np.empty_like(block)
        for k in range(n):
            np.subtract(block, np.uint32(k), out=value)
            _permute(value, spare, (0x21F0AAAD, 0x735A2D97))
            out[k, docs] = np.minimum(out[k, docs], np.minimum.reduceat(value, starts))
    return out


def _sets(texts: list[bytes], width: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(index of the first text, set sizes, the sets' hashes in a row, each set sorted)."""
    for first, counts, words in hashed_words(texts):
        n, hashes = shingles(counts, words, width, short=True)
        owner = segment_ids(n)
        for part in np.split(hashes, np.cumsum(n)[:-1]):
            part.sort()
        new = np.ones(len(hashes), bool)
        new[1:] = (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])
        yield first, np.bincount(owner[new], minlength=len(n)), hashes[new]


def _ints(values: np.ndarray) -> np.ndarray:
    return values.view(np.int64)


def signed(docs: DataFrame, width: int) -> DataFrame:
    """(doc_id, n_shingles, set_a, set_b, buckets): stored; set_a and set_b tell sets apart (128 bits)."""
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            for first, sizes, hashes in _sets(utf8(batch.column("text")), width):
                full = np.flatnonzero(sizes)
                keys = np.zeros((3, len(sizes)), np.uint64)
                offsets = np.zeros(len(sizes) + 1, np.int32)
                offsets[1:] = np.cumsum(np.where(sizes > 0, BANDS, 0))
                buckets = np.zeros(0, np.uint64)
                if len(full):
                    starts = (np.cumsum(sizes) - sizes)[full]
                    for nth, salt in enumerate((0x5851F42D4C957F2D, 0x14057B7EF767814F)):
                        keys[nth, full] = np.add.reduceat(mix(hashes * np.uint64(salt)), starts)
                    table = signatures((hashes >> np.uint64(32)).astype(np.uint32), sizes[full], ROWS * BANDS)
                    rows = table.astype(np.uint64).reshape(BANDS, ROWS, len(full))
                    value = np.arange(1, BANDS + 1, dtype=np.uint64)[:, None] * np.uint64(0x9E3779B97F4A7C15)
                    for r in range(ROWS):
                        value = mix(value ^ rows[:, r])
                    buckets = np.ascontiguousarray(value.T).reshape(-1)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(first, len(sizes)), pa.array(sizes.astype(np.int64)),
                     pa.array(_ints(keys[0])), pa.array(_ints(keys[1])),
                     pa.ListArray.from_arrays(pa.array(offsets), pa.array(_ints(buckets)))], names)

    names = ["doc_id", "n_shingles", "set_a", "set_b", "buckets"]
    schema = T.StructType([docs.schema["doc_id"], *[T.StructField(c, T.LongType()) for c in names[1:4]],
                           T.StructField("buckets", T.ArrayType(T.LongType()))])
    return stored(docs.select("doc_id", "text").mapInArrow(sign, schema), "signatures")


def shingle_sets(docs: DataFrame, width: int) -> DataFrame:
    """(doc_id, shingles): the full set as sorted 64-bit hashes."""
    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            for first, sizes, hashes in _sets(utf8(batch.column("text")), width):
                parts = np.split(hashes, np.cumsum(sizes)[:-1])
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(first, len(sizes)),
                                                  pa.array([p.tobytes() for p in parts], pa.binary())], ["doc_id", "shingles"])

    return docs.select("doc_id", "text").mapInArrow(
        gather, T.StructType([docs.schema["doc_id"], T.StructField("shingles", T.BinaryType())]))


def linked(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) with 100 * intersection >= percent * union, on the full sets."""
    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("x"), batch.column("y")):
                p, q = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = len(np.intersect1d(p, q, assume_unique=True))
                keep.append(100 * both >= percent * (len(p) + len(q) - both))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    with_a = pairs.join(sets.select(F.col("doc_id").alias("a"), F.col("shingles").alias("x")), "a")
    both = with_a.join(sets.select(F.col("doc_id").alias("b"), F.col("shingles").alias("y")), "b")
    return both.select("a", "b", "x", "y").mapInArrow(verify, pairs.select("a", "b").schema)


def _joining(table: pa.Table, percent: int) -> list[tuple[int, int]]:
    """Links between the two sides of a block pair, as many as join different components."""
    side = table.column("side").to_numpy()
    reps, own = table.column("rep").to_numpy(), table.column("own").to_numpy()
    sets = [np.frombuffer(x, np.uint64) for x in table.column("shingles").to_pylist()]
    sizes = np.array([len(x) for x in sets])
    left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
    _, column, holders = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    row = segment_ids(sizes)
    common = holders[column] > 1
    new = np.cumsum(holders > 1) - 1
    row, column = row[common], new[column[common]]
    shared = np.zeros((len(left), len(right)), np.float32)
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    for low in range(0, int(column[-1]) + 1 if len(column) else 0, 4096):
        a, b = np.searchsorted(column, (low, low + 4096))
        part = np.zeros((len(sets), min(4096, int(column[b - 1]) - low + 1)), np.float32)
        part[row[a:b], column[a:b] - low] = 1
        shared += part[left] @ part[right].T
    union = sizes[left][:, None] + sizes[right][None, :] - shared
    linked = (100 * shared >= percent * union) & (own[left][:, None] != own[right][None, :])
    name = {int(x): int(x) for x in own}

    def root(x: int) -> int:
        while name[x] != x:
            name[x] = x = name[name[x]]
        return x

    out = []
    for i, j in zip(*np.nonzero(linked)):
        x, y = root(int(own[left[i]])), root(int(own[right[j]]))
        if x != y:
            name[max(x, y)] = min(x, y)
            out.append((int(reps[left[i]]), int(reps[right[j]])))
    return out


def _across(shared: DataFrame, found: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) between components that meet in the buckets of a hub."""
    members = shared.join(found, shared["rep"] == found["node"], "left") \
        .select("hub", "rep", "rep_n", F.coalesce("component", "rep").alias("own"))
    largest = members.groupBy("hub", "own").agg(F.count(F.lit(1)).alias("n")).groupBy("hub").agg(
        F.max(F.struct("n", "own"))["own"].alias("top"), F.count(F.lit(1)).alias("parts")) \
        .where(F.col("parts") > 1).select("hub", "top")
    # sets that may be similar have sizes in the same class or in neighbouring ones
    sized = F.floor(F.log("rep_n") / math.log(100 / percent)).cast("int")
    rows = stored(members.join(largest, "hub").withColumn("size", sized), "open-hubs")
    inside = rows.select("hub", "size", "rep", "rep_n", "own")
    outside = rows.where(F.col("own") != F.col("top")).select(
        "hub", F.explode(F.array(F.col("size") - 1, F.col("size"), F.col("size") + 1)).alias("size"), "rep", "rep_n", "own")

    def blocks(side: DataFrame, out: str) -> DataFrame:
        return side.groupBy("hub", "size").agg(F.greatest(
            F.ceil(F.count(F.lit(1)) / BLOCK_CLASSES), F.ceil(F.sum("rep_n") / BLOCK_SHINGLES)).cast("int").alias(out))

    plan = blocks(inside, "ins").join(blocks(outside, "outs"), ["hub", "size"])
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    home = lambda n: F.pmod(F.xxhash64("rep"), F.col(n)).cast("int")
    key = ["hub", "size", "i", "j"]
    left = outside.join(plan, ["hub", "size"]).select("hub", "size", home("outs").alias("i"), every("ins").alias("j"), "rep", "own",
                                                      F.lit(0).alias("side"))
    right = inside.join(plan, ["hub", "size"]).select("hub", "size", every("outs").alias("i"), home("ins").alias("j"), "rep", "own",
                                                      F.lit(1).alias("side"))
    full = left.unionByName(right).join(sets.withColumnRenamed("doc_id", "rep"), "rep")

    def compare(table: pa.Table) -> pa.Table:
        links = _joining(table, percent)
        return pa.table({"a": pa.array([x for x, _ in links], pa.int64()), "b": pa.array([y for _, y in links], pa.int64())})

    return full.groupBy(*key).applyInArrow(compare, "a long, b long")


def _pairs(left: str, right: str, percent: int) -> list:
    """Columns a < b of two classes whose sizes allow the similarity."""
    small, large = F.least(f"{left}_n", f"{right}_n"), F.greatest(f"{left}_n", f"{right}_n")
    return [F.least(left, right).alias("a"), F.greatest(left, right).alias("b"), 100 * small >= percent * large]


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 75) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every document with a doc_id.

    Texts are lower-cased (A-Z) and split at ASCII white space; a set holds the distinct shingles of
    ``width`` words, or the whole sequence where there are fewer.  Documents without words, null or
    empty, have no shingles and are linked with nothing.  A component's name is its least doc_id, and
    that document is kept.  Rows that repeat a doc_id each get the component of their own set.  A row
    without a doc_id is a component of its own, without a name, and is kept.  Ids that are no integers
    are numbered in their order first.  Other columns play no part; an empty table gives an empty table.
    """
    if not isinstance(docs.schema["doc_id"].dataType, T.IntegralType):
        return _by_number(docs.select("doc_id", "text"), width, percent)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    base = rows.where(F.col("doc_id").isNotNull())
    marks = signed(rows, width)
    full = marks.where((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull())
    classes = stored(full.groupBy("set_a", "set_b").agg(F.min("doc_id").alias("rep")), "classes")
    heads = full.join(classes.select(F.col("rep").alias("doc_id"), "set_a", "set_b"), ["doc_id", "set_a", "set_b"], "left_semi")
    placed = heads.select(F.col("doc_id").alias("rep"), F.col("n_shingles").alias("rep_n"), F.explode("buckets").alias("bucket"))
    hubs = placed.groupBy("bucket").agg(F.min(F.struct("rep", "rep_n")).alias("h"), F.count(F.lit(1)).alias("n")) \
        .where(F.col("n") > 1).select("bucket", F.col("h.rep").alias("hub"), F.col("h.rep_n").alias("hub_n"))
    shared = stored(placed.join(hubs, "bucket").select("hub", "hub_n", "rep", "rep_n").distinct(), "hub-members")

    wanted = shared.select(F.col("rep").alias("doc_id")).distinct()
    sets = stored(shingle_sets(base.join(wanted, "doc_id", "left_semi"), width), "shingle-sets")

    a, b, fits = _pairs("hub", "rep", percent)
    tried = stored(shared.where((F.col("hub") != F.col("rep")) & fits).select(a, b), "hub-pairs")
    links = stored(linked(tried, sets, percent), "links")
    found = components(links)

    found = components(links.unionByName(_across(shared, found, sets, percent)))

    named = classes.join(found, classes["rep"] == found["node"], "left") \
        .select("set_a", "set_b", F.coalesce("component", "rep").alias("component_id"))
    out = marks.join(named, ["set_a", "set_b"], "left").select(
        "doc_id", "n_shingles",
        F.when((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull(), F.col("component_id"))
        .otherwise(F.col("doc_id")).alias("component_id"))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def _by_number(docs: DataFrame, width: int, percent: int) -> DataFrame:
    """``near_duplicates`` over whole numbers that stand for the ids, in the order of the ids."""
    ids = docs.select("doc_id").where(F.col("doc_id").isNotNull()).distinct().orderBy("doc_id")
    numbers = stored(ids.select(F.col("doc_id").alias("id"), F.monotonically_increasing_id().alias("number")), "numbers")
    told = docs.join(numbers, F.col("doc_id") == F.col("id"), "left").select(F.col("number").alias("doc_id"), "text")
    out = near_duplicates(told, width, percent).withColumnRenamed("doc_id", "row")
    name = lambda column, alias: numbers.select(F.col("number").alias(column), F.col("id").alias(alias))
    return out.join(name("row", "doc_id"), "row", "left") \
        .join(name("component_id", "component"), "component_id", "left") \
        .select("doc_id", "n_shingles", F.col("component").alias("component_id"), "kept")
