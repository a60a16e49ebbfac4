"""Benchmark decontamination: SimHash of item-sized windows, multi-index Hamming search, exact similarity.

Every window of as many words as an item has gets a 64-bit SimHash of its distinct 5-word shingles,
from running sums of their weighted signs.  Four blocks of 16 bits index the items: fingerprints
within the radius agree in one block at least within that block's share of it, so nothing within the
radius is passed over.  What is within it is compared exactly, by the weighted similarity of shingles.

The radius follows from the threshold: sets of similarity t lie at an angle of acos(2t / (1 + t)), a
bit differs with this angle over pi, and the radius is where the binomial tail falls below ``MISS``.
For 0.75 that is 23 of 64 bits.  Windows that cannot reach the threshold, since too little of them is
in any item of their size, are left out before; that bound is exact.

Benchmark items are a stated query set: they are taken in blocks of ``BLOCK_ITEMS``, and each block's
index goes to the tasks with the function, so what is shipped has a bound whatever their number.
Documents are read where they lie; nothing is shuffled.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .arrow import slices, utf8, worker_cache
from .wordhash import NOT_ALNUM, hashed_words, shingles

BLOCK_ITEMS = 1000
WIDTH = 5
#: Chance that a window at the threshold lies beyond the radius.
MISS = 1e-4
BITS, BLOCK_BITS = 64, 16
#: Windows that are compared at a time, and places whose running sums are held at a time.
WINDOWS = 1 << 16
PLACES = 1 << 15
#: Sums differ by their order of summing; what is this near the threshold meets it.
EQUAL = 1e-9


def radius_of(threshold: float, miss: float = MISS, bits: int = BITS) -> int:
    """Differing bits that two sets of this similarity exceed with a chance of at most ``miss``."""
    p = math.acos(2 * threshold / (1 + threshold)) / math.pi
    tail = 1.0
    for r in range(bits + 1):
        tail -= math.comb(bits, r) * p ** r * (1 - p) ** (bits - r)
        if tail <= miss:
            return r
    return bits


def _signed(hashes: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """For each hash and bit the weight, negative where the bit is not set."""
    bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1).astype(np.int32)
    return (2 * bits - 1) * weights[:, None]


def _packed(sums: np.ndarray) -> np.ndarray:
    """Fingerprints of sums, as (windows, 4) blocks of 16 bits."""
    return np.packbits(sums > 0, axis=1).view(np.uint16).reshape(-1, BITS // BLOCK_BITS)


def _running(signed: np.ndarray) -> np.ndarray:
    """Running sums, so that a window's sums are the difference of two rows."""
    out = np.zeros((len(signed) + 1, BITS), np.int32)
    np.cumsum(signed, axis=0, out=out[1:])
    return out


class HammingIndex:
    """Fingerprints within a radius of a given one, by blocks: if two differ in at most r bits, then of
    blocks with radii r_i, the sum of all r_i + 1 being r + 1, one differs in at most its r_i bits.

    For each block and value a bitmap says which entries are near; entries of one class (here items of
    one size) stand side by side, so that a search reads the bytes of its class only.
    """

    def __init__(self, prints: np.ndarray, classes: np.ndarray, radius: int):
        self.radius = radius
        blocks = prints.shape[1]
        self.order = np.argsort(classes, kind="stable")
        self.prints, ordered = prints[self.order], classes[self.order]
        self.range = {int(c): tuple(np.searchsorted(ordered, [c, c + 1]).tolist()) for c in np.unique(classes)}
        share, more = divmod(radius + 1, blocks)
        radii = [share + (i < more) - 1 for i in range(blocks)]
        weight = np.bitwise_count(np.arange(1 << BLOCK_BITS, dtype=np.uint16))
        self.near = np.zeros((blocks, 1 << BLOCK_BITS, (len(prints) + 7) // 8), np.uint8)
        for block, most in enumerate(radii):
            ball = np.flatnonzero(weight <= most).astype(np.uint16) if most >= 0 else np.zeros(0, np.uint16)
            for entry, value in enumerate(self.prints[:, block]):
                self.near[block, ball ^ value, entry >> 3] |= np.uint8(128 >> (entry & 7))

    def search(self, prints: np.ndarray, kind: int) -> tuple[np.ndarray, np.ndarray]:
        """(number of the fingerprint, entry) of all that are within the radius in class ``kind``."""
        low, high = self.range[kind]
        first = low >> 3
        some = self.near[0, prints[:, 0], first:(high + 7) >> 3]
        for block in range(1, prints.shape[1]):
            some = some | self.near[block, prints[:, block], first:(high + 7) >> 3]
        query, entry = np.nonzero(np.unpackbits(some, axis=1)[:, low - 8 * first:high - 8 * first])
        entry = entry + low
        apart = np.bitwise_count(prints[query] ^ self.prints[entry]).sum(axis=1, dtype=np.int64)
        keep = apart <= self.radius
        return query[keep], self.order[entry[keep]]


class ItemIndex:
    """Items of one block, by their shingles."""

    def __init__(self, texts: list[bytes], threshold: float, width: int):
        self.threshold, self.width = threshold, width
        sets: list[np.ndarray] = []
        lengths: list[int] = []
        for _, counts, words in hashed_words(texts, NOT_ALNUM):
            for own in np.split(words, np.cumsum(counts)[:-1]):
                sets.append(np.unique(shingles(np.array([len(own)]), own, width, short=False)[1]))
                lengths.append(len(own))
        self.sets, self.lengths = sets, lengths
        self.known, holders = np.unique(np.concatenate([*sets, np.zeros(0, np.uint64)]), return_counts=True)
        self.outside = 1.0 + float(np.log(max(len(texts), 1)))  # weight of a shingle that no item has
        self.weights = self.outside - np.log(holders)
        self.ids = [np.searchsorted(self.known, s) for s in sets]
        self.totals = np.array([float(self.weights[i].sum()) for i in self.ids])
        self.points = np.rint(16 * self.weights).astype(np.int32)  # whole numbers, so that equal sets have equal signs
        self.sizes = np.array(lengths, np.int64)
        some = np.flatnonzero(self.sizes >= width)
        prints = [_packed(_signed(sets[i], self.points[self.ids[i]]).sum(axis=0, keepdims=True)) for i in some]
        self.index = HammingIndex(np.concatenate([*prints, np.zeros((0, BITS // BLOCK_BITS), np.uint16)]), self.sizes[some],
                                  radius_of(threshold))
        self.numbers = some
        self.least = {n: float(self.totals[self.sizes == n].min()) for n in self.index.range}
        self.maybe = np.zeros(1 << 20, bool)
        self.maybe[(self.known >> np.uint64(44)).astype(np.int64)] = True

    def _similarity(self, item: int, window: np.ndarray) -> float:
        window = np.unique(window)
        own = self.sets[item]
        both = np.intersect1d(window, own, assume_unique=True)
        place = np.searchsorted(self.known, window)
        place[place == len(self.known)] = 0
        here = np.where(self.known[place] == window, self.weights[place], self.outside).sum()
        common = self.weights[np.searchsorted(self.known, both)].sum()
        return float(common / (here + self.totals[item] - common))

    def search(self, texts: list[bytes]) -> list[tuple[int, int, int, int, float]]:
        """(text, item, first word, words, similarity): the best window of each text and item."""
        out: list[tuple[int, int, int, int, float]] = []
        if not len(self.known):
            return out
        for first, counts, words in hashed_words(texts, NOT_ALNUM):
            n_shingles, hashes = shingles(counts, words, self.width, short=False)
            ends = np.cumsum(n_shingles)
            hit = np.flatnonzero(self.maybe[(hashes >> np.uint64(44)).astype(np.int64)])
            place = np.minimum(np.searchsorted(self.known, hashes[hit]), len(self.known) - 1)
            real = self.known[place] == hashes[hit]
            hit, place = hit[real], place[real]
            if not len(hit):
                continue
            text = np.searchsorted(ends, hit, side="right")
            weight = np.full(len(hashes), self.outside)
            weight[hit] = self.weights[place]
            for t, item in self._near(counts, n_shingles, hashes, weight, hit, text):
                begin = int(ends[t] - n_shingles[t])
                low, high = np.searchsorted(text, [t, t + 1])
                own = np.isin(place[low:high], self.ids[item], assume_unique=False)
                best = self._best(item, int(counts[t]), hashes[begin:ends[t]], weight[begin:ends[t]],
                                  hit[low:high][own] - begin)
                if best is not None:
                    out.append((first + t, item, *best))
        return sorted(out)

    def _windows(self, size: int, counts: np.ndarray, ends: np.ndarray, begins: np.ndarray, hit: np.ndarray,
                 text: np.ndarray, gained: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(first shingles of the windows of ``size`` words, texts a little shorter than that) of which
        enough is in items; ``gained`` sums the weights of the hits."""
        span, least = size - self.width + 1, (self.threshold - 2 * EQUAL) * self.least[size]
        most = gained[np.searchsorted(hit, np.minimum(hit + span, ends[text]))] - gained[:-1]
        low = np.maximum(np.maximum(np.concatenate([[0], hit[:-1] + 1]), hit - span + 1), begins[text])
        high = np.minimum(hit, ends[text] - span)
        some = (most >= least) & (low <= high)
        low, n = low[some], (high - low + 1)[some]
        starts = np.repeat(low, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        here = np.unique(text)
        here = here[(counts[here] < size) & (counts[here] >= self.threshold * span)]
        whole = gained[np.searchsorted(hit, ends[here])] - gained[np.searchsorted(hit, begins[here])]
        return starts, here[whole >= least]

    def _near(self, counts: np.ndarray, n_shingles: np.ndarray, hashes: np.ndarray, weight: np.ndarray,
              hit: np.ndarray, text: np.ndarray) -> list[tuple[int, int]]:
        """(text, item) where a window's fingerprint is within the radius of the item's."""
        ends = np.cumsum(n_shingles)
        begins = ends - n_shingles
        gained = np.concatenate([[0.0], np.cumsum(weight[hit])])
        points = np.rint(16 * weight).astype(np.int32)
        longest = int(self.sizes.max())
        pairs: set[tuple[int, int]] = set()
        wanted: dict[int, np.ndarray] = {}
        for size in self.least:
            starts, short = self._windows(size, counts, ends, begins, hit, text, gained)
            if len(starts):
                wanted[size] = starts
            for t in short.tolist():  # one window: the whole text
                own, first = np.unique(hashes[begins[t]:ends[t]], return_index=True)
                sums = _signed(own, points[begins[t] + first]).sum(axis=0, keepdims=True)
                pairs.update((t, int(self.numbers[i])) for i in self.index.search(_packed(sums), size)[1])
        for base in range(0, len(hashes), PLACES):
            parts = {size: x[slice(*np.searchsorted(x, [base, base + PLACES]))] - base for size, x in wanted.items()}
            parts = {size: x for size, x in parts.items() if len(x)}
            if not parts:
                continue
            top = min(PLACES + longest, len(hashes) - base)
            edge = np.zeros(top + 1, np.int64)
            for size, starts in parts.items():
                np.add.at(edge, starts, 1)
                np.add.at(edge, starts + size - self.width + 1, -1)
            inside = np.cumsum(edge[:-1]) > 0  # sums run over the places of windows only
            at = np.concatenate([[0], np.cumsum(inside)])
            places = base + np.flatnonzero(inside)
            own = hashes[places]
            signed = _signed(own, points[places])
            running = _running(signed)
            order = np.argsort(own, kind="stable")
            equal = np.flatnonzero(own[order[1:]] == own[order[:-1]])
            later, earlier = order[equal + 1], order[equal]
            for size, starts in parts.items():
                span, here = size - self.width + 1, at[starts]
                again = later - earlier < span
                twice = None
                if again.any():  # a shingle counts once: taken off where a window holds the one before it too
                    twice = np.zeros((len(own) + 1, BITS), np.int32)
                    np.add.at(twice, np.maximum(later[again] - span + 1, 0), signed[later[again]])
                    np.subtract.at(twice, earlier[again] + 1, signed[later[again]])
                    np.cumsum(twice, axis=0, out=twice)
                for a in range(0, len(here), WINDOWS):
                    some = here[a:a + WINDOWS]
                    sums = running[some + span] - running[some]
                    if twice is not None:
                        sums -= twice[some]
                    window, item = self.index.search(_packed(sums), size)
                    owner = np.searchsorted(ends, base + starts[a:a + WINDOWS][window], side="right")
                    pairs.update(zip(owner.tolist(), self.numbers[item].tolist()))
        return sorted(pairs)

    def _best(self, item: int, words: int, hashes: np.ndarray, weight: np.ndarray,
              hits: np.ndarray) -> tuple[int, int, float] | None:
        """(first word, words, similarity) of the first of a text's best windows for an item; ``hits``
        are the places of the item's shingles in the text."""
        size = self.lengths[item]
        span, total = size - self.width + 1, self.totals[item]
        if words < size:  # a text a little shorter than the item: one window
            similarity = self._similarity(item, hashes) if words >= self.threshold * span else 0.0
            return (0, words, similarity) if similarity >= self.threshold - EQUAL else None
        # a window whose first hit is hits[i] shares at most what lies in the span from there on
        gained = np.concatenate([[0.0], np.cumsum(weight[hits])])
        most = gained[np.searchsorted(hits, hits + span)] - gained[:-1]
        low = np.maximum(np.concatenate([[0], hits[:-1] + 1]), hits - span + 1)
        high = np.minimum(hits, words - size)
        some = (most >= (self.threshold - 2 * EQUAL) * total) & (low <= high)
        low, high = low[some], high[some]
        if not len(low):
            return None
        inside = np.zeros(len(hashes))
        inside[hits] = weight[hits]
        apart = np.flatnonzero(low[1:] > high[:-1] + span) + 1
        starts, found = [], []
        for begin, end in zip(low[np.r_[0, apart]].tolist(), high[np.r_[apart - 1, len(low) - 1]].tolist()):
            for a in range(begin, end + 1, WINDOWS):
                n = min(WINDOWS, end + 1 - a)
                part = slice(a, a + n + span - 1)
                here, common = _distinct_sums(hashes[part], (weight[part], inside[part]), span)
                similarity = common / (here + total - common)
                near = np.flatnonzero(similarity >= self.threshold - 2 * EQUAL)
                starts.append(near + a)
                found.append(similarity[near])
        starts, found = np.concatenate(starts), np.concatenate(found)
        for a in starts[found >= found.max() - 1e-10].tolist() if len(found) else ():
            similarity = self._similarity(item, hashes[a:a + span])
            if similarity >= self.threshold - EQUAL:
                return a, size, similarity
        return None


def _distinct_sums(hashes: np.ndarray, values: tuple[np.ndarray, ...], span: int) -> list[np.ndarray]:
    """For every ``span`` neighbours the sums of their values, equal hashes counted once."""
    order = np.argsort(hashes, kind="stable")
    equal = hashes[order[1:]] == hashes[order[:-1]]
    at = np.arange(len(hashes))
    # a place counts for the starts behind the last equal hash and at most span - 1 before it
    since = np.maximum(at - span + 1, 0)
    since[order[1:][equal]] = np.maximum(since[order[1:][equal]], order[:-1][equal] + 1)
    n = len(hashes) + 1
    return [np.cumsum(np.bincount(since, v, n) - np.bincount(at + 1, v, n))[:n - span] for v in values]


def item_blocks(items: DataFrame) -> Iterator[tuple[list, list[bytes]]]:
    """(item ids, texts) of the benchmark, in blocks; items without a text are left out."""
    rows = items.where(F.col("text").isNotNull()).select("item_id", F.encode("text", "UTF-8").alias("text")) \
        .orderBy("item_id", "text").toLocalIterator()
    while some := list(itertools.islice(rows, BLOCK_ITEMS)):
        yield [r["item_id"] for r in some], [bytes(r["text"]) for r in some]


def _index(texts: list[bytes], threshold: float) -> ItemIndex:
    return worker_cache(f"items-{hash((tuple(texts), threshold))}", lambda: ItemIndex(texts, threshold, WIDTH))


def find_leaks(docs: DataFrame, items: DataFrame, threshold: float = 0.75) -> DataFrame:
    """(doc_id, item_id, first_word, n_words, similarity): the best window of each document and item
    whose weighted shingle similarity is at least ``threshold``.

    Looked for where a window's fingerprint is within ``radius_of(threshold)`` of the item's; a single
    window at the threshold is beyond it once in 1 / ``MISS`` times, an equal one never.
    Words are runs of digits, letters and other non-ASCII signs, A-Z lower-cased.  A shingle weighs 1
    and the logarithm of the items of its block over those that hold it.  A document a little shorter
    than an item is one window.  Items and documents of fewer than five words match nothing; so do
    null and empty texts.  Ties go to the first window.  Every row is a document, repeated or not; a
    null doc_id is carried along; extra columns are ignored; without items or documents no row results.
    """
    schema = T.StructType([docs.schema["doc_id"], items.schema["item_id"], T.StructField("first_word", T.LongType()),
                           T.StructField("n_words", T.LongType()), T.StructField("similarity", T.DoubleType())])
    kind = pa.int64() if schema["item_id"].dataType == T.LongType() else None

    def search(ids: list, texts: list[bytes]):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            index = _index(texts, threshold)
            for batch in slices(batches):
                found = index.search(utf8(batch.column("text")))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").take(pa.array([x[0] for x in found], pa.int64())),
                     pa.array([ids[x[1]] for x in found], kind), pa.array([x[2] for x in found], pa.int64()),
                     pa.array([x[3] for x in found], pa.int64()), pa.array([x[4] for x in found], pa.float64())], schema.names)
        return run

    out = None
    for ids, texts in item_blocks(items):
        part = docs.select("doc_id", "text").mapInArrow(search(ids, texts), schema)
        out = part if out is None else out.unionByName(part)
    return docs.sparkSession.createDataFrame([], schema) if out is None else out


def without_leaks(docs: DataFrame, items: DataFrame, threshold: float = 0.75) -> DataFrame:
    """The documents, with all their columns, in which no item is found (see ``find_leaks``)."""
    def drop(texts: list[bytes]):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            index = _index(texts, threshold)
            for batch in slices(batches):
                keep = np.ones(len(batch), bool)
                keep[[x[0] for x in index.search(utf8(batch.column("text")))]] = False
                yield batch.filter(pa.array(keep))
        return run

    out = docs
    for _, texts in item_blocks(items):
        out = out.mapInArrow(drop(texts), docs.schema)
    return out
