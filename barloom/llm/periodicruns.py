"""Maximal runs of repeated words, found in a grammar of the words.

Words are numbered, and the numbers of a whole batch of texts are compressed by Re-Pair: in each
round every place where two neighbours occur together goes to the more frequent of the pairs that
overlap there, and each pair so chosen becomes one new symbol.  What no pair repeats is paired off
neighbour by neighbour, so every zone ends as one symbol.  A run lies in some symbol across the
border of its two halves; a symbol's runs across its border are computed once, where it stands
first, and carried to all places where it was derived.  Runs cut off at a symbol's ends are parts of
longer ones: intervals of equal period that share a period merge.

Only zones are compressed: words that no repeated six-word window of their own zone covers are in no
run of twelve words, since a run's second half repeats its first, and at least six words of it.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .arrow import slices, utf8
from .wordhash import hashed_words, mix

#: Shortest run; half of it is the window that any run repeats.
SHORTEST = 12
HALF = SHORTEST // 2
BATCH = 1 << 20
#: Borders and shifts that are compared at a time.
SHIFTS = 1 << 20
_STEP = np.uint64(0x9E3779B97F4A7C15)


# ---- zones -----------------------------------------------------------------------------------
def _repeated_windows(words: np.ndarray, zone: np.ndarray) -> np.ndarray:
    """Words covered by a window of ``HALF`` words that occurs twice in its zone."""
    n = len(words) - HALF + 1
    covered = np.zeros(len(words), bool)
    if n < 2:
        return covered
    print_ = np.zeros(n, np.uint64)
    for j in range(HALF):
        print_ *= _STEP
        print_ += words[j:j + n]
    print_ ^= mix(zone[:n].astype(np.uint64))
    mix(print_)
    whole = np.flatnonzero(zone[:n] == zone[HALF - 1:])
    order = whole[np.argsort(print_[whole], kind="stable")]
    equal = print_[order[1:]] == print_[order[:-1]]
    edge = np.zeros(len(words) + 1, np.int64)
    hit = np.zeros(n, bool)
    hit[order[1:][equal]] = True
    hit[order[:-1][equal]] = True
    starts = np.flatnonzero(hit)
    edge[starts] += 1
    np.add.at(edge, starts + HALF, -1)
    return np.cumsum(edge[:-1]) > 0


def zones(words: np.ndarray, texts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places of the words that can lie in a run, their zones): stretches of one text."""
    place, zone = np.arange(len(words)), texts
    while len(place):
        kept = _repeated_windows(words[place], zone)
        gap = np.ones(len(place), bool)
        gap[1:] = (zone[1:] != zone[:-1]) | ~kept[:-1]
        part = (np.cumsum(gap) - 1)
        sizes = np.bincount(part[kept], minlength=int(part[-1]) + 1)
        kept &= sizes[part] >= SHORTEST
        before = len(place)
        place, zone = place[kept], part[kept]
        if len(place) > 0.9 * before:
            break
    return place, zone


# ---- grammar ---------------------------------------------------------------------------------
class Grammar:
    """Pairs that became symbols: where each stands first, the border of its halves, its end, and all
    places it was derived at."""

    def __init__(self) -> None:
        self.starts: list[np.ndarray] = []
        self.borders: list[np.ndarray] = []
        self.ends: list[np.ndarray] = []
        self.symbols: list[np.ndarray] = []
        self.places: list[np.ndarray] = []
        self.n = 0

    def add(self, key: np.ndarray, start: np.ndarray, border: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Numbers of the pairs with these keys, each a new symbol of this grammar."""
        _, first, nth = np.unique(key, return_index=True, return_inverse=True)
        self.starts.append(start[first])
        self.borders.append(border[first])
        self.ends.append(end[first])
        self.symbols.append(nth + self.n)
        self.places.append(start)
        self.n += len(first)
        return nth

    def table(self) -> tuple[np.ndarray, ...]:
        none = np.zeros(0, np.int64)
        return tuple(np.concatenate([none, *x]) for x in (self.starts, self.borders, self.ends, self.symbols, self.places))


def _chosen(pair: np.ndarray, often: np.ndarray, inside: np.ndarray) -> np.ndarray:
    """Places of the pairs that are replaced: the more frequent of overlapping ones, the left of equal ones."""
    rank = np.where(inside & (often > 1), often.astype(np.float64) + (mix(pair.astype(np.uint64)) >> np.uint64(12)) / 2.0 ** 53, 0.0)
    n = len(rank)
    left = np.zeros(n, bool)  # beaten from the left, from the right
    right = np.zeros(n, bool)
    left[1:] = rank[:-1] > rank[1:]
    right[:-1] = rank[1:] > rank[:-1]
    equal = np.zeros(n, bool)  # the same pair as before: one symbol again and again
    equal[1:] = (pair[1:] == pair[:-1]) & inside[1:] & inside[:-1]
    # in a stretch of one pair every second place is free
    begin = np.flatnonzero(~equal)
    at = np.arange(n)
    since = at - begin[np.cumsum(~equal) - 1]
    stretch = np.cumsum(~equal) - 1
    beaten = np.zeros(len(begin), bool)
    np.logical_or.at(beaten, stretch, left | right)
    alone = np.bincount(stretch)[stretch] == 1
    take = (rank > 0) & np.where(alone, ~(left | right), since % 2 == 0)
    # a stretch may lose its first or last place to a pair beside it that ranks higher
    clash = np.flatnonzero(take[1:] & take[:-1])
    if len(clash):
        take[np.where(rank[clash] >= rank[clash + 1], clash + 1, clash)] = False
        clash = take[1:] & take[:-1]
        take[1:][clash] = False
    return np.flatnonzero(take)


def re_pair(symbols: np.ndarray, zone: np.ndarray) -> Grammar:
    """The grammar of all zones; equal pairs are one symbol wherever they stand."""
    grammar = Grammar()
    seq, start = symbols.astype(np.int64), np.arange(len(symbols))
    end = start + 1
    fresh = int(seq.max()) + 1 if len(seq) else 0
    repeats = True
    while len(seq) > 1:
        inside = zone[1:] == zone[:-1]
        if not inside.any():
            break
        pair = seq[:-1] * fresh + seq[1:]
        if repeats:
            _, nth, counts = np.unique(np.where(inside, pair, -1), return_inverse=True, return_counts=True)
            at = _chosen(nth, counts[nth], inside)
            if len(at) < 0.02 * len(seq):  # hardly any pair repeats
                repeats = False
        if not repeats:
            first = np.ones(len(seq), bool)
            first[1:] = ~inside
            begin = np.flatnonzero(first)
            nth = np.arange(len(seq)) - begin[np.cumsum(first) - 1]
            at = np.flatnonzero(inside & (nth[:-1] % 2 == 0))
        made = grammar.add(pair[at], start[at], end[at], end[at + 1])
        seq[at] = fresh + made
        end[at] = end[at + 1]
        stays = np.ones(len(seq), bool)
        stays[at + 1] = False
        seq, start, end, zone = seq[stays], start[stays], end[stays], zone[stays]
        # numbers stay small: what is still in use is numbered anew
        used, seq = np.unique(seq, return_inverse=True)
        fresh = len(used)
    return grammar


# ---- runs across borders -----------------------------------------------------------------------
class Matcher:
    """How far two places of the zones' words agree, forwards and backwards."""

    def __init__(self, words: np.ndarray, exact: bool):
        self.words, self.exact = words, exact
        self.base = int(_STEP)
        self.up = np.full(len(words) + 1, self.base, np.uint64)
        self.up[0] = 1
        np.multiply.accumulate(self.up, out=self.up)
        values = mix(words.astype(np.uint64) + np.uint64(1))
        self.sums = np.zeros(len(words) + 1, np.uint64)
        np.cumsum(values * self.up[:-1], out=self.sums[1:])

    def _same(self, a: np.ndarray, b: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Whether the n words from a on are those from b on (a < b)."""
        return (self.sums[a + n] - self.sums[a]) * self.up[b - a] == self.sums[b + n] - self.sums[b]

    def reach(self, a: np.ndarray, b: np.ndarray, most: np.ndarray, back: bool) -> np.ndarray:
        """Words that agree from a and b on (or before them), at most ``most``; a < b."""
        if self.exact:
            return self._stepped(a, b, most, back)
        low, high = np.zeros(len(a), np.int64), most.copy()
        while len(open_ := np.flatnonzero(low < high)):
            n = (low[open_] + high[open_] + 1) // 2
            shift = n if back else 0
            same = self._same(a[open_] - shift, b[open_] - shift, n)
            low[open_[same]] = n[same]
            high[open_[~same]] = n[~same] - 1
        return low

    def _stepped(self, a: np.ndarray, b: np.ndarray, most: np.ndarray, back: bool) -> np.ndarray:
        """The same by comparing words, for texts made to deceive the hash."""
        out, open_, step = np.zeros(len(a), np.int64), np.arange(len(a)), np.arange(32)
        while len(open_):
            n = out[open_]
            at = n[:, None] + step
            valid = at < most[open_, None]
            where = -1 - at if back else at
            i, j = np.where(valid, a[open_, None] + where, 0), np.where(valid, b[open_, None] + where, 0)
            agree = valid & (self.words[i] == self.words[j])
            length = np.where(agree.all(1), 32, agree.argmin(1))
            out[open_] = n + length
            open_ = open_[length == 32]
        return out


def _shifts(words: np.ndarray, start: np.ndarray, border: np.ndarray, end: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(symbol, earlier place, later place) where the word at a border stands again in the symbol's left
    half, or the word before it again in the right half."""
    n = len(words)
    order = np.argsort(words, kind="stable")
    rank = np.empty(n, np.int64)
    rank[order] = np.arange(n)
    key = words[order] * (n + 1) + order
    low = np.searchsorted(key, words[border] * (n + 1) + start)  # places of the border's word from the symbol's start on
    left = rank[border] - low
    high = np.searchsorted(key, words[border - 1] * (n + 1) + end)
    right = high - rank[border - 1] - 1
    total = np.cumsum(left + right)
    first = 0
    while first < len(border):
        last = max(first + 1, int(np.searchsorted(total, (total[first - 1] if first else 0) + SHIFTS, side="right")))
        own = np.arange(first, last)
        for counts, begin, is_left in ((left, low, True), (right, rank[border - 1] + 1, False)):
            k = counts[own]
            symbol = np.repeat(own, k)
            at = order[np.arange(len(symbol)) - np.repeat(np.cumsum(k) - k, k) + begin[symbol]]
            yield (symbol, at, border[symbol]) if is_left else (symbol, border[symbol] - 1, at)
        first = last


def border_runs(words: np.ndarray, start: np.ndarray, border: np.ndarray, end: np.ndarray,
                exact: bool = False) -> tuple[np.ndarray, ...]:
    """(symbol, first, end, period) of the runs in each symbol's words that lie across its border; the
    smallest period of each interval."""
    matcher = Matcher(words, exact)
    found: list[tuple[np.ndarray, ...]] = []
    long = np.flatnonzero(end - start >= SHORTEST)
    for nth, a, b in _shifts(words, start[long], border[long], end[long]):
        symbol = long[nth]
        ahead, behind = end[symbol] - b, a - start[symbol]
        # the words that agree around a and b are half of the shortest run or more
        fore, rear = np.ones(len(a), np.int64), np.zeros(len(a), np.int64)
        for k in range(1, HALF):
            on = np.flatnonzero((fore == k) & (ahead > k))
            on = on[words[a[on] + k] == words[b[on] + k]]
            fore[on] += 1
        for k in range(HALF - 1):
            on = np.flatnonzero((rear == k) & (behind > k) & (fore + rear < HALF))
            on = on[words[a[on] - k - 1] == words[b[on] - k - 1]]
            rear[on] += 1
        some = np.flatnonzero(fore + rear >= HALF)
        symbol, a, b = symbol[some], a[some], b[some]
        fore = matcher.reach(a, b, ahead[some], False)
        rear = matcher.reach(a, b, behind[some], True)
        low, high, period = a - rear, b + fore, b - a
        m = border[symbol]
        good = np.flatnonzero((high - low >= np.maximum(SHORTEST, 2 * period)) & (low < m) & (high > m))
        found.append((symbol[good], low[good], high[good], period[good]))
    symbol, low, high, period = (np.concatenate([np.zeros(0, np.int64), *x]) for x in (zip(*found) if found else [()] * 4))
    order = np.lexsort((period, high, low, symbol))
    symbol, low, high, period = (x[order] for x in (symbol, low, high, period))
    new = np.ones(len(symbol), bool)
    new[1:] = (symbol[1:] != symbol[:-1]) | (low[1:] != low[:-1]) | (high[1:] != high[:-1])
    return symbol[new], low[new], high[new], period[new]


def merged(low: np.ndarray, high: np.ndarray, period: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Intervals of equal period that share at least a period, as one; (first, end, period)."""
    order = np.lexsort((low, period))
    low, high, period = low[order], high[order], period[order]
    if not len(low):
        return low, high, period
    scale = int(high.max()) + 1
    reach = np.maximum.accumulate(period * scale + high)
    new = np.ones(len(low), bool)
    new[1:] = (period[1:] != period[:-1]) | (low[1:] + period[1:] > reach[:-1] - period[1:] * scale)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(low)) - 1
    return low[first], reach[last] - period[last] * scale, period[first]


def _proved(words: np.ndarray, zone: np.ndarray, low: np.ndarray, high: np.ndarray, period: np.ndarray) -> bool:
    """Whether every interval repeats with its period, word by word, and no neighbour extends it."""
    before = np.flatnonzero(low > 0)
    before = before[zone[low[before] - 1] == zone[low[before]]]
    if (words[low[before] - 1] == words[low[before] - 1 + period[before]]).any():
        return False
    after = np.flatnonzero(high < len(words))
    after = after[zone[high[after]] == zone[high[after] - 1]]
    if (words[high[after]] == words[high[after] - period[after]]).any():
        return False
    pieces = high - low - period
    total, first = np.cumsum(pieces), 0
    while first < len(low):
        last = max(first + 1, int(np.searchsorted(total, (total[first - 1] if first else 0) + SHIFTS, side="right")))
        k = pieces[first:last]
        at = np.arange(int(k.sum())) - np.repeat(np.cumsum(k) - k, k) + np.repeat(low[first:last], k)
        if (words[at] != words[at + np.repeat(period[first:last], k)]).any():
            return False
        first = last
    return True


def runs_of(words: np.ndarray, texts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place of the first word, length, period) of all runs, by place; ``texts`` numbers the text of each word."""
    place, zone = zones(words, texts)
    _, symbols = np.unique(words[place], return_inverse=True)
    start, border, end, symbol, places = re_pair(symbols, zone).table()
    for exact in (False, True):
        own, low, high, period = border_runs(symbols, start, border, end, exact)
        # to all places where the symbol was derived
        order = np.argsort(symbol, kind="stable")
        often = np.bincount(symbol, minlength=len(start))
        begin = np.cumsum(often) - often
        k = often[own]
        nth = np.repeat(np.arange(len(own)), k)
        at = places[order[np.arange(len(nth)) - np.repeat(np.cumsum(k) - k, k) + begin[own[nth]]]] - start[own[nth]]
        low, high, period = merged(at + low[nth], at + high[nth], period[nth])
        if _proved(symbols, zone, low, high, period):
            break
    first = place[low] if len(low) else low
    order = np.lexsort((period, first))
    return first[order], (high - low)[order], period[order]


# ---- texts -------------------------------------------------------------------------------------
def folded(doc_id: object, n: int) -> np.ndarray | None:
    """Which original word stands at each place of a text whose tail is made periodic; None: as it is."""
    if doc_id is None or not n:
        return None
    h = zlib.crc32(str(doc_id).encode())
    if h % 10:
        return None
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    at = np.arange(n)
    at[a:] = a + (at[a:] - a) % p
    return at


def _group(doc_ids: list, texts: list[bytes], fold: bool) -> Iterator[tuple]:
    for first, counts, hashes in hashed_words(texts, fold=False):
        begin = np.cumsum(counts) - counts
        for i in np.flatnonzero(counts) if fold else ():
            at = folded(doc_ids[first + i], int(counts[i]))
            if at is not None:
                part = slice(begin[i], begin[i] + counts[i])
                hashes[part] = hashes[part][at]
        starts, lengths, periods = runs_of(hashes, np.repeat(np.arange(len(counts)), counts))
        cut = np.searchsorted(starts, np.append(begin, begin[-1] + counts[-1] if len(begin) else 0))
        for i in range(len(counts)):
            doc_id, n = doc_ids[first + i], int(counts[i])
            words = texts[first + i].split()
            at = folded(doc_id, n) if fold else None
            if at is not None:
                words = [words[k] for k in at.tolist()]
            own = slice(cut[i], cut[i + 1])
            start, length, period = starts[own] - begin[i], lengths[own], periods[own]
            if not len(start):
                yield doc_id, n, 0, None, None, None, None, b"", b" ".join(words)
                continue
            edge = np.zeros(n + 1, np.int64)
            np.add.at(edge, start + period, 1)
            np.add.at(edge, start + length, -1)
            kept = np.flatnonzero(np.cumsum(edge[:-1]) == 0)
            lines = "".join([f"{s},{m},{q}\n" for s, m, q in zip(start.tolist(), length.tolist(), period.tolist())]).encode()
            best = np.lexsort((period, start, -length))[0]
            s, m, q = int(start[best]), int(length[best]), int(period[best])
            yield doc_id, n, len(start), s, m, q, 1000 * m // q, lines, b" ".join([words[k] for k in kept.tolist()])


def find_runs(docs: DataFrame, fold_tails: bool = False) -> DataFrame:
    """Per document (doc_id, n_words, n_runs, start, length, period, exponent_milli, runs, collapsed).

    A run is a stretch of words with smallest period q and at least max(12, 2 q) words that no
    neighbour extends; ``runs`` lists all as ``start,length,period`` lines by start, then period; the
    four numbers are those of the longest (ties: first start, then smaller period), null without a run.
    ``collapsed`` is the text of the words that no run repeats, one space apart.  ``fold_tails`` first
    makes the tails of a tenth of the documents periodic, as a test of the search (see ``folded``).

    Words are what stands between ASCII white space, with their case.  A null, empty or blank text has
    no words and no run.  Every row is a document, repeated or not; a null doc_id is carried along and
    its tail stays; doc_id may be of any type; other columns are ignored; no rows give no rows.  Rows
    are worked on where they lie, about a megabyte at a time; a longer text is worked on alone, so
    memory follows the longest text.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, budget=BATCH):
            ids = batch.column("doc_id")
            rows = list(_group(ids.to_pylist(), utf8(batch.column("text")), fold_tails))
            columns = list(zip(*rows)) if rows else [()] * 9
            yield pa.RecordBatch.from_arrays(
                [ids, *[pa.array(columns[k], pa.int64()) for k in range(1, 7)],
                 pa.array(columns[7], pa.binary()).cast(pa.string()), pa.array(columns[8], pa.binary()).cast(pa.string())], schema.names)

    longs = [T.StructField(c, T.LongType()) for c in ("n_words", "n_runs", "start", "length", "period", "exponent_milli")]
    schema = T.StructType([docs.schema["doc_id"], *longs, T.StructField("runs", T.StringType()), T.StructField("collapsed", T.StringType())])
    return docs.select("doc_id", "text").mapInArrow(run, schema)


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()
