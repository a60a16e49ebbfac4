"""Words, shingles and their 64-bit hashes for whole groups of texts at once, in numpy.

A word is a maximal run of bytes outside a set of ASCII separators; since all separators are ASCII,
bytes of UTF-8 give the same words as code points.  A-Z count as a-z (``fold``).  A word's hash is a polynomial
over per-byte random values modulo 2**64 with a final mix; a shingle's hash mixes its words' hashes.
Long texts are read in windows that end at a separator, so memory follows the window and the words
of one text, not the bytes of a group.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

from .arrow import groups, worker_cache

SPACES = bytes([0x20, *range(0x09, 0x0E)])
NOT_ALNUM = bytes([*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)])
WINDOW = 1 << 18


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit (in place)."""
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _odd(seed: int, n: int) -> np.ndarray:
    return np.random.Generator(np.random.PCG64(seed)).integers(0, 2 ** 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64."""
    base = int(_odd(11, 1)[0])
    out = []
    for b in (base, pow(base, -1, 2 ** 64)):
        steps = np.full(n, b, np.uint64)
        steps[0] = 1
        out.append(np.multiply.accumulate(steps))
    return out[0], out[1]


def _tables(separators: bytes, fold: bool) -> tuple[np.ndarray, np.ndarray]:
    values = _odd(12, 256)
    if fold:
        values[ord("A"):ord("Z") + 1] = values[ord("a"):ord("z") + 1]
    is_word = np.ones(256, bool)
    is_word[list(separators)] = False
    if ord("A") in separators:  # the separators are given for lower-cased text
        is_word[ord("A"):ord("Z") + 1] = True
    values[~is_word] = 0
    return values, is_word


def window_words(buffer: np.ndarray, separators: bytes = SPACES, fold: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, hashes) of the words of a buffer that begins and ends with a separator."""
    values, is_word = worker_cache(f"wordhash-{separators.hex()}-{fold}", lambda: _tables(separators, fold))
    size = 1 << max(20, int(len(buffer)).bit_length())
    up, down = worker_cache(f"wordhash-powers-{size}", lambda: _powers(size))
    inside = is_word[buffer]
    edges = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    starts, ends = edges[0::2], edges[1::2]
    running = values[buffer]
    running *= up[:len(buffer)]
    np.cumsum(running, out=running)
    hashes = running[ends - 1] - running[starts - 1]
    hashes *= down[starts]
    return starts, ends, mix(hashes)


def _windows(text: bytes, separators: bytes) -> Iterator[bytes]:
    """Pieces of a long text, cut at separators."""
    marks = set(separators)
    at = 0
    while at < len(text):
        end = min(len(text), at + WINDOW)
        while end < len(text) and text[end] not in marks:
            end += 1
        yield text[at:end]
        at = end


def hashed_words(texts: list[bytes], separators: bytes = SPACES, fold: bool = True) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(index of the first text, words per text, hashes of all words) of group after group of texts."""
    for first, last in groups(texts, WINDOW):
        if last - first == 1 and len(texts[first]) > WINDOW:
            parts = [window_words(np.frombuffer(b" " + piece + b" ", np.uint8), separators, fold)[2]
                     for piece in _windows(texts[first], separators)]
            words = np.concatenate(parts)
            yield first, np.array([len(words)]), words
            continue
        some = texts[first:last]
        buffer = np.frombuffer(b" " + b" ".join(some) + b" ", np.uint8)
        starts, _, words = window_words(buffer, separators, fold)
        borders = np.cumsum([1] + [len(t) + 1 for t in some])
        yield first, np.diff(np.searchsorted(starts, borders)), words


def shingles(counts: np.ndarray, words: np.ndarray, width: int, short: bool) -> tuple[np.ndarray, np.ndarray]:
    """(shingles per text, their hashes in order of place).

    ``short``: a text with words, but fewer than ``width``, has its whole sequence as one shingle;
    else it has none.
    """
    factors = _odd(13, width + 1)
    total = len(words)
    made = np.zeros(max(0, total - width + 1), np.uint64)
    for j in range(width if len(made) else 0):
        made += words[j:total - width + 1 + j] * factors[j]
    ends = np.repeat(np.cumsum(counts), counts)[:len(made)]
    made = mix(made)[np.arange(len(made)) + width <= ends]
    n = np.maximum(counts - width + 1, 0)
    few = np.flatnonzero((counts > 0) & (counts < width)) if short else []
    if len(few):
        begins = np.cumsum(counts) - counts
        extra = [(words[begins[i]:begins[i] + counts[i]] * factors[:counts[i]]).sum(dtype=np.uint64)
                 + factors[width] * np.uint64(counts[i]) for i in few]
        made = np.insert(made, (np.cumsum(n) - n)[few], mix(np.array(extra, np.uint64)))
        n[few] = 1
    return n, made
