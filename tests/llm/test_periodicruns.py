"""Runs of repeated words against a search by the definition."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from barloom.llm import periodicruns, registry

SMALL = "/root/testdata/sf0.001"


def brute_runs(words):
    """(start, length, period) by the definition: each period's maximal stretches, smallest period kept."""
    n, found = len(words), {}
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j - i + q >= max(12, 2 * q):
                found.setdefault((i, j - i + q), q)
            i = j + 1
    return sorted((s, m, q) for (s, m), q in found.items())


def brute(doc_id, text, fold=True):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n = len(words)
    h = zlib.crc32(str(doc_id).encode())
    if fold and doc_id is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = words[:a] + [words[a + (i - a) % p] for i in range(a, n)]
    runs = brute_runs(words)
    dropped = {i for s, m, q in runs for i in range(s + q, s + m)}
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    best = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else None
    four = (best[0], best[1], best[2], 1000 * best[1] // best[2]) if best else (None,) * 4
    return (doc_id, len(runs), *four, sha("".join(f"{s},{m},{q}\n" for s, m, q in runs)),
            sha(" ".join(w for i, w in enumerate(words) if i not in dropped)))


def numbers(words):
    """Runs of one list of words, through the grammar."""
    hashes = np.array([zlib.crc32(str(w).encode()) * 2654435761 + 7 for w in words], np.uint64)
    s, m, q = periodicruns.runs_of(hashes, np.zeros(len(words), np.int64))
    return list(zip(s.tolist(), m.tolist(), q.tolist()))


def fibonacci(n):
    a, b = "a", "ab"
    while len(b) < n:
        a, b = b, b + a
    return list(b[:n])


@pytest.mark.parametrize("words", [
    ["a"] * 12, ["a"] * 11, ["a"] * 200, list("ab") * 6, list("ab") * 5 + ["a"], list("abc") * 30 + list("abd") * 30,
    fibonacci(300), [bin(i).count("1") % 2 for i in range(256)], (list("abcdefg") * 3 + ["x"]) * 4,
    list("aaaaaaaaaaaab") * 9, [f"w{i}" for i in range(100)] * 2, [f"w{i}" for i in range(100)] * 3 + ["w0"], []])
def test_known_words(words):
    assert numbers(words) == brute_runs(words)


def test_random_words_of_small_alphabets():
    rng = random.Random(3)
    for case in range(300):
        words = [rng.randrange(rng.choice([1, 2, 3, 8])) for _ in range(rng.randrange(1, 160))]
        for _ in range(rng.randrange(3)):  # plant repeats
            at, p = rng.randrange(len(words) + 1), rng.randrange(1, 25)
            piece = [rng.randrange(4) for _ in range(p)] * rng.randrange(2, 6)
            words[at:at] = piece[:rng.randrange(1, len(piece) + 1)]
        assert numbers(words) == brute_runs(words), case


def test_several_texts_do_not_run_into_each_other():
    words = np.array([5] * 30 + [5] * 8 + [1, 2, 3, 4] * 5, np.uint64)
    texts = np.repeat([0, 1, 2], [30, 8, 20])
    s, m, q = periodicruns.runs_of(words, texts)
    assert list(zip(s, m, q)) == [(0, 30, 1), (38, 20, 4)]


def test_words_made_to_deceive_the_hash():
    """Thue-Morse words of 2048 letters have equal polynomial hashes modulo 2**64; the result is exact all the same."""
    thue = [bin(i).count("1") % 2 for i in range(2048)]
    words = thue + [1 - x for x in thue] + thue + [7] + thue[:40] * 3
    assert numbers(words) == brute_runs(words)


def test_stepped_reach_equals_hashed_reach():
    words = np.array([1, 2, 3] * 40 + [9] + [1, 2, 3] * 40, np.int64)
    a, b = np.array([0, 3, 120, 60]), np.array([3, 121, 123, 181])
    for back in (False, True):
        most = a.copy() if back else len(words) - b
        plain, hashed = (periodicruns.Matcher(words, exact).reach(a, b, most, back).tolist() for exact in (True, False))
        assert plain == hashed


def table(spark, rows):
    return spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, n_runs int, runs string").repartition(3)


def found(df, fold):
    out = periodicruns.find_runs(df, fold_tails=fold)
    return sorted(((r["doc_id"], r["n_runs"], r["start"], r["length"], r["period"], r["exponent_milli"],
                    periodicruns.digest(r["runs"]), periodicruns.digest(r["collapsed"])) for r in out.collect()), key=repr)


def test_awkward_rows(spark, rows):
    tail = [(i, " ".join(f"w{(i * k) % 13}" for k in range(60))) for i in range(100, 260)]
    rows = rows + tail + tail[:5] + [(8, "other text with one id"), (None, "again " * 20), (-7, "minus " * 50)]
    for fold in (True, False):
        assert found(table(spark, rows), fold) == sorted((brute(i, t, fold) for i, t in rows), key=repr)


def test_very_long_texts(spark):
    period = " ".join(f"p{i}" for i in range(7000))
    rows = [(1, "word " * 400_000), (2, " ".join([period] * 12) + " end"), (3, "x" * 5_000_000)]
    got = {r["doc_id"]: (r["n_runs"], r["start"], r["length"], r["period"]) for r in periodicruns.find_runs(table(spark, rows)).collect()}
    assert got == {1: (1, 0, 400_000, 1), 2: (1, 0, 84_000, 7000), 3: (0, None, None, None)}


def test_empty_table_and_other_ids(spark):
    assert found(table(spark, []), True) == []
    df = spark.createDataFrame([("a", "b " * 30)], "doc_id string, text string")
    assert periodicruns.find_runs(df, fold_tails=True).first()["n_runs"] == 1


def test_whole_table(spark):
    got = sorted((tuple(r) for r in registry.QUERIES["op12_periodic_runs"](spark, SMALL).select(
        "doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256").collect()), key=repr)
    rows = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()
    assert got == sorted((brute(r["doc_id"], r["text"]) for r in rows), key=repr)
