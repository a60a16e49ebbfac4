"""Fingerprints against the plain definition: texts edited in Python, sets of paragraphs compared directly."""

import hashlib
import random

import regex
import pytest
from pyspark.sql import functions as F

from barloom.llm import registry, sketches

SMALL = "/root/testdata/sf0.001"


def paragraphs(text):
    return set(regex.findall(r"[^\n]{200,}?[.!?](?=[ \n]|\Z)|[^\n]+", text or ""))


def likeness(a, b):
    a, b = paragraphs(a), paragraphs(b)
    return len(a & b) / len(a | b) if a | b else 1.0


def brute(rows):
    """(doc_id, n_chars, edited_sha256, near_edited, near_next) by the definition."""
    ordered = sorted(((i, t or "") for i, t in rows), key=lambda r: (r[0] is None, 0 if r[0] is None else -r[0], r[1].encode()))
    out = []
    for k, (i, text) in enumerate(ordered):
        after = ordered[(k + 1) % len(ordered)][1]
        half = len(text) // 2
        edited = text[:len(text) - half] + after[:half]
        out.append((i, len(text), hashlib.sha256(edited.encode()).hexdigest(), likeness(text, edited), likeness(text, after)))
    return sorted(out, key=repr)


def result(df):
    out = sketches.fingerprints(df).withColumn("sha", F.sha2(F.encode("edited_text", "UTF-8"), 256))
    return sorted(((r["doc_id"], r["n_chars"], r["sha"], r["near_edited"], r["near_next"]) for r in out.collect()), key=repr)


def same(got, want):
    assert [r[:3] for r in got] == [r[:3] for r in want]
    for g, w in zip(got, want):
        assert g[3:] == pytest.approx(w[3:], abs=1e-12), g[0]


def table(spark, rows):
    return spark.createDataFrame([(i, t, 9, True, "k") for i, t in rows],
                                 "doc_id long, text string, n_chars long, head boolean, cell string").repartition(3)


def prose(rng, n):
    words = lambda: " ".join("".join(rng.choices("abcdeé", k=rng.randrange(2, 9))) for _ in range(rng.randrange(3, 30)))
    return "\n".join(" ".join(words().capitalize() + rng.choice(".!?") for _ in range(rng.randrange(1, 6))) for _ in range(n))


def test_awkward_rows(spark, rows):
    rng = random.Random(2)
    rows = rows + [(8, "another text with one id"), (8, "another text with one id"), (None, "b"), (-5, "minus\none"),
                   (10 ** 15, "far away.\n" * 3), (10 ** 15 + 1, "near.\nby"), (2 ** 40, prose(rng, 3))]
    same(result(table(spark, rows)), brute(rows))


@pytest.mark.parametrize("ids", [range(700), range(0, 70_000, 100), [k * 7 % 701 - 350 for k in range(700)], [2 ** (k % 60) + k for k in range(300)]])
def test_next_over_many_cells(spark, ids, monkeypatch):
    monkeypatch.setattr(sketches, "CELL_ROWS", 16)
    rows = [(i, f"text {i}") for i in ids]
    got = {r["doc_id"]: r["next_text"] for r in sketches.with_next(table(spark, rows)).collect()}
    ordered = sorted(set(ids), reverse=True)
    assert got == {i: f"text {j}" for i, j in zip(ordered, ordered[1:] + ordered[:1])}


def test_one_row_and_none(spark):
    same(result(table(spark, [(4, "One only.\nTwo")])), brute([(4, "One only.\nTwo")]))
    assert result(table(spark, [])) == []


def test_ids_of_text(spark):
    rows = [(f"doc-{k:04d}", f"text {k}") for k in range(600)] + [(None, "none")]
    df = spark.createDataFrame(rows, "doc_id string, text string").repartition(3)
    got = {r["doc_id"]: r["next_text"] for r in sketches.with_next(df).collect()}
    assert got == {**{f"doc-{k:04d}": f"text {k - 1}" for k in range(1, 600)}, "doc-0000": "none", None: "text 599"}


def test_difference_recovers_the_digests_of_every_size(spark):
    """Retries go on until all digests that differ are known, whichever side has them."""
    rng = random.Random(1)
    pairs = []
    for k, (both, left, right) in enumerate([(0, 0, 0), (9, 0, 0), (50, 1, 0), (30, 0, 3), (5, 30, 30), (900, 20, 0), (10, 900, 700), (0, 3000, 1)]):
        lines = [f"line {k} {n} {rng.random()}" for n in range(both + left + right)]
        pairs.append((k, "\n".join(lines[:both + left]), "\n".join(lines[:both] + lines[both + left:])))
    df = spark.createDataFrame(pairs, "k int, a string, b string")
    digest = {r["p"]: r["d"] for r in spark.createDataFrame(
        [(p,) for _, a, b in pairs for p in paragraphs(a) | paragraphs(b)], "p string").withColumn("d", F.xxhash64("p")).collect()}
    for row in sketches.compare(df, "a", "b").collect():
        a, b = paragraphs(row["a"]), paragraphs(row["b"])
        assert sorted(row["difference"]["only_left"]) == sorted(digest[p] for p in a - b)
        assert sorted(row["difference"]["only_right"]) == sorted(digest[p] for p in b - a)
        assert row["difference"]["likeness"] == pytest.approx(len(a & b) / len(a | b) if a | b else 1.0)


def test_long_texts_and_equal_fingerprints(spark):
    rng = random.Random(4)
    rows = [(1, "x" * 300_000), (2, prose(rng, 1500)), (3, "word. " * 60_000), (4, prose(rng, 2)), (5, "word. " * 60_000)]
    same(result(table(spark, rows)), brute(rows))
    prints = {r["doc_id"]: r["fingerprint"] for r in sketches.fingerprints(table(spark, rows)).collect()}
    assert prints[3] == prints[5] and len(set(prints.values())) == 4


def test_no_python_in_the_plan(spark):
    plan = registry.QUERIES["op11_document_fingerprints"](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_whole_table(spark):
    columns = ("doc_id", "n_chars", "edited_sha256", "near_edited", "near_next")
    got = sorted((tuple(r[c] for c in columns) for r in registry.QUERIES["op11_document_fingerprints"](spark, SMALL).collect()), key=repr)
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    same(got, brute(rows))
