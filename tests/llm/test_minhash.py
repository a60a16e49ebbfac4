import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from barloom.llm import minhash
from barloom.llm.components import components
from barloom.llm.registry import QUERIES

SMALL = "/root/testdata/sf0.001"


def shingle_set(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute(texts):
    """{doc_id: (set size, component)} by comparing all documents."""
    sets = {i: shingle_set(t) for i, t in texts}
    name = {i: i for i in sets}
    ids = sorted(sets)
    for x, i in enumerate(ids):
        for j in ids[x + 1:]:
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 75 * len(sets[i] | sets[j]) and name[i] != name[j]:
                low, high = sorted((name[i], name[j]))
                name = {k: low if v == high else v for k, v in name.items()}
    return {i: (len(sets[i]), name[i]) for i in ids}


def result(df):
    rows = df.collect()
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in rows)
    out = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in rows}
    assert len(out) == len(rows)
    return out


@pytest.mark.parametrize("folder", [SMALL, "/root/testdata/sf0.01"])
def test_query_against_brute_force(spark, folder):
    texts = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    assert result(QUERIES["op2_minhash_near_dedup"](spark, folder)) == brute(texts)


def test_chains_copies_and_thresholds(spark, rows):
    """A chain of edits whose ends are unlike, a pair just at the threshold, a pair just below, a large
    group of near copies and texts that share one passage only."""
    rng = random.Random(1)
    word = lambda: "w%d" % rng.randrange(10 ** 6)
    base = [word() for _ in range(124)]
    texts = [(i, t) for i, t in rows if i is not None]
    for step in range(8):
        base = base[9:] + [word() for _ in range(9)]
        texts.append((300 - step, " ".join(base)))
    seven = [f"t{i}" for i in range(11)]  # sets of 7 shingles: 6 of 8 shared is exactly 0.75
    texts += [(400, " ".join(seven)), (401, " ".join(seven[1:] + ["z"])), (402, " ".join([word() for _ in range(3)] + seven[3:]))]
    root = [word() for _ in range(200)]
    for k in range(120):
        some = list(root)
        for _ in range(rng.randrange(1, 5)):
            some[rng.randrange(200)] = word()
        texts.append((1000 + k, " ".join(some)))
    passage = " ".join(word() for _ in range(60))
    texts += [(2000 + k, passage + " " + " ".join(word() for _ in range(40))) for k in range(40)]
    table = spark.createDataFrame([(i, t, 1) for i, t in texts], "doc_id long, text string, bucket int").repartition(4)
    want = brute(texts)
    assert want[401][1] == 400 and want[293][1] == 293 and want[402][1] == 402
    assert result(minhash.near_duplicates(table)) == want


def test_empty_tables_and_missing_ids(spark, docs):
    assert minhash.near_duplicates(docs.limit(0)).count() == 0
    only = docs.where(F.col("doc_id").isin(1, 2, 3) | F.col("doc_id").isNull())
    assert result(minhash.near_duplicates(only.where("doc_id > 0"))) == {1: (0, 1), 2: (0, 2), 3: (0, 3)}
    nameless = minhash.near_duplicates(only.union(only)).where("doc_id IS NULL").collect()
    assert [tuple(r) for r in nameless] == [(None, 1, None, True)] * 2
    twice = minhash.near_duplicates(docs.union(docs)).collect()
    assert len(twice) == 2 * docs.count()


def test_string_ids(spark, docs, rows):
    """Ids that are no numbers: the same components, named by the least string."""
    named = docs.withColumn("doc_id", F.concat(F.lit("doc-"), F.lpad(F.col("doc_id").cast("string"), 5, "0")))
    out = minhash.near_duplicates(named).collect()
    want = brute([(i, t) for i, t in rows if i is not None])
    name = lambda i: f"doc-{i:05d}"
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in out if r["doc_id"]} == \
        {name(i): (n, name(c), i == c) for i, (n, c) in want.items()}
    assert [tuple(r) for r in out if not r["doc_id"]] == [(None, 1, None, True)] and len(out) == len(rows)


def test_signature_estimates_similarity():
    rng = np.random.default_rng(2)
    both, a, b = (rng.integers(0, 2 ** 32, n, dtype=np.uint32) for n in (600, 200, 200))
    table = minhash.signatures(np.concatenate([both, a, both, b]), np.array([800, 800]), 512)
    assert abs((table[:, 0] == table[:, 1]).mean() - 0.6) < 0.08


def test_components(spark):
    edges = [(1, 2), (2, 3), (3, 4), (10, 9), (9, 8), (8, 10), (5, 5), (2, 1), *[(20 + i, 21 + i) for i in range(40)],
             *[(100, 101 + i) for i in range(50)], (50, 120)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    name = {n: n for e in edges for n in e if e[0] != e[1]}
    for _ in range(60):
        for a, b in edges:
            if a != b:
                name[a] = name[b] = min(name[a], name[b])
    assert got == name
