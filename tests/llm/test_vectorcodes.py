"""Vector codes against a direct k-means in integers."""

import hashlib
import math
import random

import numpy as np

from barloom.llm import registry, vectorcodes

SMALL = "/root/testdata/sf0.001"


def brute(rows, parts=16, entries=64, rounds=2, scale=256):
    """(vec_id, code, error, label_error, sha256) by the definition, one part and entry at a time."""
    kept = [(i, [math.floor(scale * x) for x in v], label) for i, v, label in rows
            if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    if not kept:
        return []
    size = -(-max(len(v) for _, v, _ in kept) // parts)
    kept = [(i, v + [0] * (parts * size - len(v)), label) for i, v, label in kept]
    first = sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, r[1]))[:entries]
    books = [[v[p * size:(p + 1) * size] for _, v, _ in first] for p in range(parts)]

    def assign(p, part):
        far = [sum((a - b) ** 2 for a, b in zip(part, e)) for e in books[p]]
        return far.index(min(far)), min(far)

    for _ in range(rounds):
        for p in range(parts):
            members = {}
            for _, v, _ in kept:
                part = v[p * size:(p + 1) * size]
                members.setdefault(assign(p, part)[0], []).append(part)
            for e, own in members.items():
                books[p][e] = [sum(c) // len(own) for c in zip(*own)]
    out, by_label = [], {}
    for i, v, label in kept:
        found = [assign(p, v[p * size:(p + 1) * size]) for p in range(parts)]
        error = sum(d for _, d in found)
        by_label[label] = by_label.get(label, 0) + error
        out.append((i, "".join(f"{e:02x}" for e, _ in found), error, label))
    sha = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return sorted(((i, code, error, by_label[label], sha) for i, code, error, label in out), key=repr)


def result(df, **kw):
    out = vectorcodes.compress(df, **kw)
    return sorted(((r["vec_id"], r["code"], r["error"], r["label_error"], r["codebooks_sha256"]) for r in out.collect()), key=repr)


def frame(spark, rows):
    return spark.createDataFrame([(i, v, label, "x", 1) for i, v, label in rows],
                                 "vec_id long, embedding array<float>, label int, code string, error int").repartition(3)


def awkward():
    rng = random.Random(5)
    f = lambda: float(np.float32(rng.uniform(-0.6, 0.6)))
    rows = [(i * 7 % 199, [f() for _ in range(32)], rng.choice([None, 1, 2])) for i in range(199)]
    rows += [(500 + i, rows[3][1], 1) for i in range(60)]  # one common vector
    rows += [(700, rows[3][1], 1)] * 3 + [(None, rows[5][1], None)]  # repeated rows, no id
    rows += [(800, None, 1), (801, [None] * 32, 2), (802, [0.0] * 31 + [float("nan")], 2), (803, [float("inf")] * 32, None)]
    return rows


def test_equals_brute_force(spark):
    rows = awkward()
    assert result(frame(spark, rows)) == brute(rows)
    assert result(frame(spark, rows), parts=4, entries=5, rounds=3) == brute(rows, 4, 5, 3)


def test_few_rows_ties_and_uneven_lengths(spark):
    rows = [(1, [0.5] * 20, 1), (1, [-0.5] * 20, 1), (2, [0.25] * 7, None), (3, [], None), (4, [0.0] * 20, None)]
    assert result(frame(spark, rows)) == brute(rows)


def test_no_rows(spark):
    assert result(frame(spark, [])) == []
    assert result(frame(spark, [(1, None, 1)])) == []


def test_whole_table(spark):
    rows = [(r["vec_id"], r["embedding"], r["label"]) for r in spark.read.parquet(f"{SMALL}/embeddings.parquet").collect()]
    got = sorted((tuple(r[c] for c in ("vec_id", "code", "error", "label_error", "codebooks_sha256"))
                  for r in registry.QUERIES["op13_vector_code_compression"](spark, SMALL).collect()), key=repr)
    assert got == brute(rows)


def test_walk_shares_prefixes_over_blocks_of_leaves(monkeypatch):
    rng = np.random.default_rng(1)
    parts, book = rng.integers(-3, 3, (4000, 4)), rng.integers(-3, 3, (9, 4))
    leaves, often, nth = vectorcodes.distinct_parts(parts)
    far = ((leaves[:, None] - book[None]) ** 2).sum(2)
    monkeypatch.setattr(vectorcodes, "LEAVES", 17)
    entry, least = vectorcodes.nearest(leaves, book)
    assert (entry == far.argmin(1)).all() and (least == far.min(1)).all()
    assert (leaves[nth] == parts).all() and often.sum() == len(parts) and len(leaves) < 1297
