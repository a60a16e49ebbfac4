import math
import random
import re
from collections import Counter

import numpy as np

from barloom.llm import decontaminate
from barloom.llm.registry import QUERIES

SMALL = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words_of(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def grams(words):
    return {tuple(words[i:i + 5]) for i in range(len(words) - 4)}


def brute(texts, items):
    """{(doc, item): similarity}: every window of the item's size compared exactly."""
    sets = {k: (len(words_of(t)), grams(words_of(t))) for k, t in items if t is not None}
    holders = Counter(g for _, s in sets.values() for g in s)
    top = 1 + math.log(max(len(sets), 1))
    weigh = lambda some: sum(top - math.log(holders[g]) if g in holders else top for g in some)
    out = {}
    for i, text in texts:
        words = words_of(text)
        own = grams(words)
        for k, (n, item) in sets.items():
            if n < 5 or not own & item:
                continue
            windows = [words[a:a + n] for a in range(len(words) - n + 1)]
            windows += [words] if len(words) < n and len(words) >= 0.75 * (n - 4) else []
            best = max((weigh(g & item) / weigh(g | item) for g in map(grams, windows)), default=0)
            if best >= 0.75:
                out[i, k] = best
    return out


def got(df):
    rows = df.collect()
    out = {(r["doc_id"], r["item_id"]): r["similarity"] for r in rows}
    assert len(out) == len(rows)
    return out


def same(a, b):
    assert set(a) == set(b)
    assert all(abs(a[k] - b[k]) < 1e-9 for k in a)


def tables(spark, folder):
    return ([(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()],
            [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()])


def test_query_against_brute_force(spark):
    for folder in (SMALL, "/root/testdata/sf0.01"):
        texts, items = tables(spark, folder)
        same(got(QUERIES["op3_benchmark_decontamination"](spark, folder)), brute(texts, items))


def planted():
    rng = random.Random(4)
    word = lambda: "v%d" % rng.randrange(4000)
    items = [(k, " ".join(word() for _ in range(n))) for k, n in enumerate([5, 8, 20, 37, 37, 60, 130, 200])]
    items += [(20, None), (21, ""), (22, "too few"), (23, items[3][1] + " " + " ".join(word() for _ in range(6)))]
    texts = []
    for i in range(120):
        body = [word() for _ in range(rng.randrange(0, 300))]
        if i % 2:
            leak = words_of(items[rng.randrange(8)][1])
            for _ in range(rng.choice([0, 0, 1, 2])):
                leak[rng.choice([0, 1, -1, len(leak) // 2])] = word()
            cut = rng.choice([0, 0, 1, 3])
            at = rng.randrange(len(body) + 1)
            body = body[:at] + [w.upper() + "," for w in leak[cut:]] + body[at:]
        texts.append((i, " ".join(body)))
    return texts + [(500, items[5][1][:-30]), (501, items[5][1])], items


def test_planted_leaks(spark, rows):
    texts, items = planted()
    texts += [(1000 + (i or 0), t) for i, t in rows]
    docs = spark.createDataFrame([(i, t, 1) for i, t in texts], "doc_id long, text string, item_id int").repartition(3)
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = brute(texts, items)
    assert len(want) > 40
    same(got(decontaminate.find_leaks(docs, bench)), want)
    kept = decontaminate.without_leaks(docs, bench)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(set(i for i, _ in texts) - {i for i, _ in want})


def test_blocks_of_items_and_empty_tables(spark, monkeypatch):
    texts, items = planted()
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    monkeypatch.setattr(decontaminate, "BLOCK_ITEMS", 3)
    found = set(got(decontaminate.find_leaks(docs, bench)))
    assert {k for k, s in brute(texts, items).items() if s > 0.9} <= found
    assert {r["doc_id"] for r in decontaminate.without_leaks(docs, bench).collect()}.isdisjoint({i for i, _ in found})
    assert decontaminate.find_leaks(docs.limit(0), bench).count() == 0
    assert decontaminate.find_leaks(docs, bench.limit(0)).count() == 0
    assert decontaminate.without_leaks(docs, bench.limit(0)).count() == len(texts)


def test_fingerprints_of_all_windows():
    rng = np.random.default_rng(1)
    words, weights = rng.integers(0, 2 ** 63, 300, dtype=np.uint64), rng.integers(1, 90, 300)
    running = decontaminate._running(decontaminate._signed(words, weights.astype(np.int32)))
    for size in (5, 40, 140):
        prints = decontaminate._packed(running[size:] - running[:-size]).view(np.uint64).reshape(-1)
        for at in (0, 3, 300 - size):
            bits = np.unpackbits(words[at:at + size].view(np.uint8).reshape(-1, 8), axis=1).astype(int)
            want = np.packbits(((2 * bits - 1) * weights[at:at + size, None]).sum(axis=0) > 0).view(np.uint64)[0]
            assert prints[at] == want


def test_index_finds_all_within_the_radius():
    rng = np.random.default_rng(2)
    prints, classes = rng.integers(0, 2 ** 16, (77, 4)).astype(np.uint16), rng.integers(5, 9, 77)
    queries = prints[rng.integers(0, 77, 400)].copy()
    for row in queries:  # up to 30 bits turned, often all in one or two blocks
        for bit in rng.integers(0, rng.choice([16, 32, 64]), rng.integers(0, 31)):
            row[bit >> 4] ^= np.uint16(1 << (bit & 15))
    for radius in (0, 2, 3, 11, 23, 64):
        index = decontaminate.HammingIndex(prints, classes, radius)
        for kind in range(5, 9):
            want = {(q, i) for q in range(400) for i in np.flatnonzero(classes == kind)
                    if sum(int(x).bit_count() for x in queries[q] ^ prints[i]) <= radius}
            query, entry = index.search(queries, kind)
            assert len(query) == len(want) and set(zip(query.tolist(), entry.tolist())) == want


def test_recall_of_the_radius_at_the_threshold():
    """Pairs of sets of similarity 0.75 to 0.78, of 20 to 120 shingles: nearly none is beyond the radius."""
    rng = np.random.default_rng(3)
    radius, beyond, pairs = decontaminate.radius_of(0.75), 0, 5000
    assert radius == 23 and decontaminate.radius_of(0.9) < radius
    for _ in range(pairs):
        n = int(rng.integers(20, 121))
        apart = n // 7  # the most that leaves the pair at the threshold
        shared = rng.integers(0, 2 ** 63, n - apart, dtype=np.uint64)
        a, b = (np.concatenate([shared, rng.integers(0, 2 ** 63, apart, dtype=np.uint64)]) for _ in range(2))
        assert len(shared) >= 0.75 * (n + apart)
        x, y = (decontaminate._packed(decontaminate._signed(s, np.ones(n, np.int32)).sum(axis=0, keepdims=True)) for s in (a, b))
        beyond += int(np.bitwise_count(x ^ y).sum()) > radius
    assert beyond <= 0.002 * pairs


def test_cut_and_shifted_copies():
    """Copies without some of their first, last or middle words, in the middle and at the ends of documents."""
    rng = random.Random(9)
    word = lambda: "v%d" % rng.randrange(4000)
    filler = lambda: [word() for _ in range(rng.randrange(0, 60))]
    items = [(k, " ".join(word() for _ in range(n))) for k, n in enumerate([16, 20, 31, 40, 59, 130] * 6)]
    items += [(36, items[3][1].replace(items[3][1].split()[0], "another")), (37, " ".join(["same"] * 30))]
    texts = []
    for i in range(600):
        leak = items[rng.randrange(len(items))][1].split()
        cut = rng.randrange(0, max(2, len(leak) // 8))
        kind = rng.randrange(4)
        leak = [leak[cut:], leak[:len(leak) - cut], leak[:9] + leak[9 + cut:], leak + leak[cut:]][kind]
        texts.append((i, " ".join(filler() * rng.randrange(2) + leak + filler() * rng.randrange(2))))
    texts += [(600, " ".join(["same"] * 70)), (601, " ".join(text for _, text in items)), (602, "")]
    index = decontaminate.ItemIndex([t.encode() for _, t in items], 0.75, 5)
    found = index.search([t.encode() for _, t in texts])
    want = brute(texts, items)
    assert len(want) > 400
    out = {(t, k): s for t, k, _, _, s in found}
    same({k: s for k, s in out.items() if k in want or s > 0.75 + 1e-9}, want)
    assert all(s > 0.75 - 2e-9 for s in out.values())  # brute force may sum what is 0.75 to a little less
    for t, k, start, n, similarity in found[::7]:
        window = words_of(texts[t][1])[start:start + n]
        alone = brute([(t, " ".join(window))], items)
        assert abs(alone.get((t, k), 0.75) - similarity) < 1e-9
