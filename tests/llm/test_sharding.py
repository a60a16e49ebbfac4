import hashlib
import math
import zlib
from collections import Counter, defaultdict

import pytest

from barloom.llm import sharding
from barloom.llm.registry import QUERIES

SMALL = "/root/testdata/sf0.01"


def brute_shard(doc_id, tree):
    key = "null" if doc_id is None else str(doc_id)

    def best(children):
        def cost(item):
            name, weight = item
            u = (int(hashlib.md5(f"{key}/{name}".encode()).hexdigest()[:13], 16) + 0.5) / 2 ** 52
            return -math.log(u) / weight
        return min(children.items(), key=cost)[0]

    total = defaultdict(float)
    for s in tree:
        total[s.region] += s.weight
    region = best(dict(total))
    racks = defaultdict(float)
    for s in tree:
        if s.region == region:
            racks[s.rack] += s.weight
    rack = best(dict(racks))
    return int(best({f"{rack}.s{s.number}": s.weight for s in tree if s.rack == rack}).rpartition(".s")[2])


def check(out, texts, tree):
    slots = defaultdict(list)
    for r in out:
        slots[r["shard"]].append((r["slot"], r["doc_id"]))
    assert sum(map(len, slots.values())) == len(texts)
    for some in slots.values():
        some.sort()
        assert [s for s, _ in some] == list(range(len(some)))
        ids = [-1 if i is None else i for _, i in some]
        assert ids == sorted(ids)
    want = sorted((repr(i), len((t or "").encode()) + 8, zlib.crc32((t or "").encode()), brute_shard(i, tree),
                   brute_shard(i, sharding.grown(tree))) for i, t in texts)
    assert sorted((repr(r["doc_id"]), r["size"], r["text_crc32"], r["shard"], r["grown_shard"]) for r in out) == want


def test_query_against_brute_force(spark):
    texts = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    out = QUERIES["op6_weighted_tree_sharding"](spark, SMALL).collect()
    check(out, texts, sharding.even_tree(3, 2, 4))
    assert all(r["law"] == "key" and r["grown_shard"] in (r["shard"], 24) for r in out)
    assert {r["shard"] for r in out} == set(range(24))
    assert 0 < sum(r["grown_shard"] == 24 for r in out) < 3 * len(out) / 25


def test_awkward_rows(spark, docs, rows):
    tree = sharding.even_tree(2, 1, 2)
    check(sharding.shard_documents(docs.union(docs), tree).collect(), rows * 2, tree)
    assert sharding.shard_documents(docs.limit(0), tree).count() == 0


@pytest.mark.parametrize("changed", [0, 5])
def test_weights_move_rows_of_their_subtree_only(spark, changed):
    """Shares follow the weights; a heavier shard takes rows, and nothing moves between others of its level."""
    tree = sharding.even_tree(2, 2, 2)
    heavy = [sharding.Shard(s.region, s.rack, s.number, 3.0 if s.number == changed else 1.0) for s in tree]
    ids = spark.range(20_000).select("id")
    key = ids["id"].cast("string")
    rows = sharding.descend(sharding.descend(ids, key, tree, "a"), key, heavy, "b").collect()
    share = Counter(r["b"] for r in rows)[changed] / len(rows)
    assert abs(share - 0.3) < 0.02
    region, rack = {s.number: s.region for s in tree}, {s.number: s.rack for s in tree}
    for r in rows:
        if r["a"] != r["b"]:  # into the heavier region, rack or shard, never between untouched subtrees
            assert region[r["b"]] == region[changed]
            assert region[r["a"]] != region[changed] or rack[r["b"]] == rack[changed]
            assert rack[r["a"]] != rack[changed] or r["b"] == changed
