import numpy as np
import pytest

from barloom.llm import binary
from barloom.llm.registry import QUERIES, tokenizer_path

SMALL = "/root/testdata/sf0.001"
PATH = tokenizer_path("byte_bpe_50k.json")


@pytest.mark.parametrize("total", [1, 2, 3, 7, 64, 1000, 65_537])
def test_permutation_is_a_bijection(total):
    slots = binary.permute(np.arange(total), total, key=5)
    assert sorted(slots) == list(range(total))
    assert (binary.permute(slots, total, key=5, back=True) == np.arange(total)).all()
    if total >= 1000:
        assert (slots != binary.permute(np.arange(total), total, key=6)).mean() > 0.9
        assert abs(np.corrcoef(slots, np.arange(total))[0, 1]) < 0.1


def round_trip(table, texts, length, per_shard):
    """Every id of every document stands once in the shards, padded, in dense slots."""
    from tokenizers import Tokenizer
    model = Tokenizer.from_file(PATH)
    want = sorted((repr(i), model.encode(t or "", add_special_tokens=False).ids + [50256]) for i, t in texts)
    rows = table.orderBy("shard").collect()
    slot, docs = 0, {}
    for nth, r in enumerate(rows):
        assert (r["shard"], r["first_slot"]) == (nth, slot)
        assert r["n_sequences"] == per_shard or nth == len(rows) - 1
        slot += r["n_sequences"]
        block = np.frombuffer(r["payload"], "<u2").reshape(-1, length)
        assert len(block) == r["n_sequences"]
        for ids, i, k, n in zip(block, r["doc_ids"], r["nths"], r["n_tokens"]):
            assert (ids[n:] == 50256).all()
            docs.setdefault(repr(i), []).append((k, ids[:n].tolist()))
    got = sorted((i, sum((x for _, x in sorted(some)), [])) for i, some in docs.items())
    assert got == want
    return slot


def test_query_against_brute_force(spark):
    texts = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    round_trip(QUERIES["op1_token_binary_output"](spark, SMALL), texts, 512, 256)


def test_awkward_rows_and_resuming(spark, docs, rows, tmp_path):
    table = binary.materialise_order(docs, PATH, length=8, per_shard=16)
    path = str(tmp_path / "shards")
    binary.write_shards(table, path)
    total = round_trip(spark.read.parquet(path), rows, 8, 16)
    every = binary.read_slots(spark, path, 0, total, 8, 16)
    assert len(every) == total
    for first in (5, 16, total - 3):
        some = binary.read_slots(spark, path, first, 40, 8, 16)
        assert [x.tolist() for x in some] == [x.tolist() for x in every[first:first + 40]]
    assert binary.materialise_order(docs.limit(0), PATH).count() == 0


def test_string_ids(spark, docs, rows):
    named = docs.withColumn("doc_id", docs["doc_id"].cast("string"))
    round_trip(binary.materialise_order(named, PATH, length=8, per_shard=16),
               [(None if i is None else str(i), t) for i, t in rows], 8, 16)
