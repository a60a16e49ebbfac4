import zlib

import numpy as np
import pytest

from barloom.llm import packing, tokenids
from barloom.llm.registry import QUERIES, tokenizer_path

SMALL = "/root/testdata/sf0.001"
PATH = tokenizer_path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def model():
    from tokenizers import Tokenizer
    return Tokenizer.from_file(PATH)


def whole(model, text):
    return model.encode(text or "", add_special_tokens=False).ids


def test_pieces_give_the_ids_of_the_library(model, rows):
    coder = tokenids.PieceEncoder(PATH)
    rng = np.random.default_rng(3)
    signs = ["a", "B", " ", "  ", "\n", "\t", "'s", "1", ".", "é", " ", "\x1c", "<|endoftext|>", " ", "\r\n", "_"]
    texts = [t or "" for _, t in rows] + ["".join(rng.choice(signs, 12)) for _ in range(3000)]
    for text, ids in zip(texts, coder.encode(texts)):
        assert np.frombuffer(ids, "<u2").tolist() == whole(model, text), repr(text)


def check(pieces, texts, model, window):
    """Every id in one piece, pieces in gapless sequences, checksums right."""
    ids = {i: whole(model, t) + [0] for i, t in texts}
    seen, places = {}, {}
    for p in pieces:
        own = np.array(ids[p["doc_id"]][p["start"]:p["start"] + p["length"]], "<u4")
        assert p["doc_tokens"] == len(ids[p["doc_id"]]) and p["length"] == len(own) > 0
        assert p["ids_crc32"] == zlib.crc32(own.tobytes())
        seen.setdefault(p["doc_id"], []).append((p["start"], p["length"]))
        places.setdefault(p["sequence_id"], []).append((p["offset"], p["length"]))
    for i, some in seen.items():
        at = 0
        for start, n in sorted(some):
            assert start == at
            at += n
        assert at == len(ids[i])
    assert set(seen) == set(ids)
    assert sorted(places) == list(range(len(places)))
    for k, some in places.items():
        at = 0
        for offset, n in sorted(some):
            assert offset == at
            at += n
        assert at == window or k == len(places) - 1


def test_query_against_brute_force(spark, model):
    texts = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    out = QUERIES["op9_packing"](spark, SMALL)
    assert dict(out.dtypes)["ids_crc32"] == "bigint"
    check(out.collect(), texts, model, 1024)


def test_awkward_rows_and_sequences(spark, docs, rows, model):
    pieces = packing.pack(docs, PATH, window=16).cache()
    got = [r.asDict() | {"ids_crc32": zlib.crc32(r["ids"])} for r in pieces.collect()]
    check(got, rows, model, 16)
    total = sum(len(whole(model, t)) + 1 for _, t in rows)
    built = packing.sequences(pieces).orderBy("sequence_id").collect()
    assert sum(r["length"] for r in built) == total
    assert all(len(r["ids"]) == 4 * r["length"] for r in built)
    assert packing.pack(docs.limit(0), PATH).count() == 0
