import unicodedata

import numpy as np
import pytest

from barloom.llm import prefixcounts
from barloom.llm.registry import QUERIES, tokenizer_path

SMALL = "/root/testdata/sf0.001"
PATH = tokenizer_path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def model():
    from tokenizers import Tokenizer
    return Tokenizer.from_file(PATH)


def n(model, text):
    return len(model.encode(text, add_special_tokens=False).ids)


def prefixes(counter, text):
    raw, width = counter.deltas([text.encode()])[0]
    return np.cumsum(np.frombuffer(raw, f"<i{width}"), dtype=np.int64)


def test_every_prefix_of_odd_texts(model, rows):
    counter = prefixcounts.PrefixCounter(PATH)
    rng = np.random.default_rng(5)
    signs = ["a", "B", "th", "ing", " ", "  ", "\n", "'s", "'re", "'ll", "'", "1", "23", "...", "é", "É", "ß", "Σ", "日",
             "\U0001f600", "\xa0", "\x1c", "\x85", "<|endoftext|>", "_", "!!", "İ"]
    texts = [(t or "")[:400] for _, t in rows] + ["".join(rng.choice(signs, 9)) for _ in range(600)]
    for text in texts:
        counts = prefixes(counter, text)
        assert len(counts) == len(text)
        for k in range(1, len(text) + 1):
            if k == len(text) or not unicodedata.combining(text[k]):
                assert counts[k - 1] == n(model, text[:k]), repr(text[:k])


def test_combining_sequences_count_when_they_end(model):
    counter = prefixcounts.PrefixCounter(PATH)
    for text in ("été xé́y", "각 a", "ো b", "q̣̇z"):
        counts = prefixes(counter, text)
        assert counts[-1] == n(model, text)
        for k in range(1, len(text)):
            if not unicodedata.combining(text[k]) and text[k] == " ":
                assert counts[k - 1] == n(model, text[:k])


WIDE = [unicodedata.normalize("NFD", "\u00a0".join("한국어의글자는여러소리로나뉜다"[k % 11:] for k in range(60))), "a" + "\u0301" * 400,
        unicodedata.normalize("NFD", "\u00a0".join(["কোনো", "বৌদ্ধ", "লোকো"] * 90)), "b" + "\u0323\u0307" * 40_000, "x" * 90_000]


def test_steps_wider_than_a_byte(spark, model):
    """Letters that join over a whole chunk, and runs of marks, count at once when they end."""
    counter = prefixcounts.PrefixCounter(PATH)
    for text in WIDE + [f"so {t} and so on" for t in WIDE]:
        counts = prefixes(counter, text)
        assert len(counts) == len(text) and counts[-1] == n(model, text)
    df = spark.createDataFrame([(k % 3, t) for k, t in enumerate(WIDE)] + [(1, "plain")], "doc_id long, text string")
    out = prefixcounts.answers(prefixcounts.prefix_counts(df, PATH), 2048).collect()
    assert sorted(r["n_tokens"] for r in out) == sorted(n(model, t) for t in [*WIDE, "plain"])


def test_small_caches_change_nothing(model, monkeypatch):
    for name in ("CHUNK_BYTES", "WORD_BYTES", "PAIR_BYTES"):
        monkeypatch.setattr(prefixcounts, name, 4000)
    counter = prefixcounts.PrefixCounter(PATH)
    text = " ".join(f"word{k % 70} {chr(97 + k % 26)}bc{k}" for k in range(900))
    for _ in range(2):
        assert prefixes(counter, text)[-1] == n(model, text)
    assert len(counter.chunks.young) + len(counter.chunks.old) < 60


def test_query_against_brute_force(spark, model):
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    out = QUERIES["op4_token_counts"](spark, SMALL).collect()
    assert len(out) == len(texts)
    for r in out:
        text = texts[r["doc_id"]]
        total = n(model, text)
        assert (r["n_bytes"], r["n_tokens"], r["over_limit"]) == (len(text.encode()), total, total > 2048)
        assert r["fit_chars"] == len(text) if total <= 2048 else n(model, text[:r["fit_chars"]]) <= 2048


def test_awkward_rows(spark, docs, rows, model):
    counts = prefixcounts.prefix_counts(docs, PATH)
    out = prefixcounts.answers(counts, 4, cut=6).collect()
    want = sorted((repr(i), len((t or "").encode()), n(model, t or ""), n(model, (t or "")[:6])) for i, t in rows)
    assert sorted((repr(r["doc_id"]), r["n_bytes"], r["n_tokens"], r["tokens_at_cut"]) for r in out) == want
    assert prefixcounts.answers(prefixcounts.prefix_counts(docs.limit(0), PATH), 4).count() == 0
