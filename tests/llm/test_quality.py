import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from barloom.llm import quality
from barloom.llm.registry import QUERIES

SMALL = "/root/testdata/sf0.001"


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = Counter(tuple(words[i:i + 8]) for i in range(len(words) - 7))
    cover = {j for i in range(len(words) - 7) if windows[tuple(words[i:i + 8])] > 1 for j in range(i, i + 8)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)),
            len(cover), len(words) < 20 or 100 * len(cover) > 30 * len(words))


def base(r):
    return (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"])


def test_query_against_brute_force(spark):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    out = QUERIES["op10_quality_rules"](spark, SMALL).collect()
    assert sorted(r["doc_id"] for r in out) == sorted(texts)
    for r in out:
        assert base(r) == brute(texts[r["doc_id"]])
        assert not (r["base_failed"] and r["kept"])


def test_verdicts_follow_the_labels(spark):
    """Documents labelled good are kept unless the fixed base fails them; most of the others go."""
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    rows = QUERIES["op10_quality_rules"](spark, "/root/testdata/sf0.01").join(labels, "doc_id").collect()
    good = [r for r in rows if r["quality"] == 1 and not r["base_failed"]]
    bad = [r for r in rows if r["quality"] == 0]
    assert all(r["kept"] for r in good)
    assert sum(not r["kept"] for r in bad) > 0.7 * len(bad)


@pytest.mark.parametrize("line, rule", [
    ("Home | News | Sport | Contact us | Log in", "navigation"), ("We use cookies on this site.", "boilerplate"),
    ("x### y$$$ z%%% a&&&", "symbols"), ("THE QUICK BROWN FOX IS LOUD.", "shouting"), ("la " * 12 + ".", "repetition"),
    ("buy!! it!! now!!", "punctuation"), ("one two three four five six seven eight nine", "punctuation"),
    ("A plain sentence, with a mark.", None), ("A heading of nine words that has no mark", None), ("Short heading", None), ("", None), ("  ", None), ("\u00a0 \u2003", None),
    ("NASA and ESA met; a | b is fine.", None), ("Überall im Land wird viel über das Wetter geredet.", None)])
def test_line_rules(line, rule):
    assert quality.failed_rule(line.encode()) == rule


def test_awkward_rows(spark, docs, rows):
    for table in (docs, docs.withColumn("n_words", F.lit("x"))):
        out = quality.clean(table).collect()
        assert sorted((repr(r["doc_id"]), *base(r)) for r in out) == sorted((repr(i), *brute(t)) for i, t in rows)
    kept = quality.kept_documents(docs)
    assert set(kept.columns) == set(docs.columns) - {"kept"}
    assert quality.clean(docs.limit(0)).count() == 0


HINDI = "यह एक साफ वाक्य है जो बिना किसी बड़े अक्षर के लिखा गया है।"
WRAPPED = ["The river ran over the old stones and down to the valley,", "where the people of the town had built a mill, long ago,",
           "and on the other side of it a bridge that still stands", "and carries the road to the north. Few use it now."]


def test_lines_of_other_scripts_and_wrapped_prose(spark):
    urdu = "یہ ایک صاف جملہ ہے جو کسی بڑے حرف کے بغیر لکھا گیا ہے۔"
    for line in (HINDI, HINDI[:-1], urdu, urdu[:-1], "ይህ ያለ ትልቅ ፊደል የተጻፈ ንጹህ ዓረፍተ ነገር ነው እዚህ።", "այս նախադասությունը գրված է փոքր տառերով և ունի վերջակետ այստեղ։"):
        assert quality.failed_rule(line.encode()) is None, line
    junk = "cheap pills online best price fast shipping order today"
    assert quality.failed_lines([x.encode() for x in WRAPPED]) == [False] * 4
    assert quality.failed_lines([x.encode() for x in ["", junk, "", junk]]) == [False, True, False, True]
    assert quality.failed_lines([x.encode() for x in ["It ends here.", junk, junk, "Another one begins."]]) == [False, True, True, False]
    assert quality.failed_lines([x.encode() for x in [*WRAPPED, junk]])[4] and quality.failed_lines([]) == []
    texts = ["\n".join(WRAPPED), "\n".join(HINDI.replace("एक", f"{w} एक") for w in ("पहला", "दूसरा", "तीसरा", "चौथा"))[:-1]]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    out = quality.clean(docs).collect()
    assert {r["doc_id"]: (r["lost_words"], r["clean_text"]) for r in out} == {i: (0, t) for i, t in enumerate(texts)}
    assert {r["doc_id"] for r in out if r["kept"]} >= {0}


@pytest.mark.parametrize("line, rule", [
    ("JavaScript is a programming language.", None), ("The newsletter reached forty thousand readers in May.", None),
    ("He could not log in because the server was down.", None), ("Ereaes oftheshare onstor.", None),
    ("Please enable JavaScript to view this page.", "boilerplate"), ("Log in to your account", "boilerplate"),
    ("All rights reserved.", "boilerplate"), ("Copyright 2020 Some Firm Ltd. All rights reserved.", "boilerplate")])
def test_notices_are_more_than_a_word(line, rule):
    assert quality.failed_rule(line.encode()) == rule
