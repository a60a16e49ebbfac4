import math
import re
from pathlib import Path

import duckdb
import pytest

from barloom.llm import licenses
from barloom.llm.registry import ORACLES, QUERIES

SMALL = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def low(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def brute(text, threshold):
    words = WORD.findall(low(text))
    at, base = [], set()
    for phrase, label in licenses.PHRASES.items():
        parts = phrase.split()
        spots = [i for i in range(len(words)) if words[i:i + len(parts)] == parts]
        at += spots
        base |= {label} if spots else set()
    labels, best = set(base), 0.0
    lines = [WORD.findall(line) for line in low(text).split("\n")]
    for own in (set(sum(lines[i:i + n], [])) for n in (1, 2, 3) for i in range(len(lines) - n + 1)
                if n == 1 or all(lines[i:i + n])):
        for label, tokens in licenses.template_sets(licenses.TEMPLATES):
            both = len(own & set(tokens))
            if both >= math.ceil(threshold * len(tokens) - 1e-9):
                labels.add(label)
                best = max(best, both / len(tokens))
    return (len(words), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(base)), ",".join(sorted(labels)),
            1.0 if at else best)


COLUMNS = ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")


def test_query_against_oracle_and_brute_force(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SMALL}/documents.parquet'")
    columns = ("doc_id", *COLUMNS)
    want = sorted(con.sql(ORACLES["op5_license_scan"]).select(*columns).fetchall())
    out = QUERIES["op5_license_scan"](spark, SMALL).collect()
    assert sorted(tuple(r[c] for c in columns) for r in out) == want
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    assert all(tuple(r[c] for c in COLUMNS) == brute(texts[r["doc_id"]], 0.85) for r in out)


@pytest.mark.parametrize("threshold", [0.5, 0.85, 1.0])
def test_awkward_texts(spark, docs, rows, threshold):
    more = [(50, "Some words.\nReleased under the MIT License.\nmore"), (51, "ALL RIGHTS\nRESERVED, all rights reserved"),
            (52, "cc-by CC BY cc  by"), (53, "GNU General Public License, version 3; this work is licensed under the"),
            (54, "Licensed under the Apache License"), (55, "the License, in the License, in compliance with the License"),
            (56, "Kind of work K"), (57, "license " * 3000 + "\nall rights reserved copyright"), (57, None)]
    table = docs.unionByName(spark.createDataFrame(more, "doc_id long, text string"), allowMissingColumns=True)
    out = licenses.scan_licenses(table, threshold=threshold).collect()
    got = sorted((repr(r["doc_id"]), *map(repr, (r[c] for c in COLUMNS))) for r in out)
    assert got == sorted((repr(i), *map(repr, brute(t, threshold))) for i, t in rows + more)
    assert licenses.scan_licenses(docs.limit(0)).count() == 0


def wrapped(text, times, mark):
    words = text.split()
    cut = -(-len(words) // (times + 1))
    return "\n".join(mark + " ".join(words[i:i + cut]) for i in range(0, len(words), cut))


def test_wrapped_notices_are_found(spark):
    """Every template, wrapped once and twice, plain and behind comment marks, between other lines."""
    cases = [(label, wrapped(text, times, mark)) for label, text in licenses.TEMPLATES
             for times in (1, 2) for mark in ("", " * ", "# ", "// ")]
    table = spark.createDataFrame([(i, f"int main\n{text}\nsome other line") for i, (_, text) in enumerate(cases)],
                                  "doc_id long, text string")
    for r in licenses.scan_licenses(table).collect():
        label, text = cases[r["doc_id"]]
        assert label in r["labels"].split(",") and r["score"] == 1.0, text


def test_lines_without_words_part_blocks(spark):
    half, rest = "Redistribution and use in source and binary forms, with or without", "modification, are permitted"
    texts = [f"{half}\n{rest}", f"{half}\n#\n{rest}", f"{half}\n\n{rest}", f"{half}\nx\n{rest}", f"{half}\nx\ny\n{rest}"]
    out = licenses.scan_licenses(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    assert {r["doc_id"]: r["labels"] for r in out.collect()} == {0: "bsd", 1: "", 2: "", 3: "bsd", 4: ""}
    both = [(b["line"], b["lines"]) for r in out.where("doc_id = 3").collect() for b in r["blocks"]]
    assert both == [(0, 3)]


def test_main_path_has_no_python():
    text = Path(licenses.__file__).read_text()
    assert not re.search(r"udf|pandas|mapIn|applyIn|\.rdd", text)
