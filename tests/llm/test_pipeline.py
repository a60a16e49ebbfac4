import zlib

import numpy as np

import corpus_pipeline
import __spark_entry__ as entry

from test_decontaminate import brute as brute_leaks
from test_linededup import brute as brute_lines
from test_minhash import brute as brute_groups
from test_packing import check as check_pieces

from barloom.llm import quality
from barloom.llm.registry import tokenizer_path

FOLDER = "/root/testdata/sf0.01"


def cleaned(text):
    lines = (text or "").encode().split(b"\n")
    return b"\n".join(x for x in lines if not x.split() or quality.failed_rule(x) is None).decode()


def test_stages_against_brute_force(spark):
    from tokenizers import Tokenizer
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    columns = docs.columns
    verdicts = {r["doc_id"]: r["kept"] for r in quality.clean(docs).collect()}
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    rest = {i: cleaned(t) for i, t in texts.items() if verdicts[i]}
    bench = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, FOLDER).cache()
        if name == "line_dedup":
            rest = {i: t for i, t, _, _ in brute_lines(list(rest.items()), 40, 5)}
        elif name == "near_dedup":
            names = brute_groups(list(rest.items()))
            rest = {i: t for i, t in rest.items() if names[i][1] == i}
        elif name == "decontamination":
            leaks = brute_leaks(list(rest.items()), bench)
            rest = {i: t for i, t in rest.items() if i not in {d for d, _ in leaks}}
        rows = docs.collect()
        assert docs.columns == columns
        assert {r["doc_id"]: r["text"] for r in rows} == rest and len(rows) == len(rest)
        assert all(r["n_chars"] == len(r["text"]) for r in rows if name != "decontamination")
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, FOLDER).collect()
    check_pieces(pieces, list(rest.items()), Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json")), 1024)
    ran = entry.queries()["pipeline"](spark, FOLDER)
    assert ran.count() == len(pieces)
    assert {r["doc_id"] for r in ran.select("doc_id").collect()} == set(rest)


def test_awkward_rows(spark, docs, tmp_path):
    """Null and empty texts, repeats, rows without an id, extra columns, an empty table."""
    folder = str(tmp_path)
    spark.read.parquet(f"{FOLDER}/benchmark.parquet").write.parquet(f"{folder}/benchmark.parquet")
    for table, some in ((docs, True), (docs.limit(0), False)):
        rest = table.drop("kept")
        for _, stage in corpus_pipeline.STAGES[:-1]:
            rest = stage(spark, rest, folder)
            assert rest.columns == [c for c in docs.columns if c != "kept"]
        assert corpus_pipeline.STAGES[-1][1](spark, rest, folder).count() > 0 or not some


def test_result_holds_the_tokens_of_every_document(spark):
    """From the table that the pipeline returns the packed corpus can be read, and decoded again."""
    from tokenizers import Tokenizer
    model = Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json"))
    docs = spark.createDataFrame([(i, f"Document {i} has some words." * (1 + 200 * i)) for i in range(5)], "doc_id long, text string")
    rows = corpus_pipeline.STAGES[-1][1](spark, docs, FOLDER).collect()
    ids = {}
    for r in sorted(rows, key=lambda r: (r["doc_id"], r["start"])):
        own = np.frombuffer(r["ids"], "<u4")
        assert len(own) == r["length"] and zlib.crc32(own.tobytes()) == r["ids_crc32"]
        ids.setdefault(r["doc_id"], []).extend(own.tolist())
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert {i: model.decode(x[:-1], skip_special_tokens=False) for i, x in ids.items()} == texts
    assert all(x[-1] == 0 for x in ids.values())
