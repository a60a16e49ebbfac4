from collections import defaultdict

from pyspark.sql import functions as F

from barloom.llm.linededup import dedup_lines


def brute(rows, min_chars, min_docs):
    key = lambda x: "".join(c.lower() if "A" <= c <= "Z" else c for c in x.strip(" \t\n\v\f\r"))
    holders = defaultdict(list)
    for i, text in rows:
        for k in {key(x) for x in (text or "").split("\n")}:
            if i is not None and len(k) >= min_chars:
                holders[k].append(i)
    keeper = {k: max(v) for k, v in holders.items() if len(set(v)) >= min_docs}
    out = []
    for i, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if i is None or keeper.get(key(x), i) == i]
        out.append((i, "\n".join(kept), len(lines), len(lines) - len(kept)))
    return sorted(out, key=repr)


def test_against_brute_force(spark, docs, rows):
    line = "  A line that many of the documents have in common É\t"
    more = [(i, f"{line}\nown {i}\n{line.upper()}\n\n{'short'}") for i in range(100, 106)]
    more += [(104, line.strip()), (None, line), (200, ("é" * 39 + "\n") * 2), (201, "é" * 40 + " ")]
    table = docs.unionByName(spark.createDataFrame(more, "doc_id long, text string"), allowMissingColumns=True)
    for chars, least in ((40, 5), (5, 2), (1, 1)):
        out = dedup_lines(table, chars, least)
        got = sorted([(r["doc_id"], r["text"], r["n_lines"], r["n_dropped"]) for r in out.collect()], key=repr)
        assert got == brute(rows + more, chars, least)
    assert [c for c in out.columns] == [*docs.columns, "n_lines", "n_dropped"]


def test_empty_table_and_clashing_columns(spark, docs):
    clash = docs.withColumn("n_lines", F.lit(1)).withColumn("hash", F.lit("x")).withColumn("dropped", F.lit("y"))
    assert dedup_lines(clash.limit(0)).count() == 0
    assert dedup_lines(clash).count() == docs.count()


def test_repeated_ids_are_one_document(spark):
    """Five rows of two documents are not five documents; five documents with repeats are."""
    few, many = "a line of more than forty code points in few", "a line of more than forty code points in many"
    rows = [(1, few), (1, few), (1, few + "\nx"), (2, few), (2, few)] + [(i, many) for i in (3, 4, 5, 6, 6, 7)]
    out = dedup_lines(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
    got = sorted((r["doc_id"], r["text"], r["n_lines"], r["n_dropped"]) for r in out.collect())
    assert got == brute(rows, 40, 5)
    assert sum(r[3] for r in got) == 5 and all(r[3] == 0 for r in got if r[0] < 3)


def test_columns_of_the_input_stay(spark, docs):
    odd = docs.withColumn("_id", F.lit("x")).withColumn("_dropped", F.lit("y")).withColumn("hash", F.lit("z"))
    out = dedup_lines(odd)
    assert out.columns == [*odd.columns, "n_lines", "n_dropped"]
    assert all((r["_id"], r["_dropped"], r["hash"]) == ("x", "y", "z") for r in out.collect())
