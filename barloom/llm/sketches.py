"""Document fingerprints: invertible Bloom lookup sketches of paragraph digests, in SQL functions alone.

A paragraph is a line; a line longer than 200 code points is cut behind the first end of a sentence
after them, and so on.  A text's digests are the hashes of its distinct paragraphs.  A sketch has 48
cells in three rows of 16; a digest adds itself to one cell of each row: a count, the XOR of the
digests and the XOR of their checks.  Sketches of two versions subtract cell by cell, what they share
cancels out, and peeling takes cells with one digest left until none is left, which recovers the
digests that only one version has.  Where cells stay filled the sketch was too small: both versions
are dealt out over four times as many sketches by another hash, and so on until all peel.

The next document is found by one move of the texts: documents go to cells of neighbouring ids, and
the first document of a cell is copied to the end of the cell before it.
"""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .store import stored

#: A paragraph, and the cells of a sketch: three rows of 16.
PARAGRAPH = r"[^\n]{200,}?[.!?](?=[ \n]|\z)|[^\n]+"
CELLS = 48
#: What peels from one sketch, nearly always; sizes that could not hold the difference are passed over.
ROOM = 32
LEVELS = 15
#: The first bit of the four that say a digest's cell in each row.
ROWS = (0, 4, 8)
#: Documents that one cell of neighbouring ids may hold.
CELL_ROWS = 256
_LOWEST = -(1 << 63)


# ---- sketches ----------------------------------------------------------------------------------
def _let(value: str, name: str, body: str) -> str:
    """SQL of ``body`` with ``name`` standing for ``value``, which is worked out once."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def digests_sql(text: str) -> str:
    """The hashes of a text's distinct paragraphs."""
    pattern = PARAGRAPH.replace("\\", "\\\\")
    return f"array_distinct(transform(regexp_extract_all({text}, '{pattern}', 0), paragraph -> xxhash64(paragraph)))"


def sketch_sql(digests: str, signed: bool = False) -> str:
    """The cells of some digests; a digest d belongs to a cell where its bits in mask m are w.

    ``signed``: of struct(d, n), with n = -1 for what is subtracted.
    """
    d, n = ("e.d", "e.n") if signed else ("e", "1")
    rows = [f"""transform(sequence(0L, {15 << bit}L, {1 << bit}L), w -> aggregate(filter(all_, e -> ({d} & {15 << bit}L) = w),
        named_struct('n', 0, 'x', 0L, 's', 0L, 'm', {15 << bit}L, 'w', w),
        (c, e) -> named_struct('n', c.n + {n}, 'x', c.x ^ {d}, 's', c.s ^ xxhash64({d}), 'm', c.m, 'w', c.w)))""" for bit in ROWS]
    return _let(digests, "all_", f"concat({', '.join(rows)})")


def less_sql(left: str, right: str) -> str:
    """The difference of two sketches."""
    return f"""zip_with({left}, {right}, (p, q) ->
        named_struct('n', p.n - q.n, 'x', p.x ^ q.x, 's', p.s ^ q.s, 'm', p.m, 'w', p.w))"""


def peel_sql(cells: str) -> str:
    """struct(ok, found): the digests left in the cells, d, each with n = 1 (left) or -1 (right);
    ok if nothing else is left."""
    pure = """array_distinct(transform(filter(st.cells, c -> abs(c.n) = 1 AND xxhash64(c.x) = c.s),
        c -> named_struct('d', c.x, 'n', c.n)))"""
    taken = """transform(st.cells, c -> aggregate(filter(pure, k -> (k.d & c.m) = c.w), c,
        (c, k) -> named_struct('n', c.n - k.n, 'x', c.x ^ k.d, 's', c.s ^ xxhash64(k.d), 'm', c.m, 'w', c.w)))"""
    step = _let(pure, "pure", f"""if(size(pure) = 0, named_struct('cells', st.cells, 'found', st.found, 'more', false),
        named_struct('cells', {taken}, 'found', concat(st.found, pure), 'more', true))""")
    start = f"""named_struct('cells', {cells}, 'found', CAST(array() AS array<struct<d: bigint, n: int>>), 'more', true)"""
    return f"""aggregate(sequence(1, {CELLS}), {start}, (st, turn) -> if(st.more, {step}, st),
        st -> named_struct('ok', forall(st.cells, c -> c.n = 0 AND c.x = 0 AND c.s = 0), 'found', st.found))"""


def difference_sql(left: str, right: str, left_sketch: str, right_sketch: str) -> str:
    """struct(ok, found) of two versions, all four columns: from their sketches, or from four times as
    many as long as that fails."""
    dealt = lambda side, n: f"transform({side}, d -> named_struct('d', d, 'n', {n}, 'b', pmod(xxhash64(d, level), shiftleft(1L, 2 * level))))"
    both = f"concat({dealt(left, 1)}, {dealt(right, -1)})"
    blocks = f"transform(sequence(0L, shiftleft(1L, 2 * level) - 1), block -> {peel_sql(sketch_sql('filter(both, e -> e.b = block)', signed=True))})"
    larger = _let(both, "both", _let(
        blocks, "peeled", "named_struct('ok', forall(peeled, p -> p.ok), 'found', flatten(transform(peeled, p -> p.found)))"))
    hopeless = f"shiftleft(1L, 2 * level) * {ROOM} < abs(size({left}) - size({right}))"
    return f"""aggregate(sequence(1, {LEVELS}), {peel_sql(less_sql(left_sketch, right_sketch))},
        (res, level) -> if(res.ok OR {hopeless}, res, {larger}))"""


def fingerprint_sql(sketch: str) -> str:
    """A sketch as text: count:digests:checks of each cell, in hex."""
    return f"array_join(transform({sketch}, c -> concat_ws(':', hex(c.n), hex(c.x), hex(c.s))), ' ')"


def likeness_sql(left: str, right: str, found: str) -> str:
    """What two sets share of their union, from their sizes and the size of their difference; 1 if both are empty."""
    total = f"(size({left}) + size({right}))"
    return f"if({total} = 0, 1.0D, ({total} - size({found})) / CAST({total} + size({found}) AS double))"


def compare(versions: DataFrame, left: str, right: str) -> DataFrame:
    """``versions`` with ``difference``: (only_left, only_right, likeness) of two text columns, from their sketches.

    Digests are hashes of paragraphs, each once however often it occurs; a null text is empty; two texts
    without paragraphs are alike.
    """
    sides = lambda n: f"transform(filter(_diff.found, f -> f.n = {n}), f -> f.d)"
    out = versions
    for side, column in (("_left", left), ("_right", right)):
        out = out.withColumn(side, F.expr(digests_sql(f"coalesce(`{column}`, '')")))
    for side in ("_left", "_right"):
        out = out.withColumn(f"{side}_sketch", F.expr(sketch_sql(side)))
    out = out.withColumn("_diff", F.expr(difference_sql("_left", "_right", "_left_sketch", "_right_sketch")))
    return out.select(*versions.columns, F.expr(f"""named_struct('only_left', {sides(1)}, 'only_right', {sides(-1)},
        'likeness', {likeness_sql('_left', '_right', '_diff.found')})""").alias("difference"))


# ---- the next document ---------------------------------------------------------------------------
def _order_key(docs: DataFrame) -> Column:
    """A long that orders as doc_id does (several ids of text may share one); the lowest for a null."""
    kind = docs.schema["doc_id"].dataType
    if isinstance(kind, (T.LongType, T.IntegerType, T.ShortType, T.ByteType)):
        key = F.col("doc_id").cast("long")
    elif isinstance(kind, T.StringType):  # seven bytes behind what all ids begin with
        low, high = docs.agg(F.min("doc_id"), F.max("doc_id")).first()
        same = len(os.path.commonprefix([(low or "").encode(), (high or "").encode()]))
        digits = F.substring(F.hex(F.encode("doc_id", "UTF-8")), 2 * same + 1, 14)
        key = F.conv(F.rpad(digits, 14, "0"), 16, 10).cast("long")
    else:
        raise TypeError("doc_id must be a number without a fraction or a string")
    return F.coalesce(key, F.lit(_LOWEST))


def _shift(keyed: DataFrame) -> int:
    """Bits that neighbouring ids may differ in so that no cell holds more than ``CELL_ROWS`` rows (0: one key a cell)."""
    counts = keyed.groupBy(F.shiftright("key", 2).alias("k")).agg(F.count(F.lit(1)).alias("n"))
    by_shift = counts.select(F.explode(F.sequence(F.lit(2), F.lit(60), F.lit(2))).alias("s"), "k", "n") \
        .groupBy("s", F.expr("shiftright(k, s - 2)").alias("cell")).agg(F.sum("n").alias("n")) \
        .groupBy("s").agg(F.max("n").alias("n")).where(F.col("n") <= CELL_ROWS)
    return by_shift.agg(F.max("s")).first()[0] or 0


def _copies(cells: DataFrame) -> DataFrame:
    """(top, cell): the greatest id of each cell and the cell before it in descending order, to which
    that document is copied; before the first cell comes the last."""
    cells = cells.withColumn("part", F.shiftright("cell", 12))
    above = cells.withColumn("above", F.lead("cell").over(Window.partitionBy("part").orderBy("cell")))
    # one row for some thousand cells
    parts = cells.groupBy("part").agg(F.min("cell").alias("lowest"))
    order = Window.orderBy("part")
    parts = parts.select("part", F.coalesce(F.lead("lowest").over(order), F.first("lowest").over(
        order.rowsBetween(Window.unboundedPreceding, Window.currentRow))).alias("beyond"))
    return above.join(parts, "part").select("top", F.coalesce("above", "beyond").alias("cell"))


def with_next(docs: DataFrame) -> DataFrame:
    """(doc_id, text, next_text): every document with the text of the next one in descending doc_id;
    after the last comes the first.

    Null texts are empty; null ids come last; rows of one id are ordered by their texts and lie in one
    cell.  One document alone is its own next one.  Each text moves once, and those at the head of a cell twice.
    """
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), _order_key(docs).alias("key"))
    shift = _shift(rows.select("key"))
    rows = rows.select("doc_id", "text", F.shiftright("key", shift).alias("cell"))
    # written, so that Spark knows the size before it plans the join
    copies = stored(_copies(rows.groupBy("cell").agg(F.max("doc_id").alias("top"))), "cells")
    heads = rows.drop("cell").join(copies, F.col("doc_id").eqNullSafe(F.col("top"))).select("doc_id", "text", "cell", F.lit(True).alias("head"))
    order = Window.partitionBy("cell").orderBy("head", F.col("doc_id").desc_nulls_last(), "text")
    return rows.withColumn("head", F.lit(False)).unionByName(heads) \
        .withColumn("next_text", F.lead("text").over(order)).where(~F.col("head")).select("doc_id", "text", "next_text")


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, n_chars, edited_text, fingerprint, edited_fingerprint, near_edited, near_next, n_edited, n_next).

    The edited text is the text with its last floor(n_chars / 2) code points replaced by the first as
    many, or all, of the next document's (see ``with_next``).  ``near_*`` is the likeness of the text's
    fingerprint to that of the edited text and of the next document: what the sets of paragraphs share
    of their union, from the digests that peeling recovers (``n_*``: how many); equal sets have 1, also
    empty ones.  Every row is a document, repeated or not; other columns are ignored; an empty table
    gives no rows.
    """
    half = F.expr("CAST(n_chars div 2 AS int)")
    rows = with_next(docs).withColumn("n_chars", F.char_length("text").cast("long"))
    rows = rows.select("doc_id", "n_chars", "text", "next_text",
                       F.concat(F.left("text", F.col("n_chars").cast("int") - half), F.left("next_text", half)).alias("edited_text"))
    texts = {"own": "text", "edited": "edited_text", "next": "next_text"}
    # a step for each of these, so that the parts that the next one reads more than once are worked out once
    for version, text in texts.items():
        rows = rows.withColumn(version, F.expr(digests_sql(text)))
    rows = rows.drop("text", "next_text").withColumns({f"s_{v}": F.expr(sketch_sql(v)) for v in texts})
    rows = rows.withColumns({f"d_{v}": F.expr(difference_sql("own", v, "s_own", f"s_{v}")) for v in ("edited", "next")})
    near = {f"near_{v}": F.expr(likeness_sql("own", v, f"d_{v}.found")) for v in ("edited", "next")}
    count = {f"n_{v}": F.size(f"d_{v}.found").cast("long") for v in ("edited", "next")}
    return rows.select(
        "doc_id", "n_chars", "edited_text", F.expr(fingerprint_sql("s_own")).alias("fingerprint"),
        F.expr(fingerprint_sql("s_edited")).alias("edited_fingerprint"), *[c.alias(n) for n, c in {**near, **count}.items()])
