"""License scans: an exact set-similarity join of text blocks with license templates.

Tokens are ordered by how many documents hold them, rarest first.  A block that has a share of
``threshold`` of a template's tokens has one of the template's first few tokens in that order
(prefix filter), has enough template tokens at all (length filter), and has enough of them left from
the first common one on (positional filter).  What passes is counted exactly.  Blocks are lines and
windows of two and three neighbouring lines, so that a notice wrapped twice is one block; a line
without words ends a window.  Comment marks are no words and play no part.  All in DataFrame functions.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words of lower-cased texts: runs of digits, a-z and everything that is not ASCII.
WORD = "[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"

# Phrases and labels of the base scan.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

#: Sentences of public license notices, by label.
TEMPLATES = [
    ("apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("apache-2.0", "you may not use this file except in compliance with the License"),
    ("mit", "Released under the MIT License"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software"),
    ("gpl", "This work is licensed under the GNU General Public License, version 3"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU "
            "General Public License"),
    ("lgpl", "under the terms of the GNU Lesser General Public License"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted"),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("cc-by", "Licensed under CC BY 4.0"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    ("cc-by-sa", "licensed under a Creative Commons Attribution-ShareAlike License"),
    ("unlicense", "This is free and unencumbered software released into the public domain"),
    ("reserved", "Copyright All rights reserved"),
]


def template_sets(templates: list[tuple[str, str]]) -> list[tuple[str, list[str]]]:
    return [(label, list(dict.fromkeys(re.findall(WORD, text.lower())))) for label, text in templates]


def _strings(values: list[str]) -> Column:
    return F.array(*map(F.lit, values)) if values else F.array().cast("array<string>")


def token_order(words: DataFrame, vocabulary: list[str]) -> list[str]:
    """The templates' tokens, those in fewest documents first, ties by the token.

    Counted over all documents and summed before the shuffle; what comes to the driver is a row for
    each token of the templates, whatever the corpus.
    """
    counts = words.select(F.explode(F.array_intersect("words", _strings(vocabulary))).alias("token")) \
        .groupBy("token").count().collect()
    found = {r["token"]: r["count"] for r in counts}
    return sorted(vocabulary, key=lambda t: (found.get(t, 0), t))


def _places(first: str, rest: list[str]) -> Column:
    """Starts of a phrase in ``words``."""
    def start(word: Column, i: Column) -> Column:
        here = word == first
        for k, other in enumerate(rest, 1):
            here = here & (F.get(F.col("words"), i + k) == other)
        return F.when(here, i)

    return F.filter(F.transform("words", start), lambda x: x.isNotNull())


def _blocks(order: list[str], least: int, max_lines: int) -> Column:
    """Blocks (line, lines, tokens) of the column ``lines`` (n_words, tokens) that hold ``least`` template tokens.

    A window counts only where its first and last line hold template tokens; any other has the tokens
    of a shorter one.
    """
    def begins(x: Column, i: Column) -> Column:
        line = [x, *[F.get(F.col("lines"), i + k) for k in range(1, max_lines)]]
        out, whole, tokens = [F.struct(i.alias("line"), F.lit(1).alias("lines"), x["tokens"].alias("tokens"))], F.lit(True), x["tokens"]
        for k in range(1, max_lines):
            tokens = F.concat(tokens, line[k]["tokens"])
            out.append(F.when(whole & (F.size(line[k]["tokens"]) > 0), F.struct(
                i.alias("line"), F.lit(k + 1).alias("lines"), F.array_intersect(_strings(order), tokens).alias("tokens"))))
            whole = whole & (line[k]["n_words"] > 0)
        return F.when(F.size(x["tokens"]) > 0, F.filter(F.array(*out), lambda b: F.size(b["tokens"]) >= least))

    return F.flatten(F.array_compact(F.transform("lines", begins)))


def scan_licenses(docs: DataFrame, templates: list[tuple[str, str]] | None = None, threshold: float = 0.85,
                  max_lines: int = 3) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, blocks) for every row.

    Words are those of the whole text with A-Z lower-cased.  Base: all places where a phrase's words
    stand one after another; their number, least and largest start, and labels.  ``labels`` adds those
    of templates of which a block has at least ``threshold`` of the tokens; a block is a line, or a window
    of up to ``max_lines`` neighbouring lines that each hold a word.  ``blocks`` has the first lines
    (from 0), numbers of lines, labels and shares; ``score`` is the largest share, 1 where a base phrase
    stands.  A null
    text is empty; equal rows give equal results; other columns are not carried; an empty table gives
    no rows.  Lower-casing touches letters beyond A-Z as well, which changes neither where words begin
    and end nor what equals a phrase: only the Kelvin sign becomes a letter a-z, a k, and no phrase has one.
    """
    sets = template_sets(templates or TEMPLATES)
    lower = F.lower(F.coalesce(F.col("text"), F.lit("")))
    words = docs.select("doc_id", lower.alias("text"),
                        F.regexp_extract_all(lower, F.lit(f"({WORD})"), F.lit(1)).alias("words"))
    vocabulary = sorted({t for _, tokens in sets for t in tokens})
    order = token_order(words, vocabulary)
    rank = {t: i for i, t in enumerate(order)}
    ordered = [(label, sorted(tokens, key=rank.get)) for label, tokens in sets]
    needs = [math.ceil(threshold * len(tokens) - 1e-9) for _, tokens in ordered]
    index = [(token, nth, place) for nth, (_, tokens) in enumerate(ordered)
             for place, token in enumerate(tokens[:len(tokens) - needs[nth] + 1])]
    prefix = sorted({t for t, _, _ in index}, key=rank.get)

    def places(phrase: str) -> Column:
        first, *rest = phrase.split()
        none = F.array().cast("array<int>")
        return F.when(F.array_contains("words", first), _places(first, rest)).otherwise(none)

    base = words.select(
        "*", F.monotonically_increasing_id().alias("row"), F.size("words").cast("long").alias("n_words"),
        *[places(p).alias(f"at{i}") for i, p in enumerate(PHRASES)])
    spots = F.concat(*[F.col(f"at{i}") for i in range(len(PHRASES))])
    found = F.array_compact(F.array(*[F.when(F.size(f"at{i}") > 0, label) for i, label in enumerate(PHRASES.values())]))
    # a line's template tokens in the global order: what is common to the ordered vocabulary and the line
    line = lambda own: F.struct(F.size(own).alias("n_words"), F.array_intersect(_strings(order), own).alias("tokens"))
    lines = F.transform(F.split("text", "\n"), lambda x: line(F.regexp_extract_all(x, F.lit(f"({WORD})"), F.lit(1))))
    has_any = F.arrays_overlap("words", _strings(prefix))
    facts_of = base.select(
        "row", "doc_id", "n_words", F.size(spots).cast("long").alias("n_base"), F.array_min(spots).cast("long").alias("first_word"),
        F.array_max(spots).cast("long").alias("last_word"), F.array_distinct(found).alias("_base"),
        F.when(has_any, lines).alias("lines"))
    keep = ["row", "doc_id", "n_words", "n_base", "first_word", "last_word", "_base"]
    rows = facts_of.select(*keep, F.explode_outer(_blocks(order, min(needs), max_lines)).alias("b")).select(*keep, "b.*")
    tokens = rows.withColumn("token", F.explode_outer(F.array_intersect("tokens", _strings(prefix))))
    postings = docs.sparkSession.range(1).select(F.explode(F.array(*[
        F.struct(F.lit(t).alias("token"), F.lit(n).alias("nth"), F.lit(p).alias("place")) for t, n, p in index])).alias("x")) \
        .select("x.*")
    facts = F.array(*[F.struct(F.lit(label).alias("label"), _strings(tokens).alias("tokens"), F.lit(need).alias("need"))
                      for (label, tokens), need in zip(ordered, needs)])
    joined = tokens.join(F.broadcast(postings), "token", "left").withColumn("t", F.get(facts, F.col("nth")))
    left = F.least(F.size("t.tokens") - F.col("place"),
                   F.size("tokens") - F.array_position("tokens", F.col("token")).cast("int") + 1)
    passes = (F.size("tokens") >= F.col("t.need")) & (left >= F.col("t.need"))
    share = F.when(passes, F.size(F.array_intersect("tokens", "t.tokens")) / F.size("t.tokens"))
    hit = F.when(share * F.size("t.tokens") + 1e-6 >= F.col("t.need"),
                 F.struct("line", "lines", F.col("t.label").alias("label"), share.alias("share")))
    grouped = joined.groupBy("row").agg(*[F.first(c).alias(c) for c in keep[1:]], F.collect_set(hit).alias("blocks"))
    labels = F.array_sort(F.array_distinct(F.concat("_base", F.transform("blocks", lambda b: b["label"]))))
    best = F.coalesce(F.array_max(F.transform("blocks", lambda b: b["share"])), F.lit(0.0))
    return grouped.select(
        "doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join(F.array_sort("_base"), ",").alias("base_labels"),
        F.array_join(labels, ",").alias("labels"), F.when(F.col("n_base") > 0, 1.0).otherwise(best).alias("score"), "blocks")
