"""Quality rules, lines first: lines that fail a rule go, then documents that lost too much text.

The line rules look for what running text does not do, and leave a line alone when in doubt:

* navigation: three or more separators (``|``, ``»``, ``>`` …) between few words each;
* boilerplate: notices of web pages (cookies, scripts, log in, share) in short lines, two of them or
  one with hardly any words that notices do not have;
* symbols: over a tenth of the characters are ``#*$%&|<>{}=~``;
* shouting: over seven tenths of the letters A-Z are capitals, in a line of five words or more;
* repetition: ten words or more, under three tenths of them different;
* punctuation: eight words or more whose first letter is a small one and that have no sentence mark of
  any script, or every third word with a double exclamation mark.  Scripts without case never fail
  this, nor do such lines within a paragraph that stand between a line whose sentence is open and one
  with a mark, as in wrapped prose.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .arrow import segment_ids, slices, utf8
from .wordhash import hashed_words, shingles

SEPARATORS = re.compile(r"(?:^|\s)(?:\||»|›|>|•|·|/)(?=\s|$)")
BOILERPLATE = re.compile(
    r"\b(?:cookie(?:s| policy)\b|java ?script\b|lorem ipsum|privacy policy|terms of (?:use|service)|sign (?:in|up)\b|log ?in\b"
    r"|subscribe (?:now|to)\b|newsletter|share (?:this|on)\b|follow us\b|read more\b|click here|back to top|skip to content"
    r"|all rights reserved|powered by|copyright)|©", re.I)
#: Words that notices have besides their signs.
NOTICE_FILLERS = frozenset(
    "a accept account agree all an and any at be browser by can continue enable for free from get have here if in is it join "
    "main more must navigation new no not now of on or our out page please register required see site the this to turn up us use "
    "uses using view visit we website with you your".split())
#: Ends of sentences and clauses in any script; Unicode's sentence terminals, quotes and brackets.
ENDS = ".!?…。！？｡．։՜՞؟۔܀܁܂߹।॥၊။።፧፨᙮᠃᠉។៕᥄᥅᪨᪩᭚᭛᭞᭟᰻᰼᱾᱿‼‽⁇⁈⁉⸮꓿꘎꘏꛳꛷꡶꡷꣎꣏꤯꧈꧉꩝꩞꩟꫰꫱꯫﹒﹖﹗"
CLOSERS = "\"'”’»)]"
SENTENCE_MARK = re.compile("[" + re.escape(ENDS + CLOSERS) + ":;؛]")
BASE_SYMBOLS = b"#*$%&|<>"
SYMBOLS = b"#*$%&|<>{}=~"
CAPITALS = bytes(range(ord("A"), ord("Z") + 1))
LETTERS = CAPITALS + CAPITALS.lower()
NOTICE_WORDS = 12
REPEAT_WINDOW = 8


def failed_rule(line: bytes) -> str | None:
    """The first rule that the line fails; a line without words fails none."""
    words = line.split()
    n = len(words)
    if not n:
        return None
    text = line.decode()
    if b"|" in line or not line.isascii() or b">" in line or b"/" in line:
        marks = len(SEPARATORS.findall(text))
        if marks >= 3 and 6 * marks >= n - marks:
            return "navigation"
    if n <= NOTICE_WORDS and BOILERPLATE.search(text) and _is_notice(text):
        return "boilerplate"
    if 10 * sum(map(line.count, map(bytes, zip(SYMBOLS)))) > len(text):
        return "symbols"
    if n >= 5:
        capitals = len(line) - len(line.translate(None, CAPITALS))
        if 10 * capitals > 7 * (len(line) - len(line.translate(None, LETTERS))):
            return "shouting"
    if n >= 10 and 10 * len(set(words)) < 3 * n:
        return "repetition"
    if n >= 3 and 3 * text.count("!!") >= n:
        return "punctuation"
    if n >= 8 and _unmarked(text):
        return "punctuation"
    return None


def _is_notice(text: str) -> bool:
    """Whether a line with a sign of boilerplate has another one, or one word at most that is not of notices."""
    if len({x.lower() for x in BOILERPLATE.findall(text)}) > 1:
        return True
    others = re.findall(r"[^\W\d_]+", BOILERPLATE.sub(" ", text).lower())
    return sum(w not in NOTICE_FILLERS for w in others) <= 1


def _unmarked(text: str) -> bool:
    """Whether the first letter or digit is a small letter and no mark of a sentence follows."""
    return next((c for c in text if c.isalnum()), "").islower() and not SENTENCE_MARK.search(text)


def failed_lines(lines: list[bytes]) -> list[bool]:
    """For each line of a text whether it fails a rule, where it stands."""
    rules = [failed_rule(line) for line in lines]
    failed = [rule is not None for rule in rules]
    nth = 0
    while nth < len(lines):
        begin = end = nth
        while end < len(lines) and rules[end] == "punctuation" and _unmarked(lines[end].decode()):
            end += 1
        if 0 < begin < end < len(lines) and not failed[begin - 1] and not failed[end]:
            before, after = lines[begin - 1].decode().rstrip(), lines[end].decode()
            if before and before.rstrip(CLOSERS)[-1:] not in ENDS and SENTENCE_MARK.search(after):
                failed[begin:end] = [False] * (end - begin)
        nth = max(end, begin + 1)
    return failed


def repeated_words(texts: list[bytes], width: int = REPEAT_WINDOW) -> list[int]:
    """Per text: words that stand in a window of ``width`` words found twice or more in the text."""
    out: list[int] = []
    for _, counts, words in hashed_words(texts, fold=False):
        n, hashes = shingles(counts, words, width, short=False)
        text = segment_ids(n)
        order = np.lexsort((hashes, text))
        same = (hashes[order][1:] == hashes[order][:-1]) & (text[order][1:] == text[order][:-1])
        twice = np.zeros(len(hashes), bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        first = np.cumsum(counts) - counts
        start = first[text] + np.arange(len(hashes)) - (np.cumsum(n) - n)[text]
        cover = np.zeros(len(words) + 1, np.int64)
        np.add.at(cover, start[twice], 1)
        np.add.at(cover, start[twice] + width, -1)
        covered = np.cumsum(cover)[:-1] > 0
        out += np.bincount(segment_ids(counts)[covered], minlength=len(counts)).tolist()
    return out


def clean(docs: DataFrame, max_lost: float = 0.5) -> DataFrame:
    """All columns of ``docs`` plus measures and verdicts; ``text`` stays, ``clean_text`` has the lines that pass.

    Added: n_words, word_chars (code points in words), n_symbols (``#*$%&|<>``), n_dup_lines (lines
    with a word, equal to an earlier line), n_repeat_words, base_failed (under 20 words, or over 30 %
    of them repeated), lost_words (words in failed lines), kept, clean_text.  A document is kept if it
    is not ``base_failed`` and lost at most ``max_lost`` of its words.  A null or empty text has no
    words and fails.  Each row is judged by itself, so repeated rows get the same verdict; columns of
    the added names in the input are replaced; an empty table gives an empty table.
    """
    added = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "lost_words",
             "kept", "clean_text"]
    base = docs.drop(*added)
    names = [*base.columns, *added]

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = utf8(batch.column("text"))
            rows = []
            for text, repeats in zip(texts, repeated_words(texts)):
                words = text.split()
                chars = sum(map(len, words)) if text.isascii() else len(b"".join(words).decode())
                seen: set[bytes] = set()
                same = lost = 0
                passed = []
                lines = text.split(b"\n")
                for line, fails in zip(lines, failed_lines(lines)):
                    size = len(line.split())
                    if size:
                        same += line in seen
                        seen.add(line)
                        if fails:
                            lost += size
                            continue
                    passed.append(line)
                failed = len(words) < 20 or 100 * repeats > 30 * len(words)
                rows.append((len(words), chars, sum(map(text.count, map(bytes, zip(BASE_SYMBOLS)))), same, repeats, failed,
                             lost, not failed and lost <= max_lost * len(words), b"\n".join(passed)))
            columns = [pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)]
            columns[-1] = columns[-1].cast(pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], names)

    kinds = [*[pa.int64()] * 5, pa.bool_(), pa.int64(), pa.bool_(), pa.binary()]
    types = [*[T.LongType()] * 5, T.BooleanType(), T.LongType(), T.BooleanType(), T.StringType()]
    return base.mapInArrow(judge, T.StructType([*base.schema.fields, *map(T.StructField, added, types)]))


def kept_documents(docs: DataFrame, max_lost: float = 0.5) -> DataFrame:
    """The kept documents with the columns of ``docs``; ``text`` is what is left of it."""
    out = clean(docs.withColumnRenamed("kept", "_own_kept") if "kept" in docs.columns else docs, max_lost)
    return out.where("kept").select(*[F.col("clean_text" if c == "text" else c).alias(c) for c in docs.columns if c != "kept"])
