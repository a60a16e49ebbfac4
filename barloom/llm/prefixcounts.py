"""Exact token counts at every prefix of a text, by dynamic programming over prefixes.

A byte-pair encoding has one last token for every prefix of a word, and the tokens before it encode
the shorter prefix; a sequence of tokens is the encoding if and only if every pair of neighbours is
the encoding of its own text.  So the count at a prefix is one more than the count at the prefix
where its last token begins, and no prefix is ever encoded again.  Words end with a suffix that
belongs to their last symbol; a second table says what each prefix costs if the word ended there.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .arrow import ByteCache, slices, utf8, worker_cache
from .tokenids import byte_letters

#: Bytes of the caches of a worker process: counts of chunks and of words, and which tokens may stand side by side.
CHUNK_BYTES, WORD_BYTES, PAIR_BYTES = 125 << 20, 62 << 20, 63 << 20
LONG_CHUNK = 64
#: ASCII white space becomes a space, so that one split finds all chunks.
TO_SPACE = bytes(0x20 if b == 0x20 or 0x09 <= b <= 0x0D else b for b in range(256))


#: Latin letters that NFC and lower case turn into one letter each, then signs that are no letters, digits or apostrophes.
WORD_AND_SIGNS = re.compile(r"([A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u024f]*)([!-&(-/:-;=-@\[-`{}~]*)")
#: White space as Unicode has it, without the separators 1C to 1F that Python adds.
SPACE = re.compile(r"[^\S\x1c-\x1f]")


class PrefixCounter:
    """Token counts of a BPE model with word-end suffix of the ``tokenizers`` library."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        model = Tokenizer.from_file(path)
        self.normalise = model.normalizer.normalize_str if model.normalizer else str
        self.words_of = model.pre_tokenizer.pre_tokenize_str
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        bpe = spec["model"]
        self.suffix = bpe.get("end_of_word_suffix") or ""
        self.tokens = [t for t, _ in sorted(bpe["vocab"].items(), key=lambda x: x[1])]
        number = {t: i for i, t in enumerate(self.tokens)}
        # What tokens end with, without the suffix, so that the search for a prefix's last token knows
        # where to stop; for each the numbers of the token that is just this, open and with the suffix.
        self.tails: dict[str, tuple[int, int]] = {}
        for t in self.tokens:
            body = t[:-len(self.suffix)] if self.suffix and t.endswith(self.suffix) else t
            for k in range(len(body)):
                if (tail := body[k:]) not in self.tails:
                    self.tails[tail] = (number.get(tail, -1), number.get(tail + self.suffix, -1))
        self.letters = byte_letters()
        pairs = (tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in bpe["merges"])
        self.rank = {pair: i for i, pair in enumerate(pairs)}
        # whether the fast way below says the same as the model's own steps
        kinds = [x.get("type") for x in (spec.get("normalizer") or {}).get("normalizers", [])]
        pattern = str((spec["pre_tokenizer"].get("pretokenizers") or [{}])[0].get("pattern"))
        self.simple = kinds == ["NFC", "Replace", "Lowercase"] and "[\\\\p{L}]+|[\\\\p{N}]|[^\\\\s\\\\p{L}\\\\p{N}]+" in pattern
        added = [re.escape(t["content"]) for t in spec.get("added_tokens", [])]
        self.added = re.compile("(" + "|".join(added) + ")") if added else None
        self.agree = ByteCache(PAIR_BYTES)
        self.state: tuple[str, list[int], list[int], list[int]] = ("", [-1], [0], [0])
        self.lower = ByteCache(WORD_BYTES)
        self.chunks = ByteCache(CHUNK_BYTES)

    def _merged(self, symbols: list[str]) -> list[str]:
        """The encoding of a few symbols, by the merge rules as they are defined."""
        while len(symbols) > 1:
            best = min(zip(symbols, symbols[1:]), key=lambda p: self.rank.get(p, 1 << 60))
            if best not in self.rank:
                break
            out, i = [], 0
            while i < len(symbols):
                if i + 1 < len(symbols) and (symbols[i], symbols[i + 1]) == best:
                    out.append(symbols[i] + symbols[i + 1])
                    i += 2
                else:
                    out.append(symbols[i])
                    i += 1
            symbols = out
        return symbols

    def _symbols(self, token: str) -> list[str]:
        if self.suffix and token.endswith(self.suffix):
            body = token[:-len(self.suffix)]
            return [*body[:-1], body[-1] + self.suffix]
        return list(token)

    def _neighbours(self, left: int, right: int) -> bool:
        """Whether tokens ``left`` and ``right`` (alone: ``left`` -1) stay as they are beside each other."""
        key = (left + 1) << 32 | right
        known = self.agree.get(key)
        if known is None:
            a, b = self.tokens[left] if left >= 0 else "", self.tokens[right]
            known = self._merged([*a, *self._symbols(b)]) == ([a, b] if a else [b])
            self.agree.put(key, known)
        return known

    def word(self, word: str) -> list[int]:
        """Counts of the word's prefixes, each taken as a whole word; place 0 is the empty prefix.

        What the word before this one began with is not worked out again.
        """
        before, last, count, closed = self.state
        n, same = len(word), 0
        while same < n and same < len(before) and word[same] == before[same]:
            same += 1
        del last[same + 1:], count[same + 1:], closed[same + 1:]
        self.state = (word, last, count, closed)
        tails, agree, neighbours = self.tails.get, self.agree.young.get, self._neighbours
        for i in range(same + 1, n + 1):
            # going back from the prefix's end: the first token that agrees with what is before it, open and closed
            found = ends = -1
            for j in range(i - 1, -1, -1):
                if (ids := tails(word[j:i])) is None:
                    break
                number, with_suffix = ids
                if found < 0 and number >= 0:
                    good = agree((last[j] + 1) << 32 | number)
                    if neighbours(last[j], number) if good is None else good:
                        found, length = number, count[j] + 1
                        if ends >= 0:
                            break
                if ends < 0 and with_suffix >= 0:
                    good = agree((last[j] + 1) << 32 | with_suffix)
                    if neighbours(last[j], with_suffix) if good is None else good:
                        ends = count[j] + 1
                        if found >= 0:
                            break
            if found < 0 or ends < 0:
                self.state = ("", [-1], [0], [0])
                raise ValueError(f"no token ends at {i} of {word!r}")
            last.append(found)
            count.append(length)
            closed.append(ends)
        return closed.copy()

    def _lower(self, text: str) -> bytes:
        """Deltas of one word to the pre-tokenizer, lower-cased Latin letters or signs."""
        known = self.lower.get(text)
        if known is None:
            if text.isascii():
                marks = self.word(text)
            else:
                closed = self.word("".join([self.letters[b] for b in text.encode()]))
                marks, at = [0], 0
                for c in text:
                    at += len(c.encode())
                    marks.append(closed[at])
            known = bytes([(b - a) & 255 for a, b in zip(marks, marks[1:])])  # a chunk is short, so steps are within a byte
            self.lower.put(text, known)
        return known

    def _learn(self, chunks: set[bytes]) -> dict[bytes, bytes | np.ndarray]:
        """Deltas of chunks as signed bytes; as an array where a step is too large for them.  Latin words
        are worked out in order, so that neighbours share their prefixes."""
        simple, out = [], {}
        for raw in chunks:
            text = raw.decode()
            if self.simple and len(text) <= LONG_CHUNK and (m := WORD_AND_SIGNS.fullmatch(text)):
                simple.append((m[1].lower(), m[2], raw))
            else:
                steps = np.diff(np.array([0, *self._counts(text)], np.int64))
                narrow = steps.astype(np.int8)
                out[raw] = narrow.tobytes() if (narrow == steps).all() else steps
        for letters, signs, raw in sorted(simple):
            out[raw] = (self._lower(letters) if letters else b"") + (self._lower(signs) if signs else b"")
        for raw, known in out.items():
            if len(raw) <= LONG_CHUNK:
                self.chunks.put(raw, known)
        return out

    def _plain(self, text: str) -> list[int]:
        """Counts at the code points of a normalised text without added tokens."""
        counts, base, at = [], 0, 0
        for word, (start, end) in self.words_of(text):
            counts += [base] * (start - at)
            closed = self.word(word)
            if end - start == len(word):
                marks = closed[1:]
            else:  # one symbol per byte: keep the last byte of each code point
                sizes = np.cumsum([len(c.encode()) for c in text[start:end]])
                marks = [closed[k] for k in sizes]
            if 2 < end - start <= 3 and text[start] == "'":  # 'r is two words until 're is one
                marks[1] = sum(self.word(w)[-1] for w, _ in self.words_of(text[start:start + 2]))
            counts += [base + m for m in marks]
            base, at = base + closed[-1], end
        return counts + [base] * (len(text) - at)

    def _counts(self, chunk: str) -> list[int]:
        """Counts at the code points of a chunk as it stands in the text."""
        pieces = self.added.split(chunk) if self.added else [chunk]
        counts: list[int] = []
        base = 0
        for nth in range(0, len(pieces), 2):
            own = self._aligned(pieces[nth]) if pieces[nth] else []
            counts += [base + c for c in own]
            end = base + (own[-1] if own else 0)
            if nth + 1 < len(pieces):  # an added token: ordinary text until its last character
                partial = self._aligned(pieces[nth] + pieces[nth + 1])[len(own):-1]
                counts += [base + c for c in partial] + [end + 1]
            base = end + 1
        return counts

    def _aligned(self, raw: str) -> list[int]:
        text = self.normalise(raw)
        if raw.isascii() and len(text) == len(raw):
            return self._plain(text)
        groups: list[str] = []
        for c in raw:  # a cut inside a combining sequence counts as a cut before it
            if groups and (unicodedata.combining(c) or SPACE.match(c) and SPACE.match(groups[-1])):
                groups[-1] += c
            else:
                groups.append(c)
        forms = [self.normalise(g) for g in groups]
        if "".join(forms) != text:  # cannot be told apart: the chunk counts when it ends
            groups, forms = [raw], [text]
        sizes = list(map(len, forms))
        inner, out, at, before = self._plain(text), [], 0, 0
        for group, size in zip(groups, sizes):
            at += size
            after = inner[at - 1] if at else 0
            out += [before] * (len(group) - 1) + [after]
            before = after
        return out

    def deltas(self, texts: list[bytes]) -> list[tuple[bytes, int]]:
        """For each text (a signed little-endian number per code point, its bytes): by how much the count
        at that prefix exceeds the one before.  A byte is enough for nearly all texts; steps that do not
        fit into it, as where letters join over hundreds of code points, take four."""
        split = [text.translate(TO_SPACE).split(b" ") for text in texts]
        known = [list(map(self.chunks.young.get, parts)) for parts in split]
        new, old = set(), {}
        for parts, found in zip(split, known):
            if None in found:
                new.update([part for part, x in zip(parts, found) if x is None])
        for part in list(new):
            if (x := self.chunks.get(part)) is not None:
                old[part] = x
                new.discard(part)
        old |= self._learn(new)
        out = []
        for parts, found in zip(split, known):
            if None in found:
                found = [old[part] if x is None else x for part, x in zip(parts, found)]
            if all([type(x) is bytes for x in found]):
                out.append((b"\0".join(found), 1))
                continue
            arrays = [np.frombuffer(x, np.int8) if isinstance(x, bytes) else x for x in found]
            steps = np.concatenate([y for x in arrays for y in (x, np.zeros(1, np.int64))][:-1])
            out.append((steps.astype("<i4").tobytes(), 4))
        return out


def prefix_counts(docs: DataFrame, tokenizer: str) -> DataFrame:
    """(doc_id, n_bytes, deltas, width): the stored counts of every prefix of every whole text.

    The sum of the first k signed numbers of ``width`` bytes in ``deltas`` is the token count of the text's first k code
    points, without begin, end or added special tokens; special strings inside a text count as the
    library counts them.  A null text is empty and has no deltas.  Every row is a document, repeated
    or not; a null doc_id is carried along; other columns are not.  An empty table gives no rows.
    """
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = worker_cache(f"prefixes-{tokenizer}", lambda: PrefixCounter(tokenizer))
        for batch in slices(batches):
            texts = utf8(batch.column("text"))
            stored = counter.deltas(texts)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([len(t) for t in texts], pa.int64()),
                 pa.array([d for d, _ in stored], pa.binary()), pa.array([w for _, w in stored], pa.int32())],
                ["doc_id", "n_bytes", "deltas", "width"])

    return docs.select("doc_id", "text").mapInArrow(count, T.StructType(
        [docs.schema["doc_id"], T.StructField("n_bytes", T.LongType()), T.StructField("deltas", T.BinaryType()),
         T.StructField("width", T.IntegerType())]))


def answers(counts: DataFrame, budget: int, cut: int | None = None) -> DataFrame:
    """Truncation and budget questions from stored counts, without a tokenizer.

    Columns: doc_id, n_bytes, n_tokens, fit_chars (code points of the longest prefix of at most
    ``budget`` tokens) and, if ``cut`` is given, tokens_at_cut (tokens of the first ``cut`` code points).
    """
    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "deltas"):
            total, fit, at = [], [], []
            for raw, width in zip(batch.column("deltas").to_pylist(), batch.column("width").to_pylist()):
                running = np.cumsum(np.frombuffer(raw, f"<i{width}"), dtype=np.int64)
                total.append(int(running[-1]) if len(running) else 0)
                within = np.flatnonzero(running <= budget)
                fit.append(int(within[-1]) + 1 if len(within) else 0)
                at.append(int(running[min(cut, len(running)) - 1]) if cut and len(running) else 0)
            out = [batch.column("doc_id"), batch.column("n_bytes"), pa.array(total, pa.int64()), pa.array(fit, pa.int64())]
            if cut is not None:
                out.append(pa.array(at, pa.int64()))
            yield pa.RecordBatch.from_arrays(out, names)

    names = ["doc_id", "n_bytes", "n_tokens", "fit_chars"] + ["tokens_at_cut"] * (cut is not None)
    return counts.mapInArrow(answer, T.StructType(
        [counts.schema["doc_id"], *[T.StructField(c, T.LongType()) for c in names[1:]]]))
