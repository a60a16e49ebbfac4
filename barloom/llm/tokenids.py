"""Token ids of whole texts by a byte-level BPE of the ``tokenizers`` library, piece by piece.

The pre-tokenizer of such a model takes a run of white space up to its last character, joins this one
with what follows if it is a space, and parts letters from signs.  Texts are cut at such places, each
piece is encoded by the library and kept by the worker process, and the ids of a text are the pieces'
ids in a row: the same ids as for the text at once, several times faster, since words repeat.  The
pieces of a batch of texts are numbered and their ids taken by number, by Arrow, so that Python sees
a piece once a batch.  A new piece of Latin letters and signs behind them goes straight to the
library's model; any other piece goes through the whole of its pre-tokenizer.  Models of another kind
are given whole texts.
"""

from __future__ import annotations

import json
import os
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .arrow import ByteCache

#: Bytes of the pieces that a worker process keeps.
PIECE_BYTES = 128 << 20
LONG_PIECE = 48
#: Bytes of texts to encode at once: the more, the fewer pieces come up in several batches.
BATCH_BYTES = 8 << 20
#: Letters of the Latin blocks, then signs that are neither letters nor digits: two words to the pre-tokenizer.
WORD_AND_SIGNS = re.compile(r"([A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f]+)([!-&(-/:-@\[-`{-~]*)")
#: Kinds of bytes: letters, signs but the apostrophe, other bytes that surely are no white space (the first
#: bytes of some white space are left out, as are the separators 1C to 1F), the space, other white space.
LETTER, SIGN, SOLID, SPACE, BREAK = 1, 2, 3, 4, 5


def byte_letters() -> list[str]:
    """The letter by which byte-level models write each byte: printable bytes as themselves, the
    others as the letters from code point 256 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = iter(range(256, 512))
    return [chr(b if b in plain else next(rest)) for b in range(256)]


def byte_kinds(marks: list[str]) -> np.ndarray:
    """The kind of each byte, 0 for none.

    The library takes ``marks`` out of a text first, so their signs are parted from nothing and white
    space before what may begin one is left whole.
    """
    kinds = np.zeros(256, np.uint8)
    kinds[[*range(0x21, 0x7F), *range(0xC3, 0xE1), *range(0xE4, 0xF5)]] = SOLID
    kinds[[b for b in range(0x21, 0x7F) if not chr(b).isalnum() and chr(b) not in "'" + "".join(marks)]] = SIGN
    kinds[[b for b in range(0x80) if chr(b).isalpha()]] = LETTER
    kinds[range(0x09, 0x0E)] = BREAK
    kinds[0x20] = SPACE
    kinds[[t.encode()[0] for t in marks if t]] = 0
    return kinds


def cut_rules() -> np.ndarray:
    """By 8 * kind of a byte + kind of the next: 1 to cut before the two, 2 between them, 3 for both."""
    rules = np.zeros((32, 8), np.uint8)
    for solid in (LETTER, SIGN, SOLID):
        rules[SPACE, solid], rules[BREAK, solid] = 1, 3
    # a byte from 80 on may end a white space, so only ASCII parts from white space behind it
    for solid in (LETTER, SIGN):
        rules[solid, [SPACE, BREAK]] = 2
    rules[LETTER, SIGN] = rules[SIGN, LETTER] = 2
    return rules.ravel()


class PieceEncoder:
    """Texts to little-endian ids of ``width`` bytes."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        first = spec.get("pre_tokenizer") or {}
        added = spec.get("added_tokens") or []
        marks = [t["content"] for t in added]
        self.cuts = (first.get("type") == "ByteLevel" and first.get("use_regex") is True
                     and not first.get("add_prefix_space") and not spec.get("normalizer")
                     and not any(re.search(r"\s|^\w*$", t) for t in marks) and not any(t.get("lstrip") or t.get("rstrip") for t in added))
        self.kinds, self.rules = byte_kinds(marks).tobytes(), cut_rules().tobytes()
        self.kind = np.dtype("<u2" if self.model.get_vocab_size(True) <= 1 << 16 else "<u4")
        self.bpe = self.model.model
        self.packed = [x.tobytes() for x in np.arange(self.model.get_vocab_size(True)).astype(self.kind)]
        letters = byte_letters()
        self.spelled = {ord(c): "".join([letters[b] for b in c.encode()]) for c in [" ", *map(chr, range(0xC0, 0x250))]}
        self.kept = ByteCache(PIECE_BYTES)

    def _whole(self, text: str) -> bytes:
        return np.array(self.model.encode(text, add_special_tokens=False).ids, self.kind).tobytes()

    def _word(self, word: str) -> bytes:
        spelled = word.replace(" ", self.spelled[0x20]) if word.isascii() else word.translate(self.spelled)
        packed = self.packed
        return b"".join([packed[t.id] for t in self.bpe.tokenize(spelled)])

    def _piece(self, piece: str) -> bytes:
        ids = self.kept.get(piece)
        if ids is None:
            bare = piece[1:] if piece[0] == " " else piece
            if bare.isalpha() and bare.isascii():
                ids = self._word(piece)
            elif simple := WORD_AND_SIGNS.fullmatch(bare):
                n = len(piece) - len(simple[2])
                ids = self._piece(piece[:n]) + self._piece(simple[2]) if simple[2] else self._word(piece)
            else:
                ids = self._whole(piece)
            if len(piece) <= LONG_PIECE:
                self.kept.put(piece, ids)
        return ids

    def _cuts(self, data: bytes, starts: np.ndarray) -> np.ndarray:
        """Where the pieces of the texts that begin at ``starts`` begin in ``data``, and its end."""
        kinds = np.frombuffer(data.translate(self.kinds), np.uint8)
        pairs = kinds[:-1] * np.uint8(8) + kinds[1:]
        pairs[starts[(starts > 0) & (starts < len(data))] - 1] = 0  # of two texts
        rules = np.frombuffer(pairs.tobytes().translate(self.rules), np.uint8)
        cut = np.zeros(len(data) + 1, bool)
        cut[:-2] = rules & 1
        cut[1:-1] |= rules > 1
        cut[starts] = cut[-1] = True
        return np.flatnonzero(cut)

    def encode(self, texts: list[str] | pa.Array) -> list[bytes]:
        """Ids of each text; a null is an empty text."""
        column = pc.fill_null(texts.cast(pa.string()) if isinstance(texts, pa.Array) else pa.array(texts, pa.string()), "")
        if not self.cuts:
            return [self._whole(t) for t in column.to_pylist()]
        _, ends, data = column.buffers()
        ends = np.frombuffer(ends, np.int32)[column.offset:][:len(column) + 1] if len(column) else np.zeros(1, np.int32)
        if ends[0] == ends[-1]:
            return [b""] * len(column)
        data = data.slice(ends[0], ends[-1] - ends[0])
        ends = ends - ends[0]
        cuts = self._cuts(data.to_pybytes(), ends)
        pieces = pa.StringArray.from_buffers(len(cuts) - 1, pa.py_buffer(cuts.astype(np.int32)), data).dictionary_encode()
        distinct = pieces.dictionary.to_numpy(zero_copy_only=False).tolist()
        found = list(map(self.kept.young.get, distinct))
        for i in [i for i, ids in enumerate(found) if ids is None]:
            found[i] = self._piece(distinct[i])
        _, bounds, ids = pa.array(found, pa.binary()).take(pieces.indices).buffers()
        bounds = np.frombuffer(bounds, np.int32)[np.searchsorted(cuts, ends)].tolist()
        return [ids[a:b].to_pybytes() for a, b in zip(bounds, bounds[1:])]
