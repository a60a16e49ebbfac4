import numpy as np
import pyarrow as pa
import pytest

from barloom.llm import tokenids
from barloom.llm.registry import tokenizer_path

PATH = tokenizer_path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def coder():
    return tokenids.PieceEncoder(PATH)


def ids(coder, texts):
    return [np.frombuffer(x, "<u2").tolist() for x in coder.encode(texts)]


def test_a_line_break_behind_a_space_is_not_lost(coder):
    texts = ["bar", "a \nbar", "a \n\nbar \n", "bar\n \nbar"]
    for _ in range(2):
        assert ids(coder, texts) == [coder.model.encode(t).ids for t in texts]


def test_neighbouring_texts_and_nulls_of_a_slice(coder):
    texts = ["skipped", None, "one\n\n", "two  ", "", "<|endoftext|>", "\n\n<|endoftext|> three", None, "\n", "four."]
    column = pa.array(texts, pa.string()).slice(1)
    assert ids(coder, column) == [coder.model.encode(t or "").ids for t in texts[1:]]
    assert ids(coder, column.cast(pa.large_string())) == ids(coder, column)
    assert coder.encode([]) == [] and coder.encode(column[:1]) == [b""]


def test_mixed_signs_spaces_and_letters(coder):
    rng = np.random.default_rng(11)
    some = ["a", "foo", "é", "ß", "日本", " ", "　", " ", "\u0085", " ", " ", "  ", "\n", "\n\n", "\t", "\x1c",
            "\x00", "'s", "'", "12", "½", ".", "(", "|", "<", "<|endoftext|>", "“", "\U0001f600", "क", "ि", "​"]
    texts = ["".join(rng.choice(some, rng.integers(0, 14))) for _ in range(8000)]
    assert ids(coder, texts) == [coder.model.encode(t, add_special_tokens=False).ids for t in texts]


def test_a_word_goes_to_the_library_once_whatever_stands_behind_it():
    coder = tokenids.PieceEncoder(PATH)
    words, whole = [], []
    coder._word = lambda word, own=coder._word: (words.append(word), own(word))[1]
    coder._whole = lambda text, own=coder._whole: (whole.append(text), own(text))[1]
    texts = [f"Start {' '.join(x + sign for x in ('thatble', 'erbleor'))}\nStart\n\nStart" for sign in ("", ".", ",", "!", ").")]
    got = ids(coder, texts + texts)
    assert got == 2 * [coder.model.encode(t).ids for t in texts]
    assert sorted(words) == [" erbleor", " thatble", "Start"]
    assert sorted(whole) == sorted(set(whole)) and len(whole) <= 6


def test_pieces_that_are_still_used_outlive_a_full_cache(coder, monkeypatch):
    monkeypatch.setattr(tokenids, "PIECE_BYTES", 200 * 40)
    small = tokenids.PieceEncoder(PATH)
    for k in range(60):
        texts = [f"always {'abcdefghij'[k % 10]}{'klmnopqrst'[k // 10]} and\nso on."]
        assert ids(small, texts) == ids(coder, texts)
        assert small.kept.get(" and") is not None
    assert len(small.kept.young) + len(small.kept.old) <= 40
