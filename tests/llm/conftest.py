import sys
from pathlib import Path

import pytest

sys.path[:0] = [str(Path(__file__).resolve().parents[2]), str(Path(__file__).resolve().parent)]

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def rows():
    """A few documents with every awkward shape: null and empty texts, ties, repeats, odd white space."""
    passage = " ".join(f"shared{i}" for i in range(60))
    return [
        (1, None), (2, ""), (3, " "), (4, "\n"), (5, "one"), (6, "One two three four"),
        (7, "one two three four"), (8, passage + " tail one."), (9, passage.upper() + " tail one."),
        (10, "a\tb  c\x1cd e f \n g\r\nh"), (11, "it's we'll they've I'd 12 345 x_y"),
        (12, "Straße Été été İstanbul ΣΣ 日本語 \U0001f600"),
        (13, "<|endoftext|> mid<|endoftext|>dle <|startoftext|>\n<|endoftext|>"),
        (14, passage + "\n" + "x" * 5000), (15, "word " * 3000), (16, "word " * 3000),
        (17, "  lead and trail  "), (18, "end.\n\nNext\n\n\nafter\n"), (None, "no id"), (20, "é" * 45),
    ]


@pytest.fixture()
def docs(spark, rows):
    """The documents over several partitions, with extra columns whose names could clash."""
    return spark.createDataFrame(
        [(i, t, "en", "src", len(t or ""), 7, 1.5) for i, t in rows],
        "doc_id long, text string, lang string, source string, n_chars long, part long, kept double").repartition(3, "doc_id")
