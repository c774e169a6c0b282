import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

from telewatch.session import build_session  # noqa: E402

SF001 = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, bucket int, n_words string"

BASE = " ".join(f"word{i}" for i in range(80))
NEAR = BASE.replace("word40", "changed")
PASSAGE = " ".join(f"shared{i}" for i in range(60))


@pytest.fixture(scope="session")
def spark():
    return build_session("local[4]", app="telewatch-tests", shuffle_partitions=8)


def messy_rows():
    """Nulls in every column, empty and very long texts, copies, ties, repeated
    rows and extra columns whose names clash with those of the operators."""
    long_text = " ".join(f"long{i % 977}x{i}" for i in range(30_000))
    rows = [
        (1, BASE, "en", "src0"), (2, BASE, "en", "src0"), (3, NEAR, "en", "src1"),
        (4, None, "en", "src1"), (5, "", None, None), (6, "  \n\t \n", "fr", "src2"),
        (7, "only four small words", "en", "src9"), (8, "only  four small\nwords", "en", "src9"),
        (9, "left " + PASSAGE + " right", "de", "src0"), (10, PASSAGE + " tail", "de", "src0"),
        (11, long_text, "en", "src0"), (12, "a a a a a a a a a a a a a a a a\n" * 8, "en", "src0"),
        (12, "the same id with another text here", "en", "src0"),
        (13, BASE, "en", "src3"), (13, BASE, "en", "src3"),
        (None, BASE, "en", "src0"), (None, None, None, None),
        (14, "Žluťoučký <|endoftext|> kůň   ﬁn \U0001f600 #$% &amp; x\x1cy", "cs", "src0"),
    ]
    return [(i, t, lang, s, None if t is None else len(t), 7, "clash") for i, t, lang, s in rows]


@pytest.fixture(scope="session")
def messy(spark):
    return spark.createDataFrame(messy_rows(), DOCS).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], DOCS)
