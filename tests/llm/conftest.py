import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from scorelattice.llm.common import prepared  # noqa: E402

SMALL, TINY = "/root/testdata/sf0.01", "/root/testdata/sf0.001"

LINE = "A line of more than forty characters that repeats, "


def odd_rows():
    """Nulls, empty and very long texts, ties, repeated rows."""
    long_word, many = "ab" * 30_000, "word and other 12 " * 4_000
    rows = [
        (1, "plain text of a few words"), (2, None), (3, ""), (None, "no id here but some text"), (4, long_word),
        (5, many), (6, " \t\n \n"), (7, "Ünïcödé \U0001F600 text with wide blanks"), (8, "plain text of a few words"),
        (8, "plain text of a few words"), (9, "repeats its id"), (9, "with another text"), (None, None),
    ]
    rows += [(20 + i, f"{LINE}{i % 2}\nown {i}\n{LINE.upper()}") for i in range(7)]
    return rows


CLASHING = "doc_id long, text string, doc string, body int, print long, pos int, score string, spans int, id int, label int, _marks int, list int"


@pytest.fixture(scope="session")
def odd(spark):
    prepared(spark)
    return spark.createDataFrame([(i, t, "x", 1, 2, 3, "y", 4, 5, 6, 7, 8) for i, t in odd_rows()], CLASHING)


@pytest.fixture(scope="session")
def none(odd):
    return odd.where("false")


@pytest.fixture(scope="session")
def small(spark):
    prepared(spark)
    return lambda name, folder=SMALL: spark.read.parquet(f"{folder}/{name}.parquet")
