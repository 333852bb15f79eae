import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

LONG = " ".join(f"long{i % 997}x{i}" for i in range(6000))
NEAR = " ".join(f"near{i}" for i in range(200))


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empties, ties, repeated rows, a very long text, and columns with clashing names."""
    rows = [
        (1, "same text here, word for word, twice", "en", "a"), (2, "same text here, word for word, twice", "en", "a"), (2, "same text here, word for word, twice", "en", "a"),
        (3, None, None, None), (4, "", "en", "b"), (5, "   \n\t", "en", None), (6, LONG, "en", "a"), (7, NEAR, "en", "b"), (8, NEAR + " tail", "en", "b"),
        (9, "two words", "de", "ü"), (None, "a row without an id", "en", "a"), (10, "Ünïcödé 日本語 🎉 <|endoftext|> text", "fr", "c"), (11, "same text here, word for word, twicf", "en", "a"),
    ]
    cols = "doc_id long, text string, lang string, source string, n_chars long, key long, n long, h long, size long, hit boolean, row long, kept boolean, part long"
    return spark.createDataFrame([(*r, len(r[1] or ""), 1, 2, 3, 4, True, 5, False, 6) for r in rows], cols)


@pytest.fixture(scope="session")
def none(odd):
    return odd.limit(0)
