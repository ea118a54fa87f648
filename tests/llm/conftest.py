import datetime

import pytest

LONG = "word " * 30_000 + "end"


@pytest.fixture(scope="session")
def hard_rows(spark):
    """Nulls in every column, empty, blank and very long texts, repeated rows and ids, and extra columns with clashing names."""
    rows = [
        (1, "a b c d e f", "en", "src1"), (2, None, None, None), (3, "", "en", "src1"), (4, " \t\n ", "de", ""), (5, LONG, "en", "src2"), (6, LONG, "en", "src2"), (7, "a b c d e f", "en", "src1"),
        (7, "a b c d e f", "en", "src1"), (8, "A B C D E F", "en", "src1"), (9, "a b c d e g", "en", "src1"), (9, "one id, two texts", "fr", "src3"), (None, "a b c d e f", "en", "src1"), (None, None, None, None), (10, "ein", "de", "srcx"),
    ]
    extra = [(*r, 1 if r[1] else 0, 7, 7.5, datetime.date(2024, 1, 1), [1], "z", True, None) for r in rows]
    names = "doc_id long, text string, lang string, source string, n_chars int, x int, n_bytes double, h1 date, bands array<int>, label string, kept boolean, `members` int"
    return spark.createDataFrame(extra, names).repartition(3)


@pytest.fixture(scope="session")
def no_rows(hard_rows):
    return hard_rows.limit(0)
