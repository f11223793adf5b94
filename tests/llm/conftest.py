from __future__ import annotations

import pytest


@pytest.fixture(scope="session")
def texts(spark):
    """Rows with nulls, empty and very long texts, ties, repeated rows and columns whose names clash with the operators' own."""
    long = "lorem ipsum dolor sit amet " * 20_000
    base = "the quick brown fox jumps over the lazy dog while seven wizards quietly mix potent jugs of dark liquor near town"
    near = base.replace("quietly", "loudly") + " tonight"
    many = " ".join(f"w{i}" for i in range(300))
    rows = [(1, "Hello, World! It's 10 o'clock.", "a"), (2, None, None), (3, "", "b"), (4, long, "a"), (5, base, "a"), (5, base, "a"), (6, near, "b"), (7, base, "c"), (8, "\x1codd\x1fseparators ÀÉ İx Σας ﬁ", "a"), (9, many, "d"), (10, many.replace("w150", "x150"), "d"), (11, "!!! ??? ...", None), (None, "no id here", "a")]
    return spark.createDataFrame([(*r, "x", 7, 8, 9, "q", "g") for r in rows], "doc_id long, text string, source string, queue string, n int, h int, score int, ids string, `group` string")
