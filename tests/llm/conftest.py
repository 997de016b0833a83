from __future__ import annotations

import pytest

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, tie string, text_2 string, _text string, key int, part int, rep int, cell int, n int"


@pytest.fixture(scope="session")
def odd(spark):
    """Documents with nulls everywhere, empty and long texts, repeated rows, and columns whose names operators use inside."""
    more = ("en", "s", 1, "t", "u", "v", 1, 2, 3, 4, 5)
    none = (None,) * 11
    words = " ".join(f"word{i * 7919 % 3001}" for i in range(40_000))
    plain = " ".join(f"piece{i * 31 % 97} of{i % 13} prose{i * i % 101}" for i in range(80))
    rows = [(1, plain, *more), (1, plain, *more), (2, plain, *more), (3, "", *more), (4, None, *more), (5, " \n\t ", *more), (None, plain + " end", *none), (None, None, *none), (6, words, *more), (7, "ß\U0001f600é " * 40, *none)]
    return spark.createDataFrame(rows, DOCS)


def kept(df) -> list:
    return sorted((r.doc_id if r.doc_id is not None else -1, r.text or "") for r in df.collect())
