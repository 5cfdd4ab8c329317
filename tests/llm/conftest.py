from __future__ import annotations

import pytest

LONG = " ".join(f"word{i % 97}x{i % 13}" for i in range(30_000))

ROWS = [
    (1, "The quick brown fox jumps over the lazy dog near the river bank today.\n" * 3, "en", "b"),
    (1, "The quick brown fox jumps over the lazy dog near the river bank today.\n" * 3, "en", "b"),
    (2, None, None, None),
    (3, "", "en", "a"),
    (4, " \t\n\x0b\x0c\r ", "de", "a"),
    (5, "one", "fr", "c"),
    (6, LONG, "en", "b"),
    (7, "x" * 50_000, None, "b"),
    (None, "a row without an id", "en", "a"),
    (8, "é ü 漢字 😀\x00 � don't STOP, Now.", "es", None),
]


def with_clashes(spark, rows=ROWS):
    """Documents with columns named like the operators' own."""
    schema = "doc_id long, text string, lang string, source string, score double, kept boolean, label int, m_size int, p_base string, node int, n_words string, trains int"
    return spark.createDataFrame([(*r, 0.5, False, 1, 1, "x", 2, "y", 3) for r in rows], schema)


@pytest.fixture(scope="session")
def edge(spark):
    return with_clashes(spark).cache()


@pytest.fixture(scope="session")
def nothing(spark):
    return with_clashes(spark).limit(0)
