"""Small tables with every awkward case."""

from __future__ import annotations

import pytest

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, keep_id string, size string, kept string, __tw_id string, __tw_own string"


@pytest.fixture(scope="session")
def documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty and blank texts, ties, repeated rows, a long text, and columns with clashing names."""
    base = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty"
    rows = [
        (1, base, "en", "a"), (2, base.upper(), "en", "a"), (2, base.upper(), "en", "a"), (3, base + " more", "en", "b"), (4, None, None, None),
        (5, "", "en", "a"), (6, " \n\t ", "en", None), (7, "short", "en", "b"), (None, base, "en", "b"), (None, "no id here", None, "a"),
        (8, "word " * 30_000, "en", "hot"), (9, "É é <|end|>\n</s> ça", "fr", "a"), (10, base + "\n" + base, "en", "a"), (11, "É É", "fr", "z"),
    ]
    return spark.createDataFrame([(i, t, lang, s, None, "x", "y", "z", "p", "q") for i, t, lang, s in rows], SCHEMA)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)
