from __future__ import annotations

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n_words long, score double, chunk string, `class` string, bands string, kept boolean"


@pytest.fixture(scope="session")
def frame(spark):
    """Documents from (doc_id, text[, lang, source]); the other columns have names that operators use themselves."""

    def make(rows):
        full = [(r[0], r[1], r[2] if len(r) > 2 else "en", r[3] if len(r) > 3 else "s", 1, 7, 0.5, "x", "y", "z", True) for r in rows]
        return spark.createDataFrame(full, SCHEMA).repartition(3)

    return make


PASSAGE = " ".join(f"shared{i}" for i in range(60))


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls, empty and blank texts, ties, repeated rows, one very long text, near copies, a passage that several share."""
    base = [f"w{i}" for i in range(100)]
    long = " ".join(f"long{i % 7919}x{i % 104}" for i in range(60_000))
    return [
        (1, None), (2, ""), (3, " \t\n "), (4, "one"), (5, "one"), (6, "a b c d"), (7, " ".join(base)), (8, " ".join(base)), (9, "  ".join(base) + "\n"), (10, " ".join(base[:98] + ["x", "y"])),
        (11, "head " + PASSAGE + " tail"), (12, PASSAGE + " other end"), (13, "intro words here " + PASSAGE), (14, long), (15, "é ß 日本 \x00 \x1c 🙂 " + PASSAGE), (None, "no id at all but some words"), (16, "rep " * 50), (17, "line\nline\nline\nother\n"),
    ]
