import random

import pytest


@pytest.fixture(scope="session")
def awkward(spark):
    """Nulls in every column, empty, blank and long texts, ties, repeated rows, clashing extra columns."""
    random.seed(5)
    words = ["the", "tion", "Ünder", "a", "日本", "x" * 40]
    long_text = " ".join(random.choice(words) for _ in range(9000))
    passage = " ".join(f"shared{i}" for i in range(60))
    rows = [
        (1, None, None, None), (2, "", "k", 1), (3, "", None, None), (4, " \n\t ", "k", 2),
        (5, long_text, "k", 3), (6, long_text, "k", 3), (7, long_text + " tail", "k", 4),
        (8, passage + " one", "k", 5), (9, "zero " + passage, "k", 6), (9, "zero " + passage, "k", 6),
        (None, "no id", "k", 7), (11, "word", "k", 8), (12, "a b c d e", None, 9), (13, "nul \x00 byte é <|endoftext|>", "k", 1),
    ]
    return spark.createDataFrame(rows, "doc_id long, text string, keep_id string, salt int").cache()


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], "doc_id long, text string, fp int, chunk string")


@pytest.fixture(scope="session")
def rows(awkward):
    """(doc_id, text) as the operators see them."""
    return sorted((r.doc_id, r.text or "") for r in awkward.collect() if r.doc_id is not None)
