import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, component_id string, size string, score string"


def docs_of(spark, rows):
    """A table of documents from (doc_id, text[, lang, source]), with more columns whose names operators use themselves."""
    full = [(r[0], r[1], *(r[2:] or ("en", "s")), len(r[1] or ""), "x", "y", "z") for r in rows]
    return spark.createDataFrame(full, DOCS)


@pytest.fixture(scope="session")
def words():
    rng = random.Random(4)
    return ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8))) for _ in range(600)]
