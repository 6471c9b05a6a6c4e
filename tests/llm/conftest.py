import random

import pytest

SF = "/root/testdata/sf0.001"

#: Rows every operator has to cope with: null, empty and blank texts, ties, a
#: repeated row, odd characters, a very long text, and columns whose names clash
#: with those that operators add.
ODD = [
    (None, "A row without an id, of a dozen words or so, which stays as it is.", 0), (1, None, 1), (2, "", 2),
    (3, " \n\t ", 3), (4, "one", 4), (5, "one", 5), (6, "The same row twice, word for word, it is.", 6),
    (6, "The same row twice, word for word, it is.", 6),
    (7, "ñandú  Éa\x00 x\x1cy z İ <|endoftext|> don't 日本語 😀", 7),
    (8, "loop " * 30000, 8), (9, "a" * 5000, 9),
]
EXTRA = ["scan_words", "scan_text", "n_words", "kept", "score", "gram"]


@pytest.fixture(scope="session")
def odd_docs(spark):
    cols = ", ".join(f"{c} int" for c in EXTRA)
    rows = [(i, t, n, *([n] * len(EXTRA))) for i, t, n in ODD]
    return spark.createDataFrame(rows, f"doc_id long, text string, n_chars long, {cols}")


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], "doc_id long, text string")


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture()
def rnd():
    return random.Random(20)


@pytest.fixture(scope="session")
def rows_of(documents):
    return [(r["doc_id"], r["text"]) for r in documents.select("doc_id", "text").collect()]
