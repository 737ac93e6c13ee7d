import random

import pytest

SF001 = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet(f"{SF001}/documents.parquet")


@pytest.fixture(scope="session")
def odd_documents(spark):
    """Null ids and texts, empty texts, repeated rows, a tie, a long text, and clashing extra columns."""
    rnd = random.Random(5)
    long = " ".join(rnd.choice(["alpha", "beta", "gamma", "Token=abcdefghijklmnop", "licence", "mit license"]) for _ in range(30_000))
    rows = [
        (1, "Released under the MIT License. password = 'abcdefghijklmnop'", 9, "x", None),
        (1, "Released under the MIT License. password = 'abcdefghijklmnop'", 9, "x", None),
        (2, None, None, None, 3),
        (None, "some words without an id and a few more", 1, "y", 4),
        (None, None, None, None, None),
        (3, "", 0, "z", 5),
        (4, "  \n\t ", 5, "z", 5),
        (5, "one", 3, "z", 5),
        (6, long, len(long), "z", 5),
        (7, "é漢字 \x1c mixed\r\nlines  and   runs <|endoftext|> of\tspace ", 1, "z", 5),
    ]
    names = "doc_id long, text string, n_chars long, shard string, fp int"
    return spark.createDataFrame(rows, names)


@pytest.fixture(scope="session")
def no_documents(documents):
    return documents.where("false")
