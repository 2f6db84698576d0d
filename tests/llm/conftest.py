import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

TESTDATA = "/root/testdata"


@pytest.fixture(scope="session")
def small_documents(spark):
    return spark.read.parquet(f"{TESTDATA}/sf0.001/documents.parquet")


@pytest.fixture(scope="session")
def cluttered(spark):
    """Documents with nulls, empties, repeats, one very long text, and columns that clash with ours."""
    words = [f"w{i % 997}x{i % 13}" for i in range(30_000)]
    texts = [
        None, "", "   \n\t ", "one", "One", "two words", "a b c d e", "A B C D E", "a b c d f",
        " ".join(words), " ".join(words[:-40]), " ".join(words[:400]), "ünïcödé ça va là-bas çà",
        "\x00\x01 odd   text", "mail me a@b.co or 10.0.0.1", "x" * 5000, None, "",
    ]
    rows = [
        (i, t, None if i % 5 == 0 else "en", None if i % 7 == 0 else "s0", None, f"k{i}", -1, b"x", i)
        for i, t in enumerate(texts)
    ]
    schema = (
        "doc_id bigint, text string, lang string, source string, n_chars bigint, "
        "id string, label int, signature binary, bucket int"
    )
    return spark.createDataFrame(rows, schema)
