import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, ROOT)

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def docs(spark):
    """Nulls, empty and blank texts, a very long one, ties, repeated rows, clashing names."""
    long = " ".join(f"w{i % 977}" for i in range(60_000))
    body = " ".join(f"word{i}" if i % 5 else f"the word{i}" for i in range(90))
    rows = [(1, body, "en"), (2, body, "de"), (3, None, None), (4, "", "en"), (5, " \t\n", "en"), (6, "one", "en"),
            (7, long, "en"), (1, body, "en"), (None, body, "en"), (None, None, None), (8, body.replace("word44", "other"), "en")]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string").selectExpr(
        "doc_id", "text", "lang", "'x' AS fingerprint", "1 AS component_id", "2 AS shard", "3 AS slot", "'y' AS words",
        "0 AS key", "'z' AS digest", "true AS kept", "'q' AS TEXT_", "length(text) AS n_chars")


@pytest.fixture(scope="session")
def empty(docs):
    return docs.filter("false")
