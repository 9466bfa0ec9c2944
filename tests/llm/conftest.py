import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent))

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def odd(spark):
    """Documents with every awkward case: nulls, empty and long texts, ties, repeated rows, clashing names."""
    long = " ".join(f"w{i % 977}x{i}" for i in range(60_000))
    rows = [
        (1, None, "en", "a", None), (2, "", "en", "a", 0), (3, long, None, "b", 1), (4, "short text", "en", None, 10),
        (5, "short text", "en", None, 10), (5, "short text", "en", None, 10), (None, "no id " * 40, "de", "b", 3),
        (7, "x" * 3000, "en", "a", 3000), (8, " \t\n ", "fr", "c", 4), (9, "Ünï©ødé 漢字 😀 text " * 30, "xx", "c", 9),
    ]
    docs = spark.createDataFrame(rows, SCHEMA)
    extra = {c: "clash" for c in ("size", "shard", "slot", "record", "kept", "measures", "found", "key", "digest",
                                  "part", "row", "ids", "sid", "target", "taken", "x", "good", "values", "label")}
    from pyspark.sql import functions as F

    return docs.select("*", *[F.lit(v).alias(k) for k, v in extra.items()])


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
