import os
import sys

import pytest
from pyspark.sql import types as T

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
os.environ["PYTHONPATH"] = os.pathsep.join([ROOT, os.environ.get("PYTHONPATH", "")])  # for Python workers
sys.path.insert(0, ROOT)

DOCUMENTS = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
        # Names that operators use inside, as a caller may have them too.
        *[T.StructField(c, T.StringType()) for c in ("id", "row", "cls", "n", "doc", "m", "word", "kind", "score")],
    ]
)


@pytest.fixture(scope="session")
def make(spark):
    """Documents from (id, text, lang, source) with extra columns of clashing names."""

    def build(rows):
        full = []
        for r in rows:
            r = (*r, "en", "web")[:4] if len(r) < 4 else r
            full.append((*r, len(r[1] or ""), *["x"] * 9))
        return spark.createDataFrame(full, DOCUMENTS)

    return build


@pytest.fixture(scope="session")
def odd(make):
    """Nulls, empty and blank texts, a very long one, ties and repeated rows."""
    long = " ".join(f"w{i % 977}x{i % 31}" for i in range(60_000))
    return make(
        [
            (1, None, None, None),
            (2, "", "en", None),
            (3, " \t\n ", None, "web"),
            (4, long, "en", "web"),
            (5, "One two three four five six seven.", "en", "web"),
            (5, "One two three four five six seven.", "en", "web"),
            (6, "one TWO three four five six seven.", "de", "web"),
            (None, "nobody knows this one at all today", "en", "web"),
            (7, "éè \U0001f600 日本 <|endoftext|> <s> ▁x", "fr", "web"),
        ]
    )
