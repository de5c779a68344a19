import os

import pytest
from pyspark.sql import types as T

TOKENIZERS = os.environ.get("TIDEFOLIO_TOKENIZERS", "/opt/tokenizers")
DOCUMENTS = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
    ]
)


@pytest.fixture(scope="session")
def documents(spark):
    """Makes a documents table from texts, or from (doc_id, text, source) rows."""

    def make(rows):
        full = [r if isinstance(r, tuple) else (i, r, "s") for i, r in enumerate(rows)]
        return spark.createDataFrame([(i, t, "en", s, None if t is None else len(t)) for i, t, s in full], DOCUMENTS)

    return make

