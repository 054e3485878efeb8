import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def make(spark):
    """documents from {doc_id: text} or (doc_id, text) pairs, with an extra column."""

    def build(texts, extra: bool = True):
        pairs = texts.items() if isinstance(texts, dict) else texts
        rows = [(d, t, "en", f"src{(d or 0) % 3}", len(t or "")) for d, t in pairs]
        df = spark.createDataFrame(rows, SCHEMA)
        from pyspark.sql import functions as F

        return df.withColumn("id", F.lit("x")).withColumn("score", F.lit(9)).withColumn("h", F.lit(None).cast("string")) if extra else df

    return build


@pytest.fixture
def rng():
    return random.Random(11)
