import numpy as np
import pytest
from pyspark.sql import types as T

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"
LABELS = "doc_id long, quality int, toxic int"


@pytest.fixture(scope="session")
def documents(spark):
    """A documents table from (doc_id, text) pairs, or (doc_id, text, lang)."""

    def build(rows):
        whole = [
            (r[0], r[1], r[2] if len(r) > 2 else "en", "s", len(r[1] or "")) for r in rows
        ]
        return spark.createDataFrame(whole, DOCUMENTS)

    return build


@pytest.fixture(scope="session")
def labels(spark):
    return lambda rows: spark.createDataFrame(rows, LABELS)


@pytest.fixture(scope="session")
def embeddings(spark):
    kind = T.StructType(
        [
            T.StructField("vec_id", T.LongType()),
            T.StructField("embedding", T.ArrayType(T.FloatType())),
            T.StructField("label", T.IntegerType()),
        ]
    )

    def build(rows):
        listed = lambda v: None if v is None else [None if x is None else float(x) for x in v]
        return spark.createDataFrame([(i, listed(v), 0) for i, v in rows], kind)

    return build


def vectors(n, d=12, seed=0):
    return np.random.default_rng(seed).normal(size=(n, d)).astype(np.float32)
