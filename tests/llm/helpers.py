"""Small tables and texts for the operators' tests."""

import random

from pyspark.sql import types as T

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("key", T.StringType()), T.StructField("a", T.LongType())])


def table(spark, rows):
    """documents with extra columns whose names clash with the operators' own."""
    return spark.createDataFrame([(d, t, "x", 1) for d, t in rows], DOCS)


def texts(n, seed=0, words=40, vocabulary=300):
    rng = random.Random(seed)
    vocab = ["".join(rng.choice("aeioubcdnrst") for _ in range(rng.randrange(2, 9))) for _ in range(vocabulary)]
    return [" ".join(rng.choice(vocab) for _ in range(rng.randrange(1, words))) for _ in range(n)]


ODD = ["", None, " ", "\n\n", "a", "ÉÀ ñ \U0001f600 x", "A a A a", "word " * 3, "  ", "x" * 5000]
