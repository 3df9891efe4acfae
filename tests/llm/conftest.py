import pytest
from pyspark.sql import types as T

WORDS = "the of and river stone winter garden silver morning letter window bridge captain market shadow forest copper".split()

DOCUMENTS = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
        # Names that operators use inside.
        T.StructField("id", T.StringType()),
        T.StructField("row", T.StringType()),
        T.StructField("fingerprint", T.StringType()),
        T.StructField("doc", T.StringType()),
        T.StructField("bucket.at", T.StringType()),
    ]
)


def prose(random, words):
    return " ".join(random.choice(WORDS) + random.choice(["", "", "s", "er", "ing"]) for _ in range(words))


def odd_rows():
    """Nulls in every column, empty and very long texts, ties, repeated rows, copies, near copies, wide characters."""
    import random

    r = random.Random(5)
    base = prose(r, 120)
    near = base.replace(base.split(" ")[60], "changed", 1)
    texts = [
        (0, base, "a"), (1, base, "b"), (2, near, None), (3, None, "a"), (4, "", None), (5, "   \n\t ", "b"),
        (6, prose(r, 40_000), "a"), (7, "é ü 漢字 \U0001f600 " * 30, "b"), (8, "one", "a"), (8, "one", "a"), (8, "two words", "a"),
        (None, base, "b"), (None, None, None), (9, "short text of words", None), (10, base[:200] + prose(r, 50), "c"),
        (11, " leading and  double  spaces\n\n and lines \n", "c"), (12, "x" * 5000, "c"), (13, "the " * 3000, "d"), (14, base + "\n" + base, "d"),
        (15, 'He said "you idiot" to no one', "d"), (16, "you stupid worthles idiot, you moron and loser", "d"), (17, "x\0y \0", "d"),
    ]
    return [(i, t, "en" if i else None, s, len(t) if t else None, "k", None, "f", "d", "p") for i, t, s in texts]


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame(odd_rows(), DOCUMENTS).repartition(3).cache()


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], DOCUMENTS)


@pytest.fixture(scope="session")
def small(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
