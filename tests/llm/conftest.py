import pytest
from pyspark.sql import types as T

#: Columns whose names clash with those that the operators make or use.
CLASHING = ["kept", "score", "sig", "length", "copy", "n", "rep", "text_sha256", "n_values", "quality_score", "component_id"]

LONG = " ".join(f"w{i * 7919 % 5003}" for i in range(30_000))
BASE = "the quick brown fox jumps over the lazy dog and then it goes on to run through the green forest until the night comes down over all the hills and every river"

ROWS = [
    (1, "Hello World, this is a text of a few words.", "en", "a"),
    (2, "hello world, this is a text of a few words.", "en", "a"),
    (3, None, None, None),
    (4, "", "en", "b"),
    (5, "  \t\n ", "en", "b"),
    (6, LONG, "en", "c"),
    (7, LONG + " tail", "en", "c"),
    (8, BASE, "en", "c"),
    (9, BASE + " once", None, "c"),
    (10, BASE, "de", None),
    (11, "one two", "en", "a"),
    (12, "ONE\x0btwo", "en", "a"),
    (13, "Straße ÄÖ straße", "de", "a"),
    (14, "straße Äö straße", "de", "a"),
    (8, BASE, "en", "c"),
]


@pytest.fixture(scope="session", autouse=True)
def shipped(spark):
    from larder.llm.common import ship

    ship(spark)


def frame(spark, rows, clash=False):
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])
    full = [(*r, len(r[1]) if r[1] is not None else None) for r in rows]
    if clash:
        schema = T.StructType(schema.fields + [T.StructField(n, T.StringType()) for n in CLASHING])
        full = [(*r, *[f"{n}!" for n in CLASHING]) for r in full]
    return spark.createDataFrame(full, schema).repartition(3)


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empties, very long texts, ties and repeated rows, with clashing extra columns."""
    return frame(spark, ROWS, clash=True)


@pytest.fixture(scope="session")
def empty(spark):
    return frame(spark, [], clash=True)


@pytest.fixture(scope="session")
def no_id(spark):
    """Rows without an id."""
    return frame(spark, [(None, "text without an id here and now", None, None), (None, None, None, None), (1, "text without an id here and now", "en", "a")])
