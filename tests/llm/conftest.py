import random

import pytest
from pyspark.sql import types as T

LONG = " ".join(f"w{i % 977}" for i in range(60_000))


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty, blank and very long texts, repeated rows and ids, columns of clashing names."""
    rows = [
        (1, "the same words stand here in this text for all to read and see", "en"), (1, "the same words stand here in this text for all to read and see", "en"), (2, "the same words stand here in this text for all to read and see", "fr"),
        (3, None, "en"), (4, "", None), (5, "  \n\t ", "en"), (None, "a text of an unknown document that stands alone", "en"), (None, None, None), (6, LONG, "en"),
        (7, "x", "en"), (8, "ünïcödé “quotes” 日本語 текст 🎉\r\nnext line of it", None), (9, "line one is long enough\nline one is long enough\nother line of text", "de"),
    ]
    clash = {"p": "double", "hit": "boolean", "gl_id": "long", "gl_gone": "string", "id": "string", "h": "int", "seg": "long", "used": "int", "level": "int", "band": "string", "part": "int", "count": "long", "a.b": "string", "Text2": "string", "key": "string"}
    fields = [T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())]
    types = {"double": T.DoubleType(), "boolean": T.BooleanType(), "long": T.LongType(), "string": T.StringType(), "int": T.IntegerType()}
    fields += [T.StructField(k, types[v]) for k, v in clash.items()]
    return spark.createDataFrame([(i, t, lang, "s", None if t is None else len(t), *[None] * len(clash)) for i, t, lang in rows], T.StructType(fields))


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.limit(0)


@pytest.fixture(scope="session")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (2, 0, 1), (None, 1, 1), (3, 1, 0), (9, None, None), (9, 0, 0), (77, 1, 1)], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="session")
def bench_items(spark):
    return spark.createDataFrame([(1, "stand here in this text for all to read and see"), (2, None), (3, ""), (None, "only line of an unknown item that is nowhere"), (1, "stand here in this text for all to read and see")], "item_id long, text string")


@pytest.fixture
def rng():
    return random.Random(11)


def words(rng, n, vocab=400):
    return " ".join(f"v{rng.randrange(vocab)}" for _ in range(n))
