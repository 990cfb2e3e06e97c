import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def prose(seed: int, words: int) -> str:
    r = random.Random(seed)
    return " ".join("".join(r.choice("abcdefghij") for _ in range(r.randint(2, 7))) for _ in range(words))


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls in every column, empty and blank texts, a very long one, ties, repeated rows."""
    base = prose(1, 300)
    return [
        (1, base, "en", "a", len(base)), (2, base, "en", "a", len(base)), (2, base, "en", "a", len(base)),
        (3, None, None, None, None), (4, "", "en", "", 0), (5, " \t\n ", "de", "b", 4), (None, prose(2, 80), "en", "a", 1),
        (None, None, None, None, None), (6, prose(3, 200_000), "en", "a", None), (7, "one", "en", "c", 3),
        (8, "same line of words here\n" * 40, "en", "c", 9), (9, "tie", "en", "c", 3), (9, "other", "en", "c", 3),
        (10, "Öl ändert äußerst\n\n\nviel", "de", "b", 5), (11, "a\x00b " * 30, "en", "b", 5),
    ]


@pytest.fixture(scope="session")
def odd_docs(spark, odd_rows):
    return spark.createDataFrame(odd_rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def clashing(odd_docs):
    """The odd rows with extra columns named like what operators add or use inside."""
    from pyspark.sql import functions as F
    names = ["score", "kept", "anomaly", "n_words", "tokens", "weight", "probability", "sampled", "topic", "n_lines", "n_removed",
             "fp", "component_id", "key", "t", "part", "rank", "item", "_label",
             "_meta_n_chars", "_dim_source", "__id", "__u", "__t", "__t1", "__t2", "__first", "__gone", "__copy"]
    return odd_docs.withColumns({n: F.lit("x") for n in names})


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def folder():
    return "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def documents(spark, folder):
    return spark.read.parquet(f"{folder}/documents.parquet")


@pytest.fixture(scope="session")
def labels(spark, folder):
    return spark.read.parquet(f"{folder}/labels.parquet")
