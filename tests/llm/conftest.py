import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def words(rng, n, letters="abcdefghij"):
    return " ".join("".join(rng.choice(letters) for _ in range(rng.randint(2, 7))) for _ in range(n))


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls in every column, empty and very long texts, ties, repeated rows."""
    rng = random.Random(5)
    base = words(rng, 120)
    long = words(rng, 30_000)
    texts = [base, base, base + " one more", None, "", "   \n\t ", "x", "two words", long, "é" * 500 + " ünï", words(rng, 80), base.replace(" ", "\n"), "a\x00b " * 60]
    rows = [(i, t, "en" if i % 2 else None, f"s{i % 3}" if i % 4 else None, None if t is None else len(t)) for i, t in enumerate(texts)]
    rows += [(None, base, None, None, None), (None, None, None, None, None), (7, "two words", "en", "s1", 9), (7, "two words", "en", "s1", 9), (7, "two words", "en", "s1", 9), (3, "other text of the same id", "en", "s1", 3)]
    return rows


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    return spark.createDataFrame(odd_rows, DOCS).repartition(3)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def clashing(odd):
    """Extra columns that are named like outputs."""
    from pyspark.sql import functions as F

    names = ["score", "predicted", "fp", "component_id", "shard", "slot", "rate", "copies", "copy_no", "kept", "spans", "n_bytes", "item_id", "text_key"]
    return odd.withColumns({n: F.lit("mine") for n in names})
