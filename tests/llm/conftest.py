import random

import pytest

WORDS = "der the un la que and of to house river stone cloud ember field garden hollow island juniper".split()

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
#: Columns that operators use themselves, on tables that have them already.
CLASHING = ("size", "shard", "slot", "grp", "hits", "class", "token", "n", "ids", "kept", "gram", "__hits2")


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + (rng.choice(["", "s", "ing", "ed"])) for _ in range(n))


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls, empty and blank texts, repeated rows, ties, a very long text, and clashing columns."""
    rng = random.Random(5)
    texts = [None, "", "   \n\t ", "one", "Two words", prose(rng, 30), prose(rng, 400), "x" * 5000, prose(rng, 60_000)]
    rows = [(i, t, "en", "src0", 0) for i, t in enumerate(texts)]
    rows += [(5, texts[5], "en", "src0", 0), (20, texts[5], None, None, None), (None, texts[6], "en", "src1", 0), (None, None, None, None, None)]
    rows += [(30, "é" * 40 + " 日本 🙂", "fr", "src2", 3)]
    frame = spark.createDataFrame(rows, DOCS)
    for name in CLASHING:
        frame = frame.selectExpr("*", f"'other' as `{name}`")
    return frame


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def labels(spark):
    return spark.createDataFrame(
        [(5, 1, 0), (6, 1, 0), (8, 1, 0), (30, 1, 1), (7, 0, 0), (None, 1, 0), (20, None, None), (20, 1, 0)],
        "doc_id long, quality int, toxic int",
    )
