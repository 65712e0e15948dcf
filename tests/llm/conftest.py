import pytest
from pyspark.sql import functions as F

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega".split()


def prose(seed: int, n: int) -> str:
    """n words, other ones for each seed."""
    return " ".join(WORDS[(seed * 7 + i * i * (seed % 5 + 1) + i // 3) % 24] + str((seed * 31 + i * 17) % 97) for i in range(n))


@pytest.fixture(scope="session")
def awkward(spark):
    """Nulls in any column, empty, blank, odd and long texts, repeated rows, and columns that operators use inside."""
    rows = [
        (1, prose(1, 80), "en", "a"), (1, prose(1, 80), "en", "a"), (2, prose(1, 80), "en", None), (3, None, None, "b"), (4, "", "en", "b"),
        (5, " \n\t ", "fr", "b"), (6, "één", None, "a"), (None, prose(6, 60), "en", "a"), (7, prose(7, 20_000), "en", "a"), (8, "12 34 !!", "de", None),
        (9, prose(1, 79) + " other", "en", "a"), (10, "\x0b\x0c a\x85b c \U0001f600 ▁ x", "de", "b"), (11, prose(11, 60) + " " + prose(7, 120)[:700], "en", "c"),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumn("n_chars", F.length("text").cast("long"))
    for name in ("node", "place", "words", "secrets", "kept", "lang_pred", "score", "_id", "_kept", "digest", "bands", "shard", "toxicity", "host"):
        docs = docs.withColumn(name, F.lit("own"))
    return docs


@pytest.fixture(scope="session")
def nothing(awkward):
    return awkward.limit(0)
