import pytest

LONG = " ".join(f"wort{i % 997} und{i % 13}" for i in range(30_000))
PASSAGE = "the quick brown fox jumps over the lazy dog while seven small birds watch from a tall green tree in the park. " * 4
ROWS = [
    (7, "  Hello,  World!\n", "en", "a"), (3, "Hello, World!", None, "a"), (3, "Hello, World!", None, "a"),
    (None, "kein Schlüssel ohne Nummer", "de", None), (None, None, None, None), (10, None, "en", "b"), (11, "", "en", "b"),
    (12, " \t\n ", "en", "b"), (13, "12 34 !?", "fr", "b"), (14, LONG, "de", "c"), (15, LONG + " ende", "de", "c"),
    (16, PASSAGE, "en", "c"), (17, "Before it. " + PASSAGE, "en", "c"), (18, PASSAGE[:300], "en", "c"),
    (19, "ab" * 400, "es", "c"), (20, "élève déjà là, où ça? ñandú über straße", "fr", "c"), (21, "élève", "fr", "c"),
    (22, "<|im_end|><|endoftext|> <| x", "en", "d"), (23, "a", "en", "d"),
]
SCHEMA = "doc_id long, text string, lang string, source string"


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty and long texts, ties, repeated rows."""
    return spark.createDataFrame(ROWS, SCHEMA)


@pytest.fixture(scope="session")
def none(odd):
    return odd.where("false")


@pytest.fixture(scope="session")
def clashing(odd):
    """Columns named like the operators' own."""
    for name in ("row", "t", "fp", "digest", "locator", "k1", "k2", "who", "n", "bucket", "places", "id", "stats", "g"):
        odd = odd.selectExpr("*", f"'{name}' AS {name}")
    return odd


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.001"
