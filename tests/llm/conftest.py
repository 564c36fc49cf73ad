import pytest

TEXTS = [
    (1, "The quick brown fox jumps over the lazy dog. It runs, and runs!", "a"), (2, None, "a"), (3, "", None), (4, "   \n ", "b"), (5, "word", "b"),
    (6, "It's naïve CAFÉ <|endoftext|> ΣΑΣ İx 北京 🙂 a.b,c", "c"), (7, "long " * 30_000, "a"), (8, "same text of some words here", "c"),
    (8, "same text of some words here", "c"), (None, "a row without an id", "b"), (10, "one two three four five six seven eight " * 5, "a"),
]


@pytest.fixture(scope="session")
def awkward(spark):
    """Nulls, empty and long texts, a repeated row, and extra columns whose names operators might want."""
    rows = [(i, t, "en", s, n, 7, "x", 1.5) for n, (i, t, s) in enumerate(TEXTS)]
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint, size int, content string, Toxicity double")


@pytest.fixture(scope="session")
def nothing(awkward):
    return awkward.where("false")
