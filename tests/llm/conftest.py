import pytest

#: Null, empty and blank texts, one word, ties, repeated rows, signs of all lengths, a long text.
LONG = " ".join(f"word{i % 977} and{i}" for i in range(12_000))
PASSAGE = " ".join(f"passage{i}" for i in range(60))
TEXTS = [
    (7, None), (3, ""), (4, " \n\t "), (5, "one"), (6, "the same text here for two rows"), (6, "the same text here for two rows"),
    (8, "the same text here for two rows"), (None, "a row without an id, café 日本語 😀"), (1, LONG), (2, "héllo wörld\n\nhéllo  wörld\thas\ttabs " + PASSAGE),
    (9, f"before {PASSAGE} after it"), (10, "x" * 3000), (11, "a b a b a b a b a b a b"), (12, "don't 'll I'm 12345 $$$ | # line\nline\nline\n"),
]


@pytest.fixture(scope="session")
def rows():
    return TEXTS


@pytest.fixture(scope="session")
def docs(spark):
    """With further columns, some of them named as the operators' own are."""
    return spark.createDataFrame([(i, t, "en", "src", 5, i, i, "x") for i, t in TEXTS], "doc_id long, text string, lang string, source string, n_chars long, block long, key long, kept string")


@pytest.fixture(scope="session")
def empty(docs):
    return docs.limit(0)
