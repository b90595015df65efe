import pytest

#: doc_id, text, lang, source, n_chars, and columns named as operators name theirs
FIELDS = "doc_id bigint, text string, lang string, source string, n_chars bigint, fp bigint, score string, lang_pred int, _ratio int, _host int, keep string, part int, n_tokens string, _label int, word string, key int"
LONG = "the quick brown fox " * 20_000
ROWS = [
    (1, "The quick brown fox jumps over the lazy dog and runs away. " * 3, "en", "a"),
    (2, "The quick brown fox jumps over the lazy dog and runs away. " * 3, "en", "a"),
    (3, None, None, None),
    (4, "", "en", "b"),
    (5, "12345 !!! --- 678", "en", None),
    (6, LONG, "en", "a"),
    (7, "Der schnelle braune Fuchs springt über den faulen Hund und läuft weg. " * 3, "de", "b"),
    (8, "word", None, "b"),
    (8, "word", None, "b"),
    (None, "a text without an id, which is a text all the same", "en", "a"),
    (10, "  two  spaces \t tab\nline\r\nend ▁ <s> <|endoftext|> 漢字 \U0001f600 é ", "de", "c"),
    (11, "a" * 5_000, "de", "c"),
    (12, "\x00\x1f   odd   white　space ", "en", "c"),
]


@pytest.fixture(scope="session")
def odd_docs(spark):
    rows = [(*r, len(r[1] or ""), 7, "x", 1, 2, 3, "k", 4, "n", 5, "w", 6) for r in ROWS]
    return spark.createDataFrame(rows, FIELDS).repartition(3).cache()


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.limit(0)
