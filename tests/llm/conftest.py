import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def make(spark):
    """documents from (doc_id, text, lang, source) rows, with columns whose names could clash."""

    def of(rows):
        full = [(i, t, lang, src, None if t is None else len(t)) for i, t, lang, src in rows]
        return spark.createDataFrame(full, DOCS)

    return of


@pytest.fixture(scope="session")
def odd(make):
    """Nulls in every column, empty and blank texts, a long text, ties and repeated rows."""
    long = " ".join(f"word{k % 977} of the thing{k}" for k in range(20000))
    text = "The quick brown fox jumps over the lazy dog and runs to the river of gold. "
    return [
        (1, None, "en", "a"), (2, "", "en", None), (3, " \t\n ", None, "a"), (4, long, "en", "b"), (5, text * 3, None, None), (6, text * 3, "en", "b"),
        (7, text * 3 + "x", "en", "b"), (7, text * 3 + "x", "en", "b"), (8, "\U0001f98a é\x00 日本語", "xx", "c"), (None, text, "de", "c"), (None, text, "de", "c"), (9, "a", "en", ""),
    ]
