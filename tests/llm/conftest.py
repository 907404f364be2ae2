import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def make(spark):
    """A documents table from (doc_id, text[, lang[, source]])."""

    def docs(rows):
        full = [(r[0], r[1], r[2] if len(r) > 2 else None, r[3] if len(r) > 3 else None, None) for r in rows]
        return spark.createDataFrame(full, DOCS)

    return docs


@pytest.fixture(scope="session")
def odd(make):
    """Nulls, empty and long texts, repeated rows, ties, odd characters."""
    long = " ".join(f"w{k % 97} x{k % 13}" for k in range(40_000))
    return make([
        (1, None), (2, ""), (3, " \t\n"), (4, "one"), (4, "one"), (5, "one"), (6, long), (7, long + " end"), (None, "no key"), (None, None),
        (8, "naïve 日本 \u0000 emoji 🎉 <|endoftext|> tail"), (9, "!!! ... 123"), (10, "one two three four five six seven"), (11, "one two three four five six seven"), (12, " 　x"),
    ])
