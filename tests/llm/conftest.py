import pytest

pytest.importorskip("gutterline.llm")

#: Columns that clash with names that the operators use inside.
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, fp string, bucket string, block string, rank string, span string, held string, own_digest string, predicted string, __key string, __p string"


@pytest.fixture(scope="session")
def make(spark):
    """Documents from (doc_id, text) or (doc_id, text, lang), with clashing extra columns."""

    def build(*rows):
        full = [(r[0], r[1], r[2] if len(r) > 2 else "en", None, None, *["x"] * 11) for r in rows]
        return spark.createDataFrame(full, SCHEMA)

    return build


@pytest.fixture(scope="session")
def odd(make):
    """Nulls, empty and very long texts, repeated rows, one word, odd spaces."""
    return make(
        (1, None), (2, ""), (3, "word"), (None, "no id here at all"), (4, "  two\n\nlines\twith  spaces \n"), (5, "long " * 60_000), (6, "x" * 50_000), (7, "same text as another"), (8, "same text as another"),
        (9, "repeated row"), (9, "repeated row"), (10, "Ünïcödé ñ 日本語 😀 é text"), (None, None),
    )
