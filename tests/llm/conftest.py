"""Small documents with every awkward case: nulls, empty and very long texts, ties, repeated rows, extra columns."""

import pytest

DOC_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, size int, component_id long"


def doc(i, text, lang="en", source="a"):
    return (i, text, lang, source, None if text is None else len(text), 0.5, 3, 9)


@pytest.fixture(scope="session")
def awkward(spark):
    """Documents with clashing extra columns."""
    rows = [
        doc(1, "the cat sat on the mat and the dog lay by the door of the house"),
        doc(2, "The cat sat on the mat and the dog lay by the door of the house"),
        doc(3, None, None, None),
        doc(4, "", "en", ""),
        doc(5, "   \t\n ", "en", "b"),
        doc(6, "x" * 200_000, "en", "b"),
        doc(7, "word " * 60_000, "de", "b"),
        doc(8, "l'été à la plage: où êtes-vous, Zoë? ½ ² ß İstanbul \x1c sep line", "fr", "c"),
        doc(9, "l'été à la plage", "fr", "c"),
        doc(9, "l'été à la plage", "fr", "c"),
        doc(None, "no id here at all", "en", "c"),
        doc(11, "<|endoftext|> it's 12 o'clock, isn't it?", "en", "d"),
        doc(12, "12345 67890 !!! ???", "en", "d"),
    ]
    return spark.createDataFrame(rows, DOC_SCHEMA)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOC_SCHEMA)
