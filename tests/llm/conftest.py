import pytest

SAME = "the quick brown fox jumps over the lazy dog and runs away from here to there and back again quite soon"


@pytest.fixture
def messy(spark):
    """Nulls, empty, blank, very long, unbroken and repeated texts, repeated and missing ids, columns with clashing names."""
    rows = [
        (1, None), (2, ""), (3, "  \n\t \x0b"), (4, "word " * 30_000), (5, SAME), (5, SAME), (None, "a text without an id"),
        (6, "x" * 60_000), (7, "123 456 - ..."), (8, SAME), (9, "a\n\n\nb\r\nc"), (10, "éß\U0001f600 日本語"), (None, None),
    ]
    clash = ("score", "fp", "text_hash", "spans", "key", "label", "found", "ids", "words", "d", "features")
    data = [(i, t, "en" if i else None, "s", 0, *["x"] * len(clash)) for i, t in rows]
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint, " + ", ".join(f"{c} string" for c in clash)
    return spark.createDataFrame(data, schema)
