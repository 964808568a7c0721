"""Small documents with the awkward cases that every operator has to bear."""

SCHEMA = "doc_id long, text string, lang string, label string, digest string, n int, class string"


def frame(spark, rows):
    """Documents with extra columns, some of whose names the operators use themselves."""
    full = [(i, t, "en", "x", "y", 1, "z") for i, t in rows]
    return spark.createDataFrame(full, SCHEMA)


AWKWARD = [
    (1, None),
    (2, ""),
    (None, "a null id"),
    (3, "the same text twice"),
    (3, "the same text twice"),
    (4, "\n\n \t\n"),
    (5, "日本語 \U0001F600 Ünïcode ſ İ"),
    (6, "word " * 30000),
    (7, "x" * 5000),
]
