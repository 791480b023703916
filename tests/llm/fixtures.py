"""Small tables with the cases that every corpus operator must stand: nulls, empty and long texts, ties, repeated rows, clashing columns."""

DOCS_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, h string, id long, m string, kept string, _key0 int, _gone0 int, out string"


def rows():
    base = [
        (1, "The quick brown fox jumps over the lazy dog near the river bank today"),
        (2, "The quick brown fox jumps over the lazy dog near the river bank today"),
        (3, "the QUICK brown fox\njumps over the lazy dog near the river bank today"),
        (4, None), (5, ""), (6, " \n\t "), (None, "a row without an id"), (7, "word"), (8, "two words"),
        (9, "Long " * 30_000), (10, "x" * 70_000), (11, "naïve Ünïcode — 日本語 😀 text\x85with odd blanks"),
        (12, "same row"), (12, "same row"), (13, None), (14, "stupid idiot, go away. The rest is fine."), (15, "contact a.b@example.com or +1 (614) 555-8001 <|endoftext|>"),
    ]
    return [(i, t, "en", None, None, 0.5, "h", 1, None, "k", 3, 4, None) for i, t in base]


def docs(spark):
    return spark.createDataFrame(rows(), DOCS_SCHEMA).repartition(3)


def empty(spark):
    return spark.createDataFrame([], DOCS_SCHEMA)
