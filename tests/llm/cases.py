"""Small tables that hold what the operators must bear."""

from __future__ import annotations

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long, score double, part string, tie int, node string"


def documents(spark, rows):
    """rows: (doc_id, text, lang, source); the other columns clash with names that operators use."""
    return spark.createDataFrame([(i, t, la, s, len(t or ""), 9.5, "p", 7, "n") for i, t, la, s in rows], DOCUMENTS)


def awkward(spark):
    long = " ".join(f"word{i % 997} lang{i}" for i in range(30_000))
    return documents(spark, [
        (1, None, "en", "a"), (2, "", None, None), (3, "  \t\n ", "de", ""), (4, "one two three", "en", "a"), (5, long, "en", "a"),
        (6, "Ünïcödé ß 日本語 текст \U0001d518 <|endoftext|> don't", "fr", "b"), (7, "the same text here as there", "en", "a"),
        (8, "the same text here as there", "en", "b"), (9, "THE SAME text  here as\nthere", None, "b"), (None, "no id at all in this row", "en", None),
        (10, "twice the same row is given", "en", "a"), (10, "twice the same row is given", "en", "a"), (11, "!!! ??? ...", "es", "c")])


def empty(spark):
    return documents(spark, [])
