"""Small tables that hold what an operator must cope with."""

from __future__ import annotations

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, fp string, spans int, owner string"


def odd_documents(spark, texts=()):
    """Nulls, empty, blank and very long texts, ties, repeated rows and columns with clashing names."""
    long_text = " ".join(f"word{i % 977} and" for i in range(30_000)) + "."
    rows = [
        (1, "The quick brown fox jumps over the lazy dog.\nA second line here.", "en", "a", 3, "x", 1, "o"),
        (2, "The quick brown fox jumps over the lazy dog.\nA second line here.", "en", "a", 3, None, 1, "o"),
        (3, None, None, None, None, None, None, None),
        (4, "", "en", "a", 0, "x", 1, "o"),
        (5, " \t\n\x0b\f\r ", "en", "b", 0, "x", 1, "o"),
        (6, long_text, "en", "b", 5, "x", 1, "o"),
        (7, "Ünïcödé ĀĒ naïve     日本 \U0001f600 ÉCOLE.", "fr", "b", 5, "x", 1, "o"),
        (8, "one", "en", "b", 5, "x", 1, "o"),
        (9, "one two", "en", "b", 5, "x", 1, "o"),
        (9, "one two", "en", "b", 5, "x", 1, "o"),
        (None, "one two three", "en", "b", 5, "x", 1, "o"),
        (10, "<|endoftext|> nul\x00byte \x7f", "en", "b", 5, "x", 1, "o"),
        *[(100 + i, t, "en", "c", len(t), "x", 1, "o") for i, t in enumerate(texts)],
    ]
    return spark.createDataFrame(rows, SCHEMA)


def no_documents(spark):
    return spark.createDataFrame([], SCHEMA)


def pairs(df):
    """(doc_id, text) of each row."""
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]


def rows(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)
