"""Quality rules with cross-document line frequency.

Lines are normalised and hashed; per host the rows that hold each line are counted, with partial
sums before the shuffle, then the distinct documents of the lines in many rows. Lines in too many
documents are taken as boilerplate. A
document most of whose words lie in such lines is depleted and rejected, as are documents that
fail the rules on their own words. All of it is DataFrame expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.llm.columns import blank_words, let
from riskloom.llm.texts import only
from riskloom.session import settle

LEAST_WORDS = 50
MOST_REPEATED = 0.5  # share of words in repeated three-word windows
LINE_DOCS = 30  # documents of a host that may share a line, at least
LINE_SHARE = 0.005  # and as a share of the host's documents
DEPLETED = 0.5  # share of words in boilerplate lines
_SYMBOLS = "#*$%&|<>"


def repeated_words(words: Column) -> Column:
    """Words that lie in a three-word window found at least twice in the array.

    Windows are compared by a 64-bit hash. Places of repeated windows, in order, each add the
    words that the one before did not cover.
    """
    def covered(hashes: Column) -> Column:
        placed = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def places(s: Column) -> Column:
            again = F.filter(s, lambda x, k: (F.get(s, k - 1)["h"] == x["h"]) | (F.get(s, k + 1)["h"] == x["h"]))
            return F.array_sort(F.transform(again, lambda x: x["i"]))

        start = F.struct(F.lit(-3).alias("last"), F.lit(0).cast("long").alias("n"))
        step = lambda a, i: F.struct(i.alias("last"), (a["n"] + F.least(F.lit(3), i - a["last"])).alias("n"))
        total = F.aggregate(let(placed, places), start, step, lambda a: a["n"])
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0).cast("long")).otherwise(total)

    starts = F.sequence(F.lit(1), F.size(words) - 2)
    windows = F.transform(starts, lambda i: F.xxhash64(F.element_at(words, i), F.element_at(words, i + 1), F.element_at(words, i + 2)))
    return F.when(F.size(words) < 3, F.lit(0).cast("long")).otherwise(let(windows, covered))


def normalised_lines(text: Column) -> Column:
    """(hash, words) of each line with a word: lower case, blanks collapsed and trimmed."""
    plain = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[\x20\x09\x0B-\x0D]+", " ")
    lines = F.filter(F.transform(F.split(plain, "\n"), lambda x: F.btrim(x, F.lit(" "))), lambda x: x != "")
    blanks = lambda x: F.length(x) - F.length(F.replace(x, F.lit(" "), F.lit("")))
    return F.transform(lines, lambda x: F.struct(F.xxhash64(x).alias("line"), (blanks(x) + 1).alias("words")))


def duplicate_lines(text: Column) -> Column:
    """Lines with a word that equal an earlier line of the text."""
    lines = F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: F.btrim(x, F.lit(" \t\x0b\f\r")) != "")
    return let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long")


def judge(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", least_words: int = LEAST_WORDS,
    line_docs: int = LINE_DOCS, line_share: float = LINE_SHARE, depleted: float = DEPLETED,
) -> DataFrame:
    """One row per row of ``docs``: ``doc_id``, the counts of its own text, ``n_removed_words``
    (in lines above the limit), ``base_failed`` and ``kept``.

    A line is removed if more than ``line_docs`` documents of its host hold it, and more than
    ``line_share`` of the host's rows; a document counts once per line. A document is depleted
    if over ``depleted`` of its words go. Null and empty texts have no words and fail. Documents
    without a host share one. Rows that share an id are one document of the host to the count of
    a line, and each judged by its own text; a row without an id is a document of its own.
    """
    text = F.col("text")
    own = only(docs, doc_id=id_col, text=text_col, host=host_col).select(
        F.monotonically_increasing_id().alias("_row"), F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("host").cast("string"), F.lit("")).alias("host"), "text", blank_words(text).alias("words"))
    symbols = F.length(text) - F.length(F.translate(text, _SYMBOLS, ""))
    measured = own.select(
        "_row", "doc_id", "host", F.size("words").cast("long").alias("n_words"),
        F.length(F.translate(F.coalesce(text, F.lit("")), " \t\n\x0b\f\r", "")).cast("long").alias("word_chars"),
        F.coalesce(symbols, F.lit(0)).cast("long").alias("n_symbols"), duplicate_lines(text).alias("n_dup_lines"),
        repeated_words(F.col("words")).alias("n_repeat_words"), normalised_lines(text).alias("lines"))
    measured = settle(measured, "quality-measured")
    hosts = measured.groupBy("host").agg(F.count("*").alias("host_docs"))
    once = measured.select("host", F.explode(F.array_distinct(F.transform("lines", lambda x: x["line"]))).alias("line"))
    # rows bound documents from above, so counting them first leaves few lines to count documents of
    counted = once.groupBy("host", "line").agg(F.count("*").alias("n")).filter(F.col("n") > line_docs).join(hosts, "host")
    often = counted.filter(F.col("n") > line_share * F.col("host_docs")).select("host", "line", "host_docs")
    document = F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("row "), "_row"))
    lines = measured.select("_row", document.alias("_doc"), "host", F.explode("lines").alias("x")).select("_row", "_doc", "host", "x.line", "x.words")
    held = settle(lines.join(often, ["host", "line"]), "quality-held")
    documents = held.groupBy("host", "line", "host_docs").agg(F.countDistinct("_doc").alias("n"))
    frequent = documents.filter((F.col("n") > line_docs) & (F.col("n") > line_share * F.col("host_docs"))).select("host", "line")
    removed = held.join(frequent, ["host", "line"], "left_semi").groupBy("_row").agg(F.sum("words").alias("gone"))
    judged = measured.drop("lines").join(removed, "_row", "left").withColumn("n_removed_words", F.coalesce("gone", F.lit(0)).cast("long"))
    failed = (F.col("n_words") < least_words) | (100 * F.col("n_repeat_words") > 100 * MOST_REPEATED * F.col("n_words"))
    return judged.withColumn("base_failed", failed).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_removed_words", "base_failed",
        (~F.col("base_failed") & (F.col("n_removed_words") <= depleted * F.col("n_words"))).alias("kept"))
