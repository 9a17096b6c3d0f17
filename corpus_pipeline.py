"""The corpus pipeline: toxicity, near duplicates, benchmark passages, secrets, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; what it returns is written as
Parquet and read again as the next one's ``docs``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.llm import decontaminate, packing, secrets, simhash, toxicity
from riskloom.session import load, settle

TOKENIZER = "word_bpe_49k.json"


def civil(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below the threshold.

    Rows are judged one by one: repeated rows and null ids stay or go by their own text, null and
    empty texts score 0 and stay.
    """
    return toxicity.keep_civil(docs, toxicity.train(docs, load(spark, sf_dir, "labels")))


def numbered(docs: DataFrame, name: str) -> tuple[DataFrame, str]:
    """``docs`` written with a number for every row, and that column's name: ids may repeat or be null."""
    key = "_row"
    while key in docs.columns:
        key = f"_{key}"
    return settle(docs.withColumn(key, F.monotonically_increasing_id()), name), key


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each SimHash component: the one with the least id, rows without an id last.

    Repeated rows and rows that share an id are rows of their own here; of several with the least
    id the first written stays. Null and empty texts are one component.
    """
    rows, key = numbered(docs, "pipeline-rows")
    found = simhash.near_duplicates(rows, id_col=key).select(F.col("doc_id").alias(key), "component_id")
    members = settle(found.join(rows.select(key, F.col("doc_id").alias("_id")), key), "pipeline-members")
    order = F.struct(F.col("_id").isNull(), F.col("_id"), F.col(key).alias("_key"))
    first = members.groupBy("component_id").agg(F.min(order).alias("_first")).select(F.col("_first._key").alias(key))
    rest = members.join(first, key, "left_anti").select(key)
    return rows.join(rest, key, "left_anti").drop(key)


def uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows of which fewer than one word in twenty lies in a benchmark window.

    Every row is judged by its own text, whether its id repeats or is null. Null and empty texts
    have no words and stay.
    """
    rows, key = numbered(docs, "pipeline-rows")
    hits = decontaminate.find_contamination(rows, load(spark, sf_dir, "benchmark"), id_col=key)
    bad = decontaminate.contamination_report(hits).filter("contaminated").select(F.col("doc_id").alias(key))
    return rows.join(bad, key, "left_anti").drop(key)


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with every secret blotted out of the text and ``n_chars`` put right."""
    done = secrets.redact_secrets(docs)
    return done.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else done


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces with their sequence and place.

    Repeated rows and rows with a null id are packed each by themselves; a null or empty text is
    the end token alone.
    """
    return packing.pack_documents(docs, TOKENIZER)


STAGES = [("toxicity", civil), ("simhash", distinct), ("decontamination", uncontaminated), ("secrets", without_secrets), ("packing", packed)]

ORACLE_SQL = None  # SQL can express neither the classifier nor the packing


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = load(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
