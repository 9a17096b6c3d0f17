"""Token counts through a cache of digests.

The cache is a Parquet table of (content digest, tokenizer digest, token count) in a folder
that all executors share. Counting joins the digests of the documents to it; only texts whose
digest is missing are encoded, each distinct text once, and their counts are appended. The
digest of the tokenizer's file is part of the key, so a changed vocabulary never meets old counts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.llm.texts import as_bytes, only, portions
from riskloom.llm.tokens import encoder, named_path
from riskloom.session import settle

LIMIT = 512
_CACHE = "digest binary, version string, n_tokens long"


def tokenizer_version(tokenizer: str) -> str:
    """Digest of the tokenizer's file."""
    with open(named_path(tokenizer), "rb") as f:
        return hashlib.sha256(f.read()).hexdigest()


def _encode(tokenizer: str):
    if tokenizer.endswith(".model"):
        def count():
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_file=named_path(tokenizer))
            return lambda raw: len(model.encode(raw.decode("utf-8", "replace"), add_bos=False, add_eos=False))
    else:
        def count():
            ids = encoder(named_path(tokenizer)).ids
            return lambda raw: len(ids(raw)) // 4

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = count()
        for batch in portions(batches, keep_words=True):
            yield pa.RecordBatch.from_arrays([batch.column("digest"), pa.array([n(x) for x in as_bytes(batch.column("text"))], pa.int64())], names=["digest", "n_tokens"])

    return run


def read_cache(spark: SparkSession, cache: str) -> DataFrame:
    """The stored counts; an absent folder is an empty cache."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(cache)
    there = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path)
    return spark.read.schema(_CACHE).parquet(cache) if there else spark.createDataFrame([], _CACHE)


def count_tokens(docs: DataFrame, tokenizer: str, cache: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: ``doc_id``, ``n_bytes`` and ``n_tokens`` of the whole text.

    Texts are normalised in one way only: null becomes the empty text. Equal texts share one
    cache entry. Repeated rows each get their own row; other columns are not read. A job that
    is run again after a loss may append an entry twice; entries are read as a set.
    """
    spark = docs.sparkSession
    version = tokenizer_version(tokenizer)
    texts = only(docs, doc_id=id_col, text=text_col).withColumn("text", F.coalesce("text", F.lit("")))
    digested = texts.select(F.col("doc_id").cast("long").alias("doc_id"), F.octet_length("text").cast("long").alias("n_bytes"), F.unhex(F.sha2("text", 256)).alias("digest"), "text")
    stored = lambda: read_cache(spark, cache).filter(F.col("version") == version).groupBy("digest").agg(F.min("n_tokens").alias("n_tokens"))
    # Copies meet before the shuffle, so a text that a third of the rows hold is sent once per task.
    distinct = digested.groupBy("digest").agg(F.first("text").alias("text"))
    missing = distinct.join(stored().select("digest"), "digest", "left_anti")
    counted = missing.mapInArrow(_encode(tokenizer), "digest binary, n_tokens long").select("digest", F.lit(version).alias("version"), "n_tokens")
    counted.write.mode("append").parquet(cache)
    # Written down, so the join stands on plain shuffles and Spark can split a hot digest.
    counts = settle(stored(), "token-counts")
    return digested.drop("text").join(counts, "digest").select("doc_id", "n_bytes", "n_tokens")


def token_report(counted: DataFrame, limit: int = LIMIT) -> DataFrame:
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
