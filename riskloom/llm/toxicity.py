"""Toxicity as multiple-instance learning.

A document is a bag of sentences. Each sentence gets a probability from a sparse logistic model
over its words, the document the noisy-or of its sentences: it is toxic unless every sentence
is clean. Only document labels are used for training; the sentence scores that come out of it
locate the offending sentences.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskloom.llm.texts import as_bytes, only, portions

SAMPLE_DOCS = 8_000  # documents a model is fitted on at most
SAMPLE_BYTES = 16_000_000  # and bytes of their texts
THRESHOLD = 0.3
OFFENDING = 0.5
_STOPS = b".!?\n"


def _sentence_table() -> bytes:
    """A-Z to lower case, sentence ends to a line feed, other ASCII marks and blanks to a blank."""
    table = bytearray(range(256))
    for c in range(128):
        char = chr(c)
        table[c] = 0x0A if c in _STOPS else ord(char.lower()) if char.isalnum() else 0x20
    return bytes(table)


SENTENCE_TABLE = _sentence_table()


def sentences(raw: bytes) -> list[list[bytes]]:
    """Words of each sentence; ranges without a word are no sentences."""
    split = (s.split() for s in raw.translate(SENTENCE_TABLE).split(b"\n"))
    return [s for s in split if s]


PREFIXES = (4, 5, 6, 7, 8)  # bytes


def features(word: bytes) -> list[bytes]:
    """The word itself (marked by a blank) and its beginnings, so unseen forms of a stem count."""
    return [word + b" ", *[word[:n] for n in PREFIXES if len(word) >= n]]


@dataclass
class Model:
    """Feature weights and the bias of a sentence; one without weighted features is clean."""

    weights: dict[bytes, float]
    bias: float

    def __post_init__(self) -> None:
        # a word can only have a weight if its beginning is the beginning of a weighted feature
        self.heads = {f[:4].rstrip(b" ") for f in self.weights}

    def sentence(self, words: list[bytes]) -> float:
        """The log-odds of a sentence; each of its features counts once. Minus infinity without any."""
        found = {f for w in words if w[:4] in self.heads for f in features(w)} & self.weights.keys()
        return self.bias + sum(self.weights[f] for f in found) if found else float("-inf")


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(z, -40, 40)))


def screened(rows: list[tuple[bytes, int]], least_docs: int, lift: float) -> dict[bytes, int]:
    """Features that at least ``least_docs`` toxic documents hold, ``lift`` times as often as others.

    Only what toxic documents hold is counted in the others, so memory follows the former.
    """
    def held(text: bytes) -> set[bytes]:
        return {f for w in set(text.translate(SENTENCE_TABLE).split()) for f in features(w)}

    toxic = Counter(f for text, label in rows if label for f in held(text))
    often = {f for f, n in toxic.items() if n >= least_docs}
    clean = Counter(f for text, label in rows if not label for f in held(text) & often)
    n1 = sum(label for _, label in rows)
    bar = lift * (n1 + 1) / (len(rows) - n1 + 1)
    return {f: i for i, f in enumerate(sorted(f for f in often if toxic[f] + 0.5 >= bar * (clean[f] + 0.5)))}


def fit(rows: list[tuple[bytes, int]], least_docs: int = 4, lift: float = 3.0, steps: int = 300, rate: float = 0.1, sparsity: float = 2e-4) -> Model:
    """Maximum likelihood of the document labels under the noisy-or, with an L1 penalty.

    Equal texts with equal labels count once. Only features that pass ``screened`` get a weight.
    Without both labels there is nothing to tell apart: no feature has weight, all scores are 0.
    """
    rows = sorted(set(rows))
    y = np.array([label for _, label in rows], np.float64)
    if not len(y) or y.min() == y.max():
        return Model({}, 0.0)
    vocabulary = screened(rows, least_docs, lift)
    heads = {f[:4].rstrip(b" ") for f in vocabulary}
    column, row, doc = [], [], []
    for d, (text, _) in enumerate(rows):
        for s in sentences(text):
            found = {vocabulary[f] for w in s if w[:4] in heads for f in features(w) if f in vocabulary}
            if found:
                column += found
                row += [len(doc)] * len(found)
                doc.append(d)
    column, row, doc = (np.array(x, np.int64) for x in (column, row, doc))
    n_sentences, n_words = len(doc), len(vocabulary)
    weights, bias = np.zeros(n_words), np.array([-2.0])
    moments = [np.zeros(n_words), np.zeros(n_words), np.zeros(1), np.zeros(1)]
    for t in range(1, steps + 1):
        p = _sigmoid(bias[0] + np.bincount(row, weights[column], n_sentences))
        clean = np.bincount(doc, np.log1p(-np.minimum(p, 1 - 1e-12)), len(y))
        none = np.exp(clean)  # the chance that no sentence is toxic
        slope = (np.where(y == 1, -none / np.maximum(1 - none, 1e-6), 1.0) / len(y))[doc] * p
        for k, (value, gradient) in enumerate(((weights, np.bincount(column, slope[row], n_words) + sparsity * np.sign(weights)), (bias, np.array([slope.sum()])))):
            m, v = moments[2 * k], moments[2 * k + 1]
            m += 0.1 * (gradient - m)
            v += 0.01 * (gradient**2 - v)
            value -= rate / (np.sqrt(v / (1 - 0.99**t)) + 1e-8) * m / (1 - 0.9**t)
    words = list(vocabulary)
    return Model({words[i]: float(weights[i]) for i in np.flatnonzero(np.abs(weights) >= 0.05)}, float(bias[0]))


def held_out(doc_id: int) -> bool:
    return zlib.crc32(str(doc_id).encode()) % 4 == 2


def train(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
    sample_docs: int = SAMPLE_DOCS, sample_bytes: int = SAMPLE_BYTES,
) -> Model:
    """Fit on labelled documents outside the held-out quarter.

    At most ``sample_docs`` documents and ``sample_bytes`` of whole texts are taken, in the order
    of a hash of the id; of an id on several rows one text is taken, by a hash of it. Null labels, null ids and labels other than 0 and 1 are ignored; an id
    labelled both ways is ignored too.
    """
    spark = docs.sparkSession
    key = F.col("doc_id").cast("string")
    known = only(labels, doc_id=id_col, label=label_col).filter(F.col("doc_id").isNotNull() & F.col("label").isin(0, 1))
    known = known.filter(F.pmod(F.crc32(key), F.lit(4)) != 2).groupBy("doc_id").agg(F.min("label").alias("label"), F.max("label").alias("other"))
    known = known.filter("label = other").select("doc_id", F.col("label").cast("int").alias("label"))
    texts = only(docs, doc_id=id_col, text=text_col).withColumn("text", F.coalesce("text", F.lit("")))
    sizes = texts.select("doc_id", F.octet_length("text").cast("long").alias("size")).join(known, "doc_id")
    sizes = sizes.groupBy("doc_id", "label").agg(F.max("size").alias("size"))
    order = sizes.orderBy(F.xxhash64(key), "doc_id").limit(sample_docs).collect()  # ids and sizes only
    chosen, held = [], 0
    for r in sorted(order, key=lambda r: r["size"] > sample_bytes // 20):  # a giant never crowds out the others
        if held + r["size"] <= sample_bytes:
            held += r["size"]
            chosen.append((r["doc_id"], r["label"]))
    if not chosen:
        return fit([])
    wanted = F.broadcast(spark.createDataFrame(chosen, "doc_id long, label int"))  # sample_docs rows at most
    one = F.max_by("text", F.struct(F.xxhash64("text"), "text")).alias("text")
    rows = texts.join(wanted, "doc_id").groupBy("doc_id", "label").agg(one).select("text", "label").collect()  # sample_bytes at most
    return fit([(r["text"].encode("utf-8", "surrogatepass"), r["label"]) for r in rows])


_SCORES = T.StructType([
    T.StructField("doc_id", T.LongType()),
    T.StructField("score", T.DoubleType()),
    T.StructField("offending", T.ArrayType(T.StructType([
        T.StructField("sentence", T.LongType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("score", T.DoubleType())]))),
])


def score_text(raw: bytes, model: Model, offending: float = OFFENDING) -> tuple[float, list[dict]]:
    """Noisy-or score of a text and its offending sentences (number, byte range, score).

    A text without a weighted feature scores 0.
    """
    table, heads = raw.translate(SENTENCE_TABLE), model.heads
    if not any(w[:4] in heads for w in table.split()):
        return 0.0, []
    clean, place, located = 0.0, 0, []
    for number, s in enumerate(table.split(b"\n")):
        z = model.sentence(s.split())
        if z > -40:
            p = float(_sigmoid(np.array([z]))[0])
            clean += float(np.log1p(-min(p, 1 - 1e-12)))
            if p >= offending:
                located.append({"sentence": number, "start": place, "end": place + len(s), "score": p})
        place += len(s) + 1
    return max(0.0, float(-np.expm1(clean))), located


def _scoring(model, text_col: str, carry: bool = False, threshold: float = 0.0):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = model.value
        kind = pa.list_(pa.struct([("sentence", pa.int64()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))
        for batch in portions(batches):
            scored = [score_text(x, own) for x in as_bytes(batch.column(batch.schema.get_field_index(text_col)))]
            if carry:
                yield batch.filter(pa.array([s < threshold for s, _ in scored], pa.bool_()))
            else:
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id"), pa.array([s for s, _ in scored], pa.float64()), pa.array([x for _, x in scored], kind)], names=[f.name for f in _SCORES])

    return run


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: ``doc_id``, ``score`` in [0, 1] and the ``offending`` sentences.

    Null and empty texts score 0. Repeated rows each get their own row; other columns are not read.
    """
    texts = only(docs, doc_id=id_col, text=text_col).withColumn("doc_id", F.col("doc_id").cast("long"))
    return texts.mapInArrow(_scoring(docs.sparkSession.sparkContext.broadcast(model), "text"), _SCORES)


def keep_civil(docs: DataFrame, model: Model, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """Rows of ``docs`` whose score is below ``threshold``, with all their columns."""
    return docs.mapInArrow(_scoring(docs.sparkSession.sparkContext.broadcast(model), text_col, True, threshold), docs.schema)


def toxicity_report(scored: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    return scored.select(
        "doc_id", (F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(4)) == 2).alias("held_out"), "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"), "offending")
