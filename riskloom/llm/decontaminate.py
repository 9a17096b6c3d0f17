"""Benchmark decontamination as a prefix-filtered set join.

Each item is cut into windows of ``window`` words (a shorter item is one window). A window is
contained in a text only if all of its word shingles are, so for exact containment the prefix
that must join is one shingle: the rarest by the number of places it has in the corpus.
Documents probe an index of these shingles; a hit fixes where the window would have to start
(positional bound) and that it ends inside the text (length bound), and the words are then
compared one by one.

The index of a block of windows is broadcast. A block holds at most ``block_windows`` windows
of bounded length, so its size is bounded whatever the item table; more windows mean more
blocks, each of which is one pass over the documents.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskloom.llm.texts import WORD_TABLE, as_bytes, only, portions, slices

WINDOW = 13
SHINGLE = 5
BLOCK_WINDOWS = 50_000
_MIX = np.uint64(0x9E3779B97F4A7C15)
_END = b"\x00"  # between texts; no word holds it

_HITS = T.StructType([
    T.StructField("doc_id", T.LongType()),
    T.StructField("digest", T.BinaryType()),
    T.StructField("n_words", T.LongType()),
    T.StructField("spans", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))),
    T.StructField("items", T.ArrayType(T.StringType())),
])


def plain_word_array(text: Column) -> Column:
    """Lower-cased words of a text as a column; null has none."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), upper, upper.lower()), F.lit(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"), F.lit(0))


def item_windows(items: DataFrame, window: int = WINDOW) -> DataFrame:
    """Distinct (item, words) rows: every ``window`` consecutive words, or a shorter item whole."""
    words = items.select(F.coalesce(F.col("item").cast("string"), F.lit("")).alias("item"), plain_word_array(F.col("text")).alias("w")).filter(F.size("w") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - window + 1, F.lit(1)))
    return words.select("item", F.explode(starts).alias("at"), "w").select("item", F.slice("w", F.col("at"), window).alias("words")).distinct()


class WindowIndex:
    """Windows of one block as word numbers, with an index from prefix shingle to windows."""

    def __init__(self, rows: list[tuple[str, list[str]]], shingle: int):
        vocabulary: dict[bytes, int] = {_END: -1}
        by_words: dict[tuple[int, ...], set[str]] = {}
        for item, words in rows:
            numbers = tuple(vocabulary.setdefault(w.encode(), len(vocabulary)) for w in words)
            by_words.setdefault(numbers, set()).add(item)
        self.vocabulary = vocabulary
        self.items = [sorted(x) for x in by_words.values()]
        self.lengths = np.array([len(x) for x in by_words], np.int64)
        self.words = np.full((len(by_words), int(self.lengths.max(initial=1))), -2, np.int64)
        for i, x in enumerate(by_words):
            self.words[i, : len(x)] = x
        self.sizes = np.unique(np.minimum(self.lengths, shingle))  # shingle lengths in use
        self.shingle = shingle
        self.keys: dict[int, np.ndarray] = {}
        self.index: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        for size in self.sizes.tolist():
            of = np.flatnonzero(np.minimum(self.lengths, shingle) == size)
            places = [(w, o) for w in of.tolist() for o in range(int(self.lengths[w]) - size + 1)]
            at = np.array(places, np.int64).reshape(-1, 2)
            key = shingle_keys(self.words[at[:, :1], at[:, 1:] + np.arange(size)].reshape(-1, size))
            self.keys[size] = np.unique(key)
            self.index[size] = (key, at[:, 0], at[:, 1])

    def keep_rarest(self, places: dict[tuple[int, int], int]) -> None:
        """Per window keep only the shingle with the fewest places in the corpus."""
        for size, (key, window, offset) in self.index.items():
            rarity = np.array([places.get((size, int(k)), 0) for k in key.astype(np.int64).tolist()], np.int64)
            order = np.lexsort((offset, rarity, window))
            first = order[np.unique(window[order], return_index=True)[1]]
            first = first[np.argsort(key[first], kind="stable")]
            self.index[size] = (key[first], window[first], offset[first])
            self.keys[size] = np.unique(key[first])


def shingle_keys(rows: np.ndarray) -> np.ndarray:
    """A 64-bit key per row of word numbers; equal rows have equal keys."""
    out = np.zeros(len(rows), np.uint64)
    for j in range(rows.shape[1]):
        out = (out ^ rows[:, j].astype(np.uint64)) * _MIX
        out ^= out >> np.uint64(29)
    return out


def numbered(raw: list[bytes], vocabulary: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray]:
    """Word numbers of all texts (0: not in the vocabulary, -1: a text ends) and where each ends."""
    words = (b" %b " % _END).join([x.translate(WORD_TABLE) for x in raw] + [b""]).split()
    get = vocabulary.get
    numbers = np.fromiter([get(w, 0) for w in words], np.int64, len(words))
    return numbers, np.flatnonzero(numbers == -1)


def shingle_places(numbers: np.ndarray, size: int, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where a shingle of ``size`` known words with one of ``keys`` starts, and its key."""
    n = len(numbers) - size + 1
    if n <= 0 or not len(keys):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    known = np.concatenate([[0], np.cumsum(numbers > 0)])
    at = np.flatnonzero(known[size:] - known[:n] == size)
    key = shingle_keys(numbers[at[:, None] + np.arange(size)])
    slot = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
    hit = keys[slot] == key
    return at[hit], key[hit]


def _count_places(index):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = index.value
        totals = {size: np.zeros(len(keys), np.int64) for size, keys in own.keys.items()}
        for batch in portions(batches):
            raw = as_bytes(batch.column("text"))
            for lo, hi in slices(raw):
                numbers, _ = numbered(raw[lo:hi], own.vocabulary)
                for size, keys in own.keys.items():
                    _, key = shingle_places(numbers, size, keys)
                    totals[size] += np.bincount(np.searchsorted(keys, key), minlength=len(keys))
        for size, keys in own.keys.items():
            some = np.flatnonzero(totals[size])
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(some), size, np.int32)), pa.array(keys[some].astype(np.int64)), pa.array(totals[size][some])], names=["size", "key", "n"])

    return run


def contained_windows(numbers: np.ndarray, ends: np.ndarray, own: WindowIndex) -> tuple[np.ndarray, np.ndarray]:
    """(start, window) of every window that occurs."""
    starts, windows = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for size, keys in own.keys.items():
        at, key = shingle_places(numbers, size, keys)
        held, window, offset = own.index[size]
        lo, hi = np.searchsorted(held, key, "left"), np.searchsorted(held, key, "right")
        many = hi - lo
        entry = np.repeat(lo - np.concatenate([[0], np.cumsum(many)[:-1]]), many) + np.arange(many.sum()) if len(many) else lo
        start, which = np.repeat(at, many) - offset[entry], window[entry]
        fits = (start >= 0) & (start + own.lengths[which] <= len(numbers))
        start, which = start[fits], which[fits]
        for j in range(own.words.shape[1]):  # text ends are numbered -1, so no window crosses one
            same = (own.lengths[which] <= j) | (numbers[np.minimum(start + j, len(numbers) - 1)] == own.words[which, j])
            start, which = start[same], which[same]
        starts.append(start)
        windows.append(which)
    return np.concatenate(starts), np.concatenate(windows)


def _probe(index, with_digest: bool):
    import hashlib

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = index.value
        span = pa.struct([("start", pa.int64()), ("end", pa.int64())])
        for batch in portions(batches):
            raw = as_bytes(batch.column("text"))
            n_words, spans, items = [], [], []
            for lo, hi in slices(raw):
                numbers, ends = numbered(raw[lo:hi], own.vocabulary)
                begins = np.concatenate([[0], ends[:-1] + 1])
                n_words += (ends - begins).tolist()
                found: list[tuple[list, set]] = [([], set()) for _ in range(hi - lo)]
                start, which = contained_windows(numbers, ends, own)
                order = np.argsort(start, kind="stable")
                start, which = start[order], which[order]
                doc = np.searchsorted(ends, start)
                for d, s, w in zip(doc.tolist(), (start - begins[doc]).tolist(), which.tolist()):
                    covered, seen = found[d]
                    seen.update(own.items[w])
                    end = s + int(own.lengths[w])
                    if covered and s <= covered[-1]["end"]:
                        covered[-1]["end"] = max(covered[-1]["end"], end)
                    else:
                        covered.append({"start": s, "end": end})
                spans += [c for c, _ in found]
                items += [sorted(s) for _, s in found]
            digests = [hashlib.sha256(x).digest() if with_digest else None for x in raw]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(digests, pa.binary()), pa.array(n_words, pa.int64()), pa.array(spans, pa.list_(span)), pa.array(items, pa.list_(pa.string()))],
                names=[f.name for f in _HITS])

    return run


def _merged(spans: Column) -> Column:
    """Sorted disjoint spans of a list of spans."""
    step = F.aggregate(
        F.array_sort(spans),
        F.lit(None).cast("array<struct<start:bigint,end:bigint>>"),
        lambda done, x: F.when(done.isNull(), F.array(x))
        .when(x["start"] <= F.element_at(done, -1)["end"],
              F.concat(F.slice(done, 1, F.size(done) - 1),
                       F.array(F.struct(F.element_at(done, -1)["start"].alias("start"), F.greatest(F.element_at(done, -1)["end"], x["end"]).alias("end")))))
        .otherwise(F.concat(done, F.array(x))))
    return F.coalesce(step, F.array().cast("array<struct<start:bigint,end:bigint>>"))


def find_contamination(
    docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
    window: int = WINDOW, shingle: int = SHINGLE, block_windows: int = BLOCK_WINDOWS,
) -> DataFrame:
    """One row per row of ``docs``: ``doc_id``, ``n_words``, ``spans`` (disjoint word ranges
    covered by item windows) and ``items`` (ids, as strings, of the items they come from).

    Null and empty texts have no words and no spans. Items without words are ignored; a null
    item id is listed as the empty string. Repeated items and repeated windows count once.
    Repeated document rows each get their own row. An empty item table leaves all spans empty.
    Other columns of either table are not read.
    """
    spark = docs.sparkSession
    texts = only(docs, doc_id=id_col, text=text_col).withColumn("doc_id", F.col("doc_id").cast("long"))
    windows = item_windows(only(items, item=item_col, text=item_text_col), window)
    blocks = max(1, math.ceil(windows.count() / block_windows))
    spread = windows.withColumn("block", F.pmod(F.xxhash64("item", "words"), F.lit(blocks)))
    parts = []
    for block in range(blocks):
        rows = [(r["item"], r["words"]) for r in spread.filter(F.col("block") == block).collect()]  # a block is bounded
        own = WindowIndex(rows, shingle)
        if rows:
            counted = texts.select("text").mapInArrow(_count_places(spark.sparkContext.broadcast(own)), "size int, key long, n long")
            places = {(r["size"], r["key"]): r["n"] for r in counted.groupBy("size", "key").agg(F.sum("n").alias("n")).collect()}  # shingles of the block
            own.keep_rarest(places)
        parts.append(texts.mapInArrow(_probe(spark.sparkContext.broadcast(own), blocks > 1), _HITS))
    if blocks == 1:
        return parts[0].drop("digest")
    every = parts[0]
    for part in parts[1:]:
        every = every.unionByName(part)
    # Each block has each row once; rows with the same id and text have the same result.
    joined = every.groupBy("doc_id", "digest", "n_words").agg(
        F.count("*").alias("rows"), F.flatten(F.collect_list("spans")).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    repeated = joined.withColumn("copy", F.explode(F.sequence(F.lit(1), (F.col("rows") / blocks).cast("int"))))
    return repeated.select("doc_id", "n_words", _merged(F.col("spans")).alias("spans"), "items")


def contamination_report(hits: DataFrame) -> DataFrame:
    """Counts, item digest and verdict: a hit text with at least one hit word in twenty goes."""
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda total, s: total + s["end"] - s["start"])
    return hits.withColumn("n_hit", n_hit).select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        ((F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"))
