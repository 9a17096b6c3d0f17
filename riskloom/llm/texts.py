"""Byte-level helpers that the operators share inside Spark tasks."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.llm.tokens import encoder


def _word_table() -> bytes:
    """A-Z to lower case, every other ASCII character that is no letter or digit to a blank."""
    table = bytearray(range(256))
    for c in range(128):
        char = chr(c)
        table[c] = ord(char.lower()) if char.isalnum() else 0x20
    return bytes(table)


WORD_TABLE = _word_table()


def plain_words(raw: bytes) -> list[bytes]:
    """Lower-cased words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of UTF-8 bytes."""
    return raw.translate(WORD_TABLE).split()


def as_bytes(column: pa.Array | pa.ChunkedArray) -> list[bytes]:
    """UTF-8 bytes per row; null is the empty text."""
    return [x or b"" for x in column.cast(pa.large_binary()).to_pylist()]


def slices(raw: Sequence[bytes], size: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Ranges of rows that hold about ``size`` bytes each, so lists of words stay small."""
    start, held = 0, 0
    for i, text in enumerate(raw):
        held += len(text)
        if held >= size:
            yield start, i + 1
            start, held = i + 1, 0
    if start < len(raw):
        yield start, len(raw)


def portions(batches: Iterator[pa.RecordBatch], rows: int = 512, keep_words: bool = False) -> Iterator[pa.RecordBatch]:
    """The batches in slices of few rows, so a worker holds copies of few texts at a time.

    Workers live on from job to job: only tasks that encode keep the words an encoder knows.
    """
    if not keep_words:
        encoder.cache_clear()
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)
    pa.default_memory_pool().release_unused()  # workers live on and should not keep what tasks have used


def only(df: DataFrame, **columns: str) -> DataFrame:
    """The named columns under fixed names, so other columns of the input can never clash."""
    return df.select(*[F.col(f"`{source}`").alias(name) for name, source in columns.items()])
