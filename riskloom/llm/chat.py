"""Chat formatting after collapsing cumulative snapshots.

Chat logs often hold a conversation once per turn, each snapshot a prefix of the next. Every
turn is hashed with its number and role; the running sum of these hashes identifies each prefix
of a conversation. A conversation whose whole sum is a proper prefix of another one is dropped
by an anti-join, equal ones keep the least id. What is left is rendered.

Running sums are cut into chunks of turns, distinct prefixes are counted out before the join,
and rendered texts hold a bounded number of turns, so one very long conversation or one very
common opening never meets in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.llm.texts import only
from riskloom.operators.scans import running_totals
from riskloom.session import settle

CHUNK = 64  # turns in a chunk and in a rendered text
_KEY = ["last", "n", "a", "b"]


def _sums() -> dict[str, Column]:
    """Two independent 64-bit hashes of a turn, summed without overflow."""
    of = lambda *salt: F.xxhash64(*salt, "turn", "role", "text").cast("decimal(38,0)")
    return {"a": of(), "b": of(F.lit("second"))}


def prefixes(rows: DataFrame) -> DataFrame:
    """(conv_id, last, n, a, b): up to turn ``last``, the number of rows and the hash sums."""
    turns = rows.groupBy("conv_id", "turn").agg(F.count("*").alias("rows"), *[F.sum(e).alias(f"own_{k}") for k, e in _sums().items()])
    totals = running_totals(turns, ["conv_id"], F.floor(F.col("turn") / CHUNK), ["turn"], {"n": F.col("rows"), "a": F.col("own_a"), "b": F.col("own_b")})
    return totals.select("conv_id", F.col("turn").alias("last"), "n", "a", "b")


def maximal(rows: DataFrame) -> DataFrame:
    """(conv_id, copies) of conversations that are no proper prefix of another; equal ones count
    as ``copies`` of the least id."""
    sums = settle(prefixes(rows), "chat-prefixes")
    whole = sums.groupBy("conv_id").agg(F.max_by(F.struct(*_KEY), "last").alias("k")).select("conv_id", "k.*")
    distinct = whole.groupBy(*_KEY).agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("copies"))
    ends = whole.select(F.col("conv_id").alias("_of"), F.col("last").alias("_end"))
    proper = sums.join(ends, F.col("conv_id").eqNullSafe(F.col("_of"))).filter("last < _end").select(*_KEY).distinct()
    return distinct.join(proper, _KEY, "left_anti").select("conv_id", "copies")


def format_chats(
    table: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", chunk: int = CHUNK,
) -> DataFrame:
    """Rendered maximal conversations: ``conv_id``, ``part``, ``n_turns``, ``copies``, ``text``.

    A part holds the turns from ``part * chunk`` on; each row is rendered as its role in
    angle brackets, a line feed, its text and an end mark, in the order of turn, role and text.
    Repeated rows count once. A null turn comes before turn 0, a null role or text is empty,
    rows with a null id form one conversation. Empty texts are rendered as empty turns. Other
    columns are not read.
    """
    rows = only(table, conv_id=id_col, turn=turn_col, role=role_col, text=text_col).select(
        F.col("conv_id").cast("long").alias("conv_id"), F.coalesce(F.col("turn").cast("long"), F.lit(-1)).alias("turn"),
        F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).distinct()
    rows = settle(rows, "chat-rows")
    kept = maximal(rows).withColumnRenamed("conv_id", "_kept")
    chosen = rows.join(kept, F.col("conv_id").eqNullSafe(F.col("_kept")))
    parts = chosen.withColumn("part", F.greatest(F.floor(F.col("turn") / chunk), F.lit(0)).cast("long"))
    grouped = parts.groupBy("conv_id", "part", "copies").agg(F.count("*").alias("n_turns"), F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))
    line = lambda t: F.concat(F.lit("<|"), t["role"], F.lit("|>\n"), t["text"], F.lit("<|end|>\n"))
    return grouped.select("conv_id", "part", "n_turns", "copies", F.array_join(F.transform("turns", line), "").alias("text"))
