"""Set operations over tables with differing columns, sources and repeats."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.operators.aggregates import first_by
from riskloom.session import settle


def union_all(frames: Sequence[DataFrame]) -> DataFrame:
    """All rows by column name; columns a frame lacks become null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def common_entities(df: DataFrame, entity: str, groups: Sequence[str]) -> DataFrame:
    """Entities present in every non-empty group, from one group-by and no self joins."""
    pairs = df.select(entity, *groups).distinct()
    total = pairs.select(*groups).distinct().agg(F.count("*").alias("_total"))
    held = pairs.groupBy(entity).agg(F.count("*").alias("_held"))
    return held.crossJoin(F.broadcast(total)).filter("_held = _total").select(entity)  # total: one row


def merge_relabelled(base: DataFrame, extra: DataFrame, pick: Column, renames: Mapping[str, str], labels: Mapping[str, str], column: str) -> DataFrame:
    """All of ``base`` and the picked rows of ``extra``, columns renamed and labels rewritten."""
    label = F.col(column)
    for old, new in labels.items():
        label = F.when(F.col(column) == old, new).otherwise(label)
    chosen = extra.filter(pick).withColumn(column, label).withColumnsRenamed(dict(renames))
    return base.unionByName(chosen, allowMissingColumns=True)


def merge_new_rows(old: DataFrame, new: DataFrame, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Old and new rows, one per key; an old row wins over a new one."""
    both = old.withColumn("_src", F.lit(0)).unionByName(new.withColumn("_src", F.lit(1)), allowMissingColumns=True)
    return first_by(both, key, ["_src", *order]).drop("_src")


def distinct_entities(frames: Sequence[tuple[DataFrame, str]], name: str = "project") -> DataFrame:
    """Distinct trimmed entity names over tables that spell the column differently."""
    parts = [df.select(F.trim(F.col(c).cast("string")).alias(name)).distinct() for df, c in frames]
    return union_all(parts).filter(F.col(name) != "").distinct()


def canonical_rows(df: DataFrame, canonical: DataFrame, keys: Sequence[str], entity: str) -> tuple[DataFrame, DataFrame]:
    """Rows of the canonical source, and kept and original counts per entity."""
    wanted = settle(canonical.select(*keys).distinct(), "canonical")  # its size is known before the rows are shuffled
    flagged = df.join(wanted.withColumn("_keep", F.lit(1)), list(keys), "left")
    counts = flagged.groupBy(entity).agg(F.count("_keep").alias("kept"), F.count("*").alias("original"))
    return flagged.filter("_keep = 1").drop("_keep"), counts


def not_yet_done(new: DataFrame, done: DataFrame, keys: Sequence[str], ignore_case: bool = False) -> DataFrame:
    """Rows whose key has not been written before."""
    if not ignore_case:
        return new.join(done.select(*keys).distinct(), list(keys), "left_anti")
    lowered = {f"_lc{i}": F.lower(k) for i, k in enumerate(keys)}
    seen = done.select(*[e.alias(n) for n, e in lowered.items()]).distinct()
    return new.withColumns(lowered).join(seen, list(lowered), "left_anti").drop(*lowered)
