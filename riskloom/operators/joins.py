"""Joins by shifted days, as-of days, intervals, suffixes, positions and thresholds.

Every join has an equality key. As-of and first-crossing lookups are windows over the
union of both sides' distinct keys instead of range joins, so they cost one sort and emit
one row per probe. No side is broadcast by hand: Spark broadcasts what it measures as small.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskloom.functions import clean
from riskloom.operators import scans as sc


def lookup(df: DataFrame, table: DataFrame, keys: Sequence[str], defaults: Mapping[str, object]) -> DataFrame:
    """Left lookup; values missing in the table take their default."""
    out = df.join(table, list(keys), "left")
    return out.withColumns({c: F.coalesce(F.col(c), F.lit(v)) for c, v in defaults.items()})


def flag_members(df: DataFrame, members: DataFrame, keys: Sequence[str], name: str) -> DataFrame:
    """1 where the keys occur in ``members``, else 0."""
    known = members.select(*keys).distinct().withColumn("_hit", F.lit(1))
    return df.join(known, list(keys), "left").withColumn(name, F.coalesce("_hit", F.lit(0))).drop("_hit")


def as_of_day_lag(
    df: DataFrame, daily: DataFrame, entity: str, lag: int, values: Sequence[str], flag: str, order: Sequence[str | Column] = (), day: str = "day"
) -> DataFrame:
    """Values of exactly day - lag and whether that day had a row; its first row counts."""
    if order:
        first = F.min_by(F.struct(*values), F.struct(*[clean.as_col(o) for o in order]))
        daily = daily.groupBy(entity, day).agg(first.alias("_v")).select(entity, day, "_v.*")
    shifted = daily.select(entity, F.date_add(day, lag).alias(day), *values, F.lit(1).alias(flag))
    return df.join(shifted, [entity, day], "left").withColumn(flag, F.coalesce(flag, F.lit(0)))


def align_to_timeline(df: DataFrame, timeline: DataFrame, entity: str, day: str, timeline_day: str = "day") -> DataFrame:
    """Next timeline day at or after ``day``, held inside the timeline's ends, with a status."""
    w = Window.partitionBy(entity).orderBy("_d")
    probes = df.filter(F.col(day).isNotNull()).select(entity, F.col(day).alias("_d"), F.lit(None).cast("date").alias("_t"))
    stops = timeline.select(entity, F.col(timeline_day).alias("_d"), F.col(timeline_day).alias("_t"))
    merged = probes.unionByName(stops).groupBy(entity, "_d").agg(F.max("_t").alias("_t"))
    whole = Window.partitionBy(entity)
    marked = merged.select(
        entity,
        F.col("_d").alias(day),
        F.min("_t").over(w.rowsBetween(0, Window.unboundedFollowing)).alias("_next"),
        F.min("_t").over(whole).alias("_first"),
        F.max("_t").over(whole).alias("_last"),
    )
    d = F.col(day)
    status = (
        F.when(d.isNull() | F.col("_first").isNull(), "missing")
        .when(d < F.col("_first"), "before_start")
        .when(d > F.col("_last"), "after_end")
        .otherwise("within_range")
    )
    out = df.join(marked, [entity, day], "left")
    return out.withColumns({"aligned_day": F.coalesce("_next", "_last"), "align_status": status}).drop("_next", "_first", "_last")


def interval_join(rows: DataFrame, windows: DataFrame, entity: str, day: str, start: str, end: str) -> DataFrame:
    """Rows whose day lies in a window of the same entity; a null start is open.

    A window per fold: every row meets at most as many windows as its entity has folds.
    """
    inside = (F.col(day) <= F.col(end)) & (F.col(start).isNull() | (F.col(day) >= F.col(start)))
    w = windows.withColumnRenamed(entity, "_we")
    return rows.join(w, (F.col(entity) == F.col("_we")) & inside).drop("_we")


def first_crossing(
    events: DataFrame, targets: DataFrame, keys: Sequence[str], reach: str, event_no: str, target: str, eps: float = 1e-9
) -> DataFrame:
    """For each distinct (keys, target) the first event whose reach is at least the target.

    Only events that raise the running maximum can be first. Downwards in reach, events and
    distinct targets then stand in one order, in which the least event number so far is the
    answer. Both are prefix scans over ranges of their order, so a key may hold any share of
    the events.
    """
    rows = sc.in_ranges(events.select(*keys, event_no, reach), keys, [event_no], "crossing-events")
    records = sc.prefix_scan(rows, keys, [F.asc(event_no)], {"_best": ("max", F.col(reach))}, include_current=False)
    records = records.filter("_best IS NULL OR " + reach + " > _best")
    side_a = records.select(*keys, (F.col(reach) + eps).alias("_at"), F.col(event_no).alias("_no"), F.lit(None).cast("double").alias("_t"))
    side_b = targets.select(*keys, target).distinct().select(
        *keys, F.col(target).cast("double").alias("_at"), F.lit(None).cast(events.schema[event_no].dataType).alias("_no"), F.col(target).cast("double").alias("_t")
    )
    # an event that reaches a target exactly stands before it
    order = [F.desc("_at"), F.asc_nulls_last("_no")]
    both = sc.in_ranges(side_a.unionByName(side_b), keys, order, "crossing-targets")
    found = sc.prefix_scan(both, keys, order, {"_hit": ("min", F.col("_no"))})
    return found.filter("_t IS NOT NULL").select(*keys, F.col("_t").alias(target), F.col("_hit").alias("hit_no"))


# Lengths of path endings used as join keys.
_ENDINGS = [1, 2, 4, 8, 16, 32, 64]


def suffix_join(targets: DataFrame, candidates: DataFrame, entity: Sequence[str], path: str, candidate: str, ending: str = "") -> DataFrame:
    """Best candidate whose path ends with the target path: most equal trailing parts, then shortest.

    A target is joined on its longest ending of a fixed length, which any match shares, so
    a common file name does not gather all paths; shorter endings only serve short targets.
    """
    wanted = targets.select(*entity, path).distinct()
    size = F.lit(0)
    for n in _ENDINGS:
        size = F.when(F.length(path) >= n, n).otherwise(size)
    probes = wanted.withColumn("_size", size).withColumn("_block", F.right(path, F.col("_size")))
    bare = F.regexp_replace(candidate, F.lit(ending.replace(".", r"\.") + "$"), F.lit("")) if ending else F.col(candidate)
    named = candidates.select(*entity, candidate).distinct().withColumn("_bare", bare)
    blocks = named.withColumn("_size", F.explode(F.array(*[F.lit(n) for n in _ENDINGS])))
    blocks = blocks.filter(F.length("_bare") >= F.col("_size")).withColumn("_block", F.right("_bare", F.col("_size")))
    pairs = probes.join(blocks, [*entity, "_size", "_block"]).filter(F.col("_bare").endswith(F.col(path)))
    a, b = F.reverse(F.split(path, "/")), F.reverse(F.split("_bare", "/"))
    same = F.size(F.filter(F.arrays_zip(a.alias("a"), b.alias("b")), lambda z: z["a"] == z["b"]))
    scored = pairs.withColumn("_same", same)
    best = F.min_by(F.col(candidate), F.struct(-F.col("_same"), F.length(candidate), F.col(candidate)))
    return scored.groupBy(*entity, path).agg(best.alias(candidate))


def covered_lines(added: DataFrame, report: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Added lines that the report has at the same number with the same text, and how many of them ran."""
    seen = report.select(*keys, "line_no", F.col("content").alias("_content"), F.col("execute").alias("_execute"))
    joined = added.join(seen, [*keys, "line_no"], "left")
    ran = (F.col("content") == F.col("_content")) & (F.col("_execute") > 0)
    return joined.groupBy(*keys).agg(F.count("*").alias("total_added_lines"), F.count_if(ran).alias("covered_added_lines"))
