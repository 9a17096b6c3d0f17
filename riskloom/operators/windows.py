"""Window operators over daily tables.

Unless a function says otherwise its input has one row per entity and day, so a window
partition is bounded by the number of days on record, whatever the raw data holds.
Functions over raw rows go through ``scans``, which cuts hot entities into chunks.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from riskloom.operators.scans import running_totals

UNBOUNDED = Window.unboundedPreceding


def by_day(entity: str | Sequence[str], day: str = "day"):
    keys = [entity] if isinstance(entity, str) else list(entity)
    return Window.partitionBy(*keys).orderBy(day)


def by_day_number(entity: str | Sequence[str], day: str = "day"):
    keys = [entity] if isinstance(entity, str) else list(entity)
    return Window.partitionBy(*keys).orderBy(F.unix_date(day))


def capacity_timeline(df: DataFrame, rate: str, entity: str = "project", day: str = "day") -> DataFrame:
    """Day index per entity and the range of work units each day stands for."""
    r = F.greatest(F.coalesce(F.col(rate), F.lit(0)), F.lit(0)).cast("bigint")
    out = df.withColumns({"day_index": F.row_number().over(by_day(entity, day)), rate: r})
    total = F.col("day_index") * F.col(rate)
    return out.withColumns(
        {
            "unit_start": F.when(F.col(rate) > 0, total - F.col(rate) + 1).otherwise(total),
            "unit_end": total,
            "cumulative_units": total,
        }
    )


def calendar_lag(df: DataFrame, entity: str, values: Sequence[str], lag: int, suffix: str, day: str = "day") -> DataFrame:
    """Value exactly ``lag`` calendar days earlier; null where that day has no row."""
    frame = by_day_number(entity, day).rangeBetween(-lag, -lag)
    return df.withColumns({f"{v}{suffix}": F.max(v).over(frame) for v in values})


def lag_and_delta(df: DataFrame, entity: str, value: str, lag: int, day: str = "day") -> DataFrame:
    """``value`` as of day - lag and its change against the day before that."""
    w = by_day_number(entity, day)
    prev = F.max(value).over(w.rangeBetween(-lag, -lag))
    before = F.max(value).over(w.rangeBetween(-lag - 1, -lag - 1))
    return df.withColumns({f"{value}_lag": prev, f"{value}_delta": prev - before})


def expanding_median(df: DataFrame, entity: str | Sequence[str], value: str, qualifies: Column, name: str, day: str = "day") -> DataFrame:
    """Exact median of earlier qualifying rows; null before the first of them."""
    frame = by_day(entity, day).rowsBetween(UNBOUNDED, -1)
    return df.withColumn(name, F.percentile(F.when(qualifies, F.col(value)), F.lit(0.5)).over(frame))


def past_event_counts(
    probes: DataFrame, events: DataFrame, keys: Sequence[str], windows: Sequence[int] = (30, 90, 180), day: str = "day"
) -> DataFrame:
    """For each distinct (key, day) of ``probes``: earlier event days, ever and in trailing windows.

    Counts are strictly between day - N and day. Both sides shrink to distinct (key, day)
    first, so a key met in a third of all rows still has at most one row per day.
    """
    w = by_day_number(keys, day)
    marks = probes.select(*keys, day).withColumns({"_probe": F.lit(1), "_event": F.lit(0)}).unionByName(
        events.select(*keys, day).withColumns({"_probe": F.lit(0), "_event": F.lit(1)})
    )
    days = marks.groupBy(*keys, day).agg(F.max("_probe").alias("_probe"), F.max("_event").alias("_event"))
    earlier = w.rangeBetween(UNBOUNDED, -1)
    columns = {
        "count_ever": F.coalesce(F.sum("_event").over(earlier), F.lit(0)),
        "last_day": F.max(F.when(F.col("_event") == 1, F.col(day))).over(earlier),
    }
    for n in windows:
        columns[f"count_{n}d"] = F.coalesce(F.sum("_event").over(w.rangeBetween(-(n - 1), -1)), F.lit(0))
    return days.withColumns(columns).filter("_probe = 1").drop("_probe", "_event")


def sequential_chunks(df: DataFrame, entity: str, k: int, name: str = "chunk", day: str = "day") -> DataFrame:
    """Consecutive chunks of ceil(n / k) rows, numbered from 0 (the last may be short)."""
    n = F.count("*").over(Window.partitionBy(entity))
    size = F.greatest(F.ceil(n / F.lit(k)), F.lit(1))
    return df.withColumn(name, F.floor((F.row_number().over(by_day(entity, day)) - 1) / size))


def walk_forward(df: DataFrame, entity: str, k: int, recent: bool = False, day: str = "day") -> tuple[DataFrame, DataFrame]:
    """Fold table and row assignments: fold i tests chunk i, trains on earlier chunks or the last one."""
    chunked = sequential_chunks(df, entity, k, "_chunk", day)
    bounds = chunked.groupBy(entity, "_chunk").agg(F.min(day).alias("test_start"), F.max(day).alias("test_end"), F.count("*").alias("test_rows"))
    w = Window.partitionBy(entity).orderBy("_chunk")
    frame = w.rowsBetween(-1, -1) if recent else w.rowsBetween(UNBOUNDED, -1)
    folds = (
        bounds.withColumns(
            {
                "train_start": F.min("test_start").over(frame),
                "train_end": F.max("test_end").over(frame),
                "train_rows": F.sum("test_rows").over(frame),
            }
        )
        .filter("_chunk >= 1")
        .withColumn("fold", F.concat(F.lit("fold-"), F.col("_chunk")))
    )
    columns = [entity, "_chunk", "fold", "train_start", "train_end"]
    assignments = chunked.join(folds.select(*columns), [entity, "_chunk"]).drop("_chunk")
    return folds.drop("_chunk"), assignments


def previous_row(df: DataFrame, entity: str | Sequence[str], value: str, name: str, day: str = "day") -> DataFrame:
    """Pair each row with the value of the row before it; first rows drop out."""
    return df.withColumn(name, F.lag(value).over(by_day(entity, day))).filter(F.col(name).isNotNull())


def allocate_budget(df: DataFrame, entity: str, requested: str, budget: str, order: str, name: str = "allocated") -> DataFrame:
    """Share an integer budget by request: floors first, leftovers by largest remainder.

    Requests that fit are granted whole; a null budget means no cap.
    """
    w = Window.partitionBy(entity)
    req = F.greatest(F.col(requested), F.lit(0)).cast("bigint")
    cap = F.when(F.col(budget).isNotNull(), F.greatest(F.bround(F.col(budget), 0), F.lit(0))).cast("bigint")
    step1 = df.withColumns({"_req": req, "_cap": cap}).withColumn("_sum", F.sum("_req").over(w))
    scaled = F.col("_req") * (F.col("_cap").cast("double") / F.col("_sum"))
    step2 = step1.withColumn("_scaled", F.when(F.col("_sum") > 0, scaled).otherwise(F.lit(0.0)))
    step3 = step2.withColumn("_base", F.least(F.floor("_scaled"), F.col("_req")))
    left = F.col("_cap") - F.sum("_base").over(w)
    place = F.row_number().over(w.orderBy(F.desc(F.col("_scaled") - F.col("_base")), F.desc("_req"), order))
    extra = F.when((place <= left) & (F.col("_base") < F.col("_req")), 1).otherwise(0)
    granted = F.when(F.col("_cap").isNull() | (F.col("_sum") <= F.col("_cap")), F.col("_req")).otherwise(F.col("_base") + extra)
    return step3.withColumn(name, granted.cast("bigint")).drop("_req", "_cap", "_sum", "_scaled", "_base")


def timeline_summary(timeline: DataFrame, entity: str = "project", day: str = "day") -> DataFrame:
    """First and last entry per entity."""
    last = ["day_index", "cumulative_units"]
    return timeline.groupBy(entity).agg(
        F.max(day).alias("last_day"),
        *[F.max_by(c, day).alias(c) for c in last],
        F.min_by("unit_start", day).alias("unit_start"),
        F.max_by("unit_end", day).alias("unit_end"),
    )


def running_id(df: DataFrame, keys: Sequence[str], count: str, name: str, day: str = "day") -> DataFrame:
    """Running sum of a count up to and including each row, used as an id."""
    return df.withColumn(name, F.sum(count).over(by_day(keys, day).rowsBetween(UNBOUNDED, 0)))


def peer_percentile(df: DataFrame, project: str, member: str, day: str = "day", window: int = 30) -> DataFrame:
    """Rank of each member's trailing count among all members active then, ties averaged.

    A member's trailing count changes only on a day with events and when they leave the window, so
    there are two change points per member and day with events. Each moves the member from one
    count to another; these moves, added up per count, give the number of members at every
    count and day, and the ranking runs over distinct counts and not over members.
    """
    daily = df.groupBy(project, member, day).agg(F.count("*").alias("_n"))
    enter = daily.select(project, member, day, "_n", F.lit(True).alias("_active"))
    leave = daily.select(project, member, F.date_add(day, window + 1).alias(day), (-F.col("_n")).alias("_n"), F.lit(False).alias("_active"))
    points = enter.unionByName(leave).groupBy(project, member, day).agg(F.sum("_n").alias("_n"), F.max("_active").alias("_active"))
    points = points.withColumn("own_count", F.sum("_n").over(by_day([project, member], day)))

    move = lambda count, by: F.struct(count.alias("own_count"), F.lit(by).alias("by"))
    moves = points.select(project, day, F.inline(F.array(move(F.col("own_count"), 1), move(F.col("own_count") - F.col("_n"), -1))))
    moves = moves.filter("own_count > 0").groupBy(project, "own_count", day).agg(F.sum("by").alias("_by")).filter("_by <> 0")
    of_count = by_day([project, "own_count"], day)
    levels = moves.withColumns({"_members": F.sum("_by").over(of_count), "_until": F.lead(day).over(of_count)}).filter("_members > 0")
    spread = levels.select(project, "own_count", "_members", F.explode(F.sequence(F.col(day), F.date_sub("_until", 1))).alias(day))
    w = Window.partitionBy(project, day)
    ranked = spread.withColumns(
        {
            "_below": F.coalesce(F.sum("_members").over(w.orderBy("own_count").rowsBetween(UNBOUNDED, -1)), F.lit(0)),
            "peers": F.sum("_members").over(w),
        }
    )
    share = (F.col("_below") * 2 + F.col("_members") + 1) / (F.col("peers") * 2)
    active = points.filter("_active").select(project, day, member, "own_count")
    return active.join(ranked.select(project, day, "own_count", "peers", share.alias("percentile")), [project, day, "own_count"])


def previous_change_day(changes: DataFrame, keys: Sequence[str], order: Sequence[str], day: str = "day", name: str = "previous_day") -> DataFrame:
    """Day of the change before this one under the same key, over raw rows.

    A later change of the same day looks at that day; the first one of a day looks at the
    key's previous day. Both come from the day-level table, so the window never sees raw rows.
    """
    at = F.struct(*[F.col(c) for c in order])
    days = changes.groupBy(*keys, day).agg(F.min(at).alias("_first"))
    earlier = days.withColumn("_before", F.lag(day).over(by_day(keys, day)))
    rows = changes.join(earlier, [*keys, day])
    return rows.withColumn(name, F.when(at > F.col("_first"), F.col(day)).otherwise(F.col("_before"))).drop("_first", "_before")


def order_range(df: DataFrame, column: str, width: int = 4096) -> Column:
    """Ranges of an ordering column that never decrease along it: of numbers, or of first characters."""
    if isinstance(df.schema[column].dataType, NumericType):
        return F.floor(F.col(column) / width)
    return F.substring(F.col(column).cast("string"), 1, 2)


def history_counts(
    changes: DataFrame, keys: Sequence[str], order: Sequence[str], sums: Mapping[str, Column], day: str = "day", include_current: bool = True
) -> DataFrame:
    """Running sums per key over raw rows, chunked by day and by ranges of the order in a day."""
    chunk = F.struct(F.col(day).alias("day"), order_range(changes, order[0]).alias("part"))
    return running_totals(changes, keys, chunk, [day, *order], sums, include_current)
