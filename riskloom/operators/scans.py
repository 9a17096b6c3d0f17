"""Running totals and exact quantiles that never put one hot key into one task.

A window over raw rows sends every row of a key to one task. Here the key's rows are cut
into chunks that follow the order (days, value bins). Chunk totals come from a map-side
combined group-by, prefix sums run over those few totals, and the row-level window only
ever sees one chunk.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from riskloom.session import settle

LOOSE_BAND = 0.05  # half the width of a band where a key has too few rows for a narrow one
BROADCAST_KEYS = 10_000  # rows of a table with one row per key, up to which it is broadcast


def running_totals(
    df: DataFrame,
    keys: Sequence[str],
    chunk: str | Column,
    order: Sequence[str | Column],
    sums: Mapping[str, Column],
    include_current: bool = True,
) -> DataFrame:
    """Add a running sum per name in ``sums`` over ``keys`` in ``order``.

    ``chunk`` must not decrease along ``order`` within a key, and should hold a bounded
    share of a key's rows. ``order`` should be total within a chunk.
    """
    chunk = chunk if isinstance(chunk, Column) else F.col(chunk)
    # One struct key serves the join and the window, so the rows are shuffled once;
    # structs with null fields compare equal, so null keys keep their rows.
    rows = df.withColumns({"_key": F.struct(*[F.col(k).alias(f"k{i}") for i, k in enumerate(keys)], chunk.alias("chunk")),
                           **{f"_v_{n}": e for n, e in sums.items()}})
    totals = rows.groupBy("_key").agg(*[F.sum(f"_v_{n}").alias(f"_t_{n}") for n in sums])
    before = Window.partitionBy(*[F.col(f"_key.k{i}") for i in range(len(keys))]).orderBy("_key.chunk")
    before = before.rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("_key", *[F.coalesce(F.sum(f"_t_{n}").over(before), F.lit(0)).alias(f"_o_{n}") for n in sums])
    frame = Window.partitionBy("_key").orderBy(*order)
    frame = frame.rowsBetween(Window.unboundedPreceding, 0 if include_current else -1)
    joined = rows.join(offsets, "_key")
    return joined.select(
        *df.columns,
        *[(F.col(f"_o_{n}") + F.coalesce(F.sum(f"_v_{n}").over(frame), F.lit(0))).alias(n) for n in sums],
    )


def in_ranges(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], label: str = "ranges", chunk: str = "_chunk") -> DataFrame:
    """``df`` written in ranges of (keys, order), with the number of each row's range as ``chunk``.

    Ranges hold about equally many rows, so a key of any size is cut as often as it needs, and
    ranges follow the order inside each key. Ranges come from a sample and are written down,
    so later steps all see the same ones. Rows that are equal in keys and order stay together.
    """
    return settle(df.repartitionByRange(*keys, *order).withColumn(chunk, F.spark_partition_id()), label)


# what a prefix scan adds up: each aggregate merges rows and merges chunks alike
FOLDS = {"sum": F.sum, "max": F.max, "min": F.min, "join": F.collect_list}


def prefix_scan(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], folds: Mapping[str, tuple[str, Column]], include_current: bool = True, chunk: str = "_chunk"
) -> DataFrame:
    """Add per name the fold of a column over the rows of ``keys`` up to (or before) each row.

    ``folds`` names a kind of ``FOLDS`` and a column each: sum, max, min, or join (arrays one after
    the other; their total length per key should be bounded). The last value that is not null
    is the max of ``last_value``. Where a kind has met nothing but nulls the result is null, and
    empty for join. ``chunk`` is as in ``in_ranges``, or null-free and rising along ``order``;
    ``order`` is total inside a key, or rows that tie stand in any order.

    Chunks are folded first, a window runs over these few totals, and what comes before a chunk
    enters it as one more row ahead of its own, so no task ever holds a key's rows and the
    rows are shuffled once.
    """
    names = list(folds)
    values = {f"_v_{n}": e for n, (_, e) in folds.items()}
    rows = df.withColumns(values)

    def merged(name: str, column: str, frame: WindowSpec | None = None) -> Column:
        found = FOLDS[folds[name][0]](column)
        found = found if frame is None else found.over(frame)
        return F.flatten(found) if folds[name][0] == "join" else found

    totals = rows.groupBy(*keys, chunk).agg(*[merged(n, f"_v_{n}").alias(f"_t_{n}") for n in names])
    before = Window.partitionBy(*keys).orderBy(chunk).rowsBetween(Window.unboundedPreceding, -1)
    carry = totals.select(*keys, chunk, *[merged(n, f"_t_{n}", before).alias(f"_v_{n}") for n in names])
    carry = carry.withColumn("_own", F.lit(False))
    both = rows.withColumn("_own", F.lit(True)).unionByName(carry, allowMissingColumns=True)
    frame = Window.partitionBy(*keys, chunk).orderBy("_own", *order).rowsBetween(Window.unboundedPreceding, 0 if include_current else -1)
    return both.withColumns({n: merged(n, f"_v_{n}", frame) for n in names}).filter("_own").drop("_own", *values)


def last_value(order: Sequence[str], value: Column) -> Column:
    """For a max fold: the value with its place, null where the value is null; read ``.value``."""
    return F.when(value.isNotNull(), F.struct(*order, value.alias("value")))


def equal_bins(df: DataFrame, keys: Sequence[str], value: str, bins: int) -> DataFrame:
    """Per key, an array of cuts ``_edges`` that split its rows into about equal parts, whatever
    their distribution. Cuts are approximate and only steer the load: results never depend on them."""
    steps = [i / bins for i in range(1, bins)]
    return df.groupBy(*keys).agg(F.percentile_approx(value, steps, 10000).alias("_edges"))


def bin_of(value: Column) -> Column:
    return F.size(F.filter("_edges", lambda e: e <= value))


def ordered_totals(
    table: DataFrame, keys: Sequence[str], value: str, sums: Mapping[str, Column], descending: bool = False, label: str = "ordered"
) -> DataFrame:
    """Running sums per key in the order of ``value``, which is unique per key, over ranges of that order."""
    order = [F.desc(value) if descending else F.asc(value)]
    return prefix_scan(in_ranges(table, keys, order, label), keys, order, {n: ("sum", e) for n, e in sums.items()}).drop("_chunk")


def exact_quantiles(df: DataFrame, keys: Sequence[str], value: str, probs: Mapping[str, float], accuracy: int = 10_000) -> DataFrame:
    """Exact quantiles with linear interpolation for values of any domain, plus ``count``.

    A sketch per key gives a band of values around each rank, five times as wide as its
    error bound. A second pass counts what lies between the bands and keeps distinct values
    only inside them, about a thousandth of the rows per quantile; the ranks are then exact. The
    source is scanned twice and never written. A rank outside its band would be an
    error of the sketch and is raised.

    Where the domain is known to be small (whole days, scores in percent) the built-in
    ``percentile`` needs one pass less; its buffer holds the distinct values of a group.
    """
    names, widths = list(probs), (5 / accuracy, LOOSE_BAND)
    places = range(len(names))
    source = df.filter(F.col(value).isNotNull()).select(*keys, F.col(value).alias("value"))
    edges = [min(max(probs[n] + sign * w, 0.0), 1.0) for n in names for w in widths for sign in (-1, 1)]
    sketch = source.groupBy(*keys).agg(F.percentile_approx("value", edges, accuracy).alias("_e"), F.count("*").alias("count"), F.min("value").alias("_min"), F.max("value").alias("_max"))

    def edge(i: int, upper: int) -> Column:
        """Of the narrowest band that has some rows on both sides of the rank; all values of a small key."""
        picked = [F.when(F.col("count") * w >= 3, F.col("_e")[4 * i + 2 * j + upper]) for j, w in enumerate(widths)]
        return F.coalesce(*picked, F.col("_max" if upper else "_min"))

    bands = sketch.select(*keys, "count", *[edge(i, u).alias(f"_{side}{i}") for i in places for u, side in enumerate(("lo", "hi"))])
    bands = settle(bands, "bands")
    small = bands.count() <= BROADCAST_KEYS  # one row per key
    banded = source.join(F.broadcast(bands) if small else bands, list(keys)) if keys else source.crossJoin(F.broadcast(bands))
    inside_any = reduce(Column.__or__, [F.col("value").between(F.col(f"_lo{i}"), F.col(f"_hi{i}")) for i in places])
    passed = reduce(Column.__add__, [(F.col("value") > F.col(f"_hi{i}")).cast("int") for i in places])
    # rows between the same two bands are one group, rows in a band one group per value
    groups = banded.groupBy(*keys, "count", F.when(inside_any, F.col("value")).alias("_v"), F.when(~inside_any, passed).alias("_gap")).agg(F.count("*").alias("n"), F.min("value").alias("_least"))
    run = groups.withColumn("cum", F.sum("n").over(Window.partitionBy(*keys).orderBy("_least")))
    at = lambda rank: F.max(F.when((F.col("cum") - F.col("n") <= rank) & (F.col("cum") > rank), F.col("_v")))
    pos = {n: F.lit(float(probs[n])) * (F.col("count") - 1) for n in names}
    picked = run.groupBy(*keys, "count").agg(*[at(f(pos[n])).alias(f"_{side}_{n}") for n in names for side, f in (("a", F.floor), ("b", F.ceil))])

    def exact(n: str) -> Column:
        a, b = F.col(f"_a_{n}").cast("double"), F.col(f"_b_{n}").cast("double")
        missed = F.raise_error(F.lit(f"rank of {n} outside its band")).cast("double")
        return F.when(a.isNull() | b.isNull(), missed).otherwise(a + (b - a) * (pos[n] - F.floor(pos[n]))).alias(n)

    return picked.select(*keys, "count", *[exact(n) for n in names])


def leave_one_out_quantiles(
    df: DataFrame, entity: str, value: str, probs: Mapping[str, float], buckets: int = 1024, weight: str | None = None
) -> DataFrame:
    """For each entity, quantiles over the rows of all *other* entities, without pairing them.

    Counts are taken once per (entity, value) and once per value. With G and E the running
    counts of all rows and of the entity's own rows, the k-th smallest foreign value is the
    first v with G(v) >= k + E', where E' counts the own rows before the first own value at
    which G - E reaches k. Those positions are then looked up in G by an equi join on
    count buckets. Steps and ranks of an entity are met in one ordered scan over
    ranges. ``weight`` names a column with the count a row stands for.
    """
    names = list(probs)
    size = F.sum(weight) if weight else F.count("*")
    counts = df.filter(F.col(value).isNotNull()).groupBy(entity, F.col(value).alias("value")).agg(size.alias("n"))
    counts = settle(counts, "counts")  # the rows themselves are read once
    cum = {"cum": F.col("n")}
    own = ordered_totals(counts, [entity], "value", cum).select(entity, "value", F.col("n").alias("own_n"), F.col("cum").alias("own_cum"))
    world = ordered_totals(counts.groupBy("value").agg(F.sum("n").alias("n")), [], "value", cum)
    world = world.select("value", F.col("n").alias("all_n"), F.col("cum").alias("all_cum"))
    total = counts.agg(F.sum("n").alias("_total"))
    sizes = own.groupBy(entity).agg(F.sum("own_n").alias("own_total"))
    points = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(float(probs[n])).alias("p")) for i, n in enumerate(names)]))
    foreign = sizes.crossJoin(F.broadcast(total)).withColumn("count", F.col("_total") - F.col("own_total"))  # total: one row
    pos = F.col("_pt.p") * (F.col("count") - 1)
    ranks = (
        foreign.filter("count > 0")
        .select(entity, "own_total", "count", "_total", points.alias("_pt"))
        .select(entity, "own_total", "count", "_total", F.col("_pt.i").alias("_i"), pos.alias("_pos"))
        .withColumn("_k", F.explode(F.array_distinct(F.array(F.floor("_pos") + 1, F.ceil("_pos") + 1))))
    )
    steps = own.join(world, "value").select(
        F.col(entity), (F.col("all_cum") - F.col("own_cum")).alias("_reach"), (F.col("own_cum") - F.col("own_n")).alias("_before")
    )
    # the first step that reaches k: downwards in reach, the least count so far (a step stands before the ranks it just reaches)
    down = [F.desc("_reach"), F.asc_nulls_last("_before")]
    merged = in_ranges(ranks.withColumn("_reach", F.col("_k")).unionByName(steps, allowMissingColumns=True), [entity], down, "ranks")
    placed = (
        prefix_scan(merged, [entity], down, {"_first": ("min", F.col("_before"))})
        .filter("_k IS NOT NULL")
        .select(entity, "own_total", "count", "_total", "_i", "_pos", "_k", F.col("_first").alias("_before"))
        .withColumn("_at", F.col("_k") + F.coalesce("_before", "own_total"))
        .withColumn("_bucket", F.floor(F.col("_at") * buckets / F.col("_total")))
    )
    lookup = world.crossJoin(F.broadcast(total)).select(  # total: one row
        F.col("value").alias("_value"),
        (F.col("all_cum") - F.col("all_n")).alias("_from"),
        F.col("all_cum").alias("_to"),
        F.explode(
            F.sequence(
                F.floor((F.col("all_cum") - F.col("all_n") + 1) * buckets / F.col("_total")),
                F.floor(F.col("all_cum") * buckets / F.col("_total")),
            )
        ).alias("_bucket"),
    )
    found = placed.join(lookup, "_bucket").filter((F.col("_from") < F.col("_at")) & (F.col("_to") >= F.col("_at")))
    low, high = F.col("_k") == F.floor("_pos") + 1, F.col("_k") == F.ceil("_pos") + 1
    per_point = found.groupBy(entity, "count", "_i", "_pos").agg(
        F.max(F.when(low, F.col("_value"))).alias("_a"), F.max(F.when(high, F.col("_value"))).alias("_b")
    )
    value_at = F.col("_a") + (F.col("_b") - F.col("_a")) * (F.col("_pos") - F.floor("_pos"))
    stats = per_point.groupBy(entity).agg(
        F.first("count").alias("count"),
        *[F.max(F.when(F.col("_i") == i, value_at)).cast("double").alias(n) for i, n in enumerate(names)],
    )
    return foreign.select(entity, F.col("count").alias("_c")).join(stats, entity, "left").select(
        entity, F.coalesce("count", "_c").alias("count"), *names
    )
