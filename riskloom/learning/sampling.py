"""Row preparation, training sets, splits and resampling, all fixed by keys and seeds.

Random order is the order of a hash of the row key and the seed. Ranks in that order are
found by hash buckets, so no class or entity is ever sorted in one task.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskloom.functions import clean
from riskloom.functions.numeric import keyed_uniform
from riskloom.operators import scans
from riskloom.operators import tables as tb
from riskloom.session import settle

HASH_CHARS = 3  # 16 ** 3 buckets
SLICES = 4  # tasks per block of a neighbour search


def seeded_hash(seed: int, *keys: str) -> Column:
    return F.md5(F.concat_ws("::", *[F.col(k).cast("string") for k in keys], F.lit(str(seed))))


def prepare_rows(df: DataFrame, label: str, features: Sequence[str], ids: Sequence[str]) -> DataFrame:
    """Label to 0/1, features to numbers with 0 for what is missing or no number."""
    flag = clean.truthy_label(label).alias("label")
    return df.select(*ids, flag, *[clean.number_or_zero(f).alias(f) for f in features])


def training_set(df: DataFrame, scope: str, target: str, schema: dict[str, str], listed: Sequence[str] = (), entity: str = "project", one_class: bool = False) -> DataFrame | None:
    """Rows of the scope aligned to ``schema``.

    None when they hold fewer than two classes, which cannot be fitted; ``one_class`` is for
    those who want the table itself and gives its rows whatever their labels are.
    """
    rows = tb.training_scope(df, scope, target, listed, entity=entity)
    out = tb.align_columns(rows, schema, zero=[c for c, t in schema.items() if t in ("double", "int", "bigint")])
    if one_class:
        return out
    # two numbers come back to the driver
    classes = out.agg(F.min("label").alias("a"), F.max("label").alias("b")).first()
    return out if classes.a is not None and classes.a != classes.b else None


def under_sample(df: DataFrame, label: str, keys: Sequence[str], seed: int) -> DataFrame:
    """Equal classes: each keeps as many rows as the smallest class has, first in hash order.

    Counts per (label, hash bucket) tell which buckets are kept whole; only the rows of the
    one bucket where a class is cut are ranked. The bucket table has at most
    (number of labels) * 16 ** HASH_CHARS rows, so it is safe to broadcast.
    """
    rows = df.withColumn("_h", seeded_hash(seed, *keys)).withColumn("_b", F.substring("_h", 1, HASH_CHARS))
    buckets = rows.groupBy(label, "_b").agg(F.count("*").alias("_n"))
    sizes = buckets.groupBy(label).agg(F.sum("_n").alias("_size"))
    limit = sizes.agg(F.min("_size").alias("_keep"))
    run = F.sum("_n").over(Window.partitionBy(label).orderBy("_b"))
    table = buckets.withColumn("_to", run).crossJoin(F.broadcast(limit))  # limit: one row
    table = table.filter("_to - _n < _keep").select(label, "_b", (F.col("_keep") - (F.col("_to") - F.col("_n"))).alias("_room"), "_n")
    kept = rows.join(F.broadcast(table), [label, "_b"])
    whole = kept.filter("_n <= _room")
    place = F.row_number().over(Window.partitionBy(label, "_b").orderBy("_h", *keys))
    cut = kept.filter("_n > _room").withColumn("_p", place).filter("_p <= _room").drop("_p")
    return whole.unionByName(cut).select(*df.columns)


def stratified_folds(df: DataFrame, label: str, keys: Sequence[str], k: int, seed: int, by: Sequence[str] = (), name: str = "fold") -> DataFrame:
    """Fold 0..k-1 for each row, dealt out in hash order within each class."""
    rows = df.withColumn("_h", seeded_hash(seed, *keys))
    ranked = scans.running_totals(rows, [*by, label], F.substring("_h", 1, HASH_CHARS), ["_h", *keys], {"_rank": F.lit(1)})
    return ranked.withColumn(name, F.pmod(F.col("_rank") - 1, F.lit(k)).cast("int")).drop("_h", "_rank")


def random_baseline(train: DataFrame, test: DataFrame, label: str, keys: Sequence[str], seed: int, entity: Sequence[str] = ()) -> DataFrame:
    """Predict 1 with the training rate of positives, by a draw fixed by the row key."""
    rate = train.groupBy(*entity).agg(F.avg(F.col(label).cast("double")).alias("_rate"))
    rows = test.join(rate, list(entity)) if entity else test.crossJoin(F.broadcast(rate))  # rate: one row
    return rows.withColumn("predicted", (keyed_uniform(seed, *keys) < F.col("_rate")).cast("int")).drop("_rate")


def _block_neighbours(queries: pd.DataFrame, members: pd.DataFrame, k: int) -> pd.DataFrame:
    """The k nearest members of each query by (distance, id), one query at a time."""
    out = []
    if len(queries) and len(members):
        members = members.sort_values("id", kind="stable")
        m, ids = np.stack(members["v"].to_numpy()), members["id"].to_numpy()
        for own, v in zip(queries["id"], queries["v"]):
            d = np.sqrt(((m - v) ** 2).sum(axis=1))
            d[ids == own] = np.inf
            out += [(own, ids[j], d[j]) for j in np.argsort(d, kind="stable")[:k] if np.isfinite(d[j])]
    return pd.DataFrame(out, columns=["id", "other", "distance"])


def nearest_neighbours(df: DataFrame, key: str, features: Sequence[str], k: int, block_rows: int = 2000, bins: int = 256) -> DataFrame:
    """Exact k nearest neighbours of every row among all rows: id, other, distance, rank.

    Rows are cut into blocks along the first feature. Each block finds candidates inside
    itself, whose k-th distance bounds how far along the feature a nearer row can lie; a
    row then visits only the blocks inside that bound. A block is one task and emits k
    rows per visitor, never its pairs.
    """
    cells = F.array(*[F.col(f).cast("double") for f in features])
    points = df.select(F.col(key).cast("bigint").alias("id"), cells.alias("v")).withColumn("x", F.col("v")[0])
    cuts = settle(scans.equal_bins(points, [], "x", bins), "cuts")  # one row of bins - 1 numbers

    binned = points.crossJoin(F.broadcast(cuts)).withColumn("bin", scans.bin_of(F.col("x"))).drop("_edges")
    placed = scans.running_totals(binned, [], "bin", ["x", "id"], {"_place": F.lit(1)})
    placed = settle(placed.withColumn("block", F.floor((F.col("_place") - 1) / block_rows)).drop("_place"), "blocks")
    edges = placed.groupBy("block").agg(F.min("x").alias("lo"), F.max("x").alias("hi"))

    # first and last block at or beyond each bin: a table of at most ``bins`` rows, safe to broadcast
    per_bin = placed.groupBy("bin").agg(F.min("block").alias("_first"), F.max("block").alias("_last"))
    all_bins = df.sparkSession.range(bins + 1).select(F.col("id").cast("int").alias("bin"))
    w = Window.orderBy("bin")
    reach_of = all_bins.join(per_bin, "bin", "left").select(
        "bin",
        F.min("_first").over(w.rowsBetween(0, Window.unboundedFollowing)).alias("from_block"),
        F.max("_last").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("to_block"),
    )
    schema = "id bigint, other bigint, distance double"

    def search(queries: pd.DataFrame, members: pd.DataFrame) -> pd.DataFrame:
        return _block_neighbours(queries, members, k)

    members = placed.select(*[F.col(c).alias(c) for c in ("id", "v", "block")])
    own = placed.select("id", "v", "block").groupBy("block").cogroup(members.groupBy("block")).applyInPandas(search, schema)
    own = settle(own, "near")
    bound = own.groupBy("id").agg(F.max("distance").alias("_d"), F.count("*").alias("_found"))
    aim = placed.join(bound, "id", "left").withColumn("_d", F.when(F.col("_found") >= k, F.col("_d")).otherwise(F.lit(float("inf"))))
    aim = aim.crossJoin(F.broadcast(cuts))
    aim = aim.withColumns({"_b0": scans.bin_of(F.col("x") - F.col("_d")), "_b1": scans.bin_of(F.col("x") + F.col("_d"))}).drop("_edges")
    aim = aim.join(F.broadcast(reach_of.select(F.col("bin").alias("_b0"), "from_block")), "_b0")
    aim = aim.join(F.broadcast(reach_of.select(F.col("bin").alias("_b1"), "to_block")), "_b1")
    # a bin without rows at either end leaves nothing to visit there
    aim = aim.filter("from_block <= to_block")
    visits = aim.select("id", "v", "x", "_d", F.col("block").alias("_home"), F.explode(F.sequence("from_block", "to_block")).alias("block"))
    inside = (F.col("lo") <= F.col("x") + F.col("_d")) & (F.col("hi") >= F.col("x") - F.col("_d"))
    visits = visits.filter("block <> _home").join(edges, "block").filter(inside).select(*[F.col(c).alias(c) for c in ("id", "v", "block")])
    # visitors of a block are searched in slices, so a popular block is many tasks
    sliced = visits.withColumn("slice", F.pmod(F.xxhash64("id"), F.lit(SLICES)).cast("int"))
    copies = members.withColumn("slice", F.explode(F.sequence(F.lit(0), F.lit(SLICES - 1))))
    far = sliced.groupBy("block", "slice").cogroup(copies.groupBy("block", "slice")).applyInPandas(search, schema)
    rank = F.row_number().over(Window.partitionBy("id").orderBy("distance", "other"))
    return own.unionByName(far).withColumn("rank", rank).filter(F.col("rank") <= k)


def smote(df: DataFrame, label: str, key: str, features: Sequence[str], seed: int, k: int = 5) -> DataFrame:
    """Synthetic rows between minority rows and a near neighbour, until the classes are equal.

    Row i of the minority gets the i-th draws in turn; each draw picks one of the k nearest
    minority rows and a point on the way there, both fixed by the key, the draw and the seed.
    """
    sizes = df.agg(F.count_if(F.col(label) == 1).alias("p"), F.count_if(F.col(label) == 0).alias("n")).first()  # two numbers
    minority = 1 if sizes.p <= sizes.n else 0
    few, missing = min(sizes.p, sizes.n), abs(sizes.p - sizes.n)
    rows = df.filter(F.col(label) == minority).select(F.col(key).cast("bigint").alias("id"), *[F.col(f).cast("double").alias(f) for f in features])
    if few < 2 or missing == 0:
        return rows.limit(0).withColumn("draw", F.lit(0))
    ranked = scans.running_totals(
        rows.withColumn("_h", seeded_hash(seed, "id")), [], F.substring("_h", 1, HASH_CHARS), ["_h", "id"], {"_place": F.lit(1)}
    )
    each, rest = divmod(missing, few)
    draws = F.lit(each) + (F.col("_place") <= rest).cast("int")
    seeds = ranked.withColumn("draw", F.explode(F.when(draws > 0, F.sequence(F.lit(1).cast("bigint"), draws.cast("bigint"))).otherwise(F.array().cast("array<bigint>"))))
    k = min(k, few - 1)
    pick = F.floor(keyed_uniform(seed, "id", "draw") * k).cast("int") + 1
    near = nearest_neighbours(rows, "id", features, k).select("id", "other", "rank")
    chosen = seeds.withColumn("rank", pick).join(near, ["id", "rank"])
    others = rows.select(F.col("id").alias("other"), *[F.col(f).alias(f"_o_{f}") for f in features])
    gap = keyed_uniform(seed + 1, "id", "draw")
    return chosen.join(others, "other").select("id", "draw", *[(F.col(f) + gap * (F.col(f"_o_{f}") - F.col(f))).alias(f) for f in features])
