"""Ranking, top-k and ordered lookups."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_per_group(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int, rank: str | None = None) -> DataFrame:
    """First ``n`` rows per group; Spark limits each group inside every task before the shuffle."""
    name = rank or "_rank"
    out = df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col(name) <= n)
    return out if rank else out.drop(name)


def order_by_list(df: DataFrame, column: str, wanted: Sequence[str], *then: str | Column) -> DataFrame:
    """Sort by the position in a fixed list, unknown values last."""
    position = F.array_position(F.array(*[F.lit(w) for w in wanted]), F.col(column))
    return df.orderBy(F.when(position > 0, position).otherwise(len(wanted) + 1), *then)


def keep_top_entities(df: DataFrame, entity: str, score: Column, k: int, name: str = "score") -> DataFrame:
    """All rows of the ``k`` entities with the highest score, the score beside them.

    The chosen list has ``k`` rows, so it is safe to broadcast.
    """
    top = df.groupBy(entity).agg(score.alias(name)).orderBy(F.desc(name), entity).limit(k)
    return df.join(F.broadcast(top), entity)


def thresholds_for_precision(curve: DataFrame, targets: Sequence[float], keys: Sequence[str] = (), include_sentinel: bool = False) -> DataFrame:
    """For each precision target the highest threshold reaching it, with that point's values."""
    points = curve
    if include_sentinel:
        # a point above every score: nothing selected, precision 1, recall 0
        top = curve.groupBy(*keys).agg((F.max("threshold") + 1.0).alias("threshold"), F.max(F.col("tp") + F.col("fn")).alias("fn"))
        zero = F.lit(0).cast("bigint")
        points = curve.unionByName(
            top.select(*keys, "threshold", F.lit(1.0).alias("precision"), F.lit(0.0).alias("recall"), zero.alias("tp"), zero.alias("fp"), "fn")
        )
    wanted = F.explode(F.array(*[F.lit(float(t)) for t in targets])).alias("precision_target")
    reached = points.select("*", wanted).filter("precision >= precision_target")
    best = F.max_by(F.struct("threshold", "precision", "recall", "tp", "fp", "fn"), "threshold")
    return reached.groupBy(*keys, "precision_target").agg(best.alias("_p")).select(*keys, "precision_target", "_p.*")
