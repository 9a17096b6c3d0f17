"""Score curves: precision/recall points, areas and rates from counts per distinct score."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.operators.scans import ordered_totals


def score_curve(df: DataFrame, score: str, label: str, keys: Sequence[str] = ()) -> DataFrame:
    """Counts at and above each distinct score, highest first; ties are one point.

    Scores are grouped first, then added up bin by bin, so that neither a hot entity nor
    the global curve passes through one task.
    """
    points = df.filter(F.col(score).isNotNull()).groupBy(*keys, F.col(score).alias("threshold")).agg(
        F.count_if(F.col(label) == 1).alias("pos"), F.count("*").alias("n")
    )
    run = ordered_totals(points, keys, "threshold", {"tp": F.col("pos"), "selected": F.col("n")}, descending=True, label="scores")
    totals = points.groupBy(*keys).agg(F.sum("pos").alias("positives"), F.sum("n").alias("rows"))
    out = run.join(totals, list(keys)) if keys else run.crossJoin(F.broadcast(totals))  # one row
    return out.withColumn("fp", F.col("selected") - F.col("tp"))


def precision_recall(df: DataFrame, score: str, label: str, keys: Sequence[str] = ()) -> DataFrame:
    curve = score_curve(df, score, label, keys)
    recall = F.coalesce(F.try_divide(F.col("tp"), F.col("positives")), F.lit(0.0))
    return curve.select(
        *keys, "threshold", (F.col("tp") / F.col("selected")).alias("precision"), recall.alias("recall"), "tp", "fp", (F.col("positives") - F.col("tp")).alias("fn")
    )


def ranking_areas(df: DataFrame, score: str, label: str, keys: Sequence[str]) -> DataFrame:
    """ROC area with tied ranks averaged, average precision, trapezoid PR area; null for one class."""
    c = score_curve(df, score, label, keys)
    neg = F.col("n") - F.col("pos")
    tp0 = F.col("tp") - F.col("pos")
    sel0 = F.col("selected") - F.col("n")
    p1 = F.col("tp") / F.col("selected")
    p0 = F.when(sel0 == 0, F.lit(1.0)).otherwise(F.try_divide(tp0, sel0))
    step = F.col("pos") / F.col("positives")
    both = (F.col("positives") > 0) & (F.col("positives") < F.col("rows"))
    pairs = F.sum(neg * (tp0 * 2 + F.col("pos")))
    out = c.withColumns({"_ap": F.when(both, step * p1), "_tr": F.when(both, step * (p1 + p0) / 2)})
    grouped = out.groupBy(*keys).agg(
        F.max("rows").alias("n_test"),
        F.max("positives").alias("n_pos"),
        pairs.alias("_pairs"),
        F.sum("_ap").alias("average_precision"),
        F.sum("_tr").alias("pr_auc_trapezoid"),
    )
    mixed = F.col("n_pos") * (F.col("n_test") - F.col("n_pos"))
    return grouped.withColumns(
        {"auc_roc": F.try_divide(F.col("_pairs"), mixed * 2), "pos_rate": F.col("n_pos") / F.col("n_test")}
    ).drop("_pairs")
