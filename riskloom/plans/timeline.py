"""Labelled timelines: capacity days with scores, labels and walk-forward folds."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.operators import tables as tb
from riskloom.operators import windows as wn


def build_timeline(daily: DataFrame, rates: DataFrame) -> DataFrame:
    """Capacity timeline of every project in ``daily``; a missing rate counts as 0, rates round half-even."""
    whole = rates.select("project", F.bround("rate", 0).alias("rate"))
    return wn.capacity_timeline(daily.join(whole, "project", "left"), "rate")


def labelled_timeline(
    timeline: DataFrame,
    scores: DataFrame,
    risk: str,
    label: str | None = None,
    threshold: float = 0.5,
    folds: int | None = None,
    recent: bool = False,
    extra: Sequence[str] = (),
) -> DataFrame:
    """Timeline days with their risk, label (false where unscored) and fold, plus label source columns."""
    choice = tb.resolve_label(scores, risk, label, threshold)
    kept = [c for c in extra if c in scores.columns and c not in timeline.columns]
    marked = scores.select("project", "day", choice.flag.alias("is_flagged"), F.col(risk).cast("double").alias("risk"), *kept)
    out = timeline.join(marked, ["project", "day"], "left").withColumn("is_flagged", F.coalesce("is_flagged", F.lit(False)))
    if folds:
        _, assigned = wn.walk_forward(scores.select("project", "day").distinct(), "project", folds, recent)
        out = out.join(assigned, ["project", "day"], "left")
    return out.withColumns({"label_source": F.lit(choice.source), "label_threshold": F.lit(choice.threshold).cast("double")})
