"""Least squares from moment sums: one pass over the rows, one small solve per model."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def simple_fit(df: DataFrame, keys: Sequence[str], x: str, y: str) -> DataFrame:
    """Slope and intercept of y on x per group."""
    return df.groupBy(*keys).agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.regr_count(y, x).alias("count"))


def _moment_names(k: int) -> list[tuple[int, int]]:
    return [(i, j) for i in range(k) for j in range(i, k)]


def moments(df: DataFrame, keys: Sequence[str], features: Sequence[str], target: str) -> DataFrame:
    """Sums of products of (1, features, target) per group, as one array of doubles."""
    terms: list[Column] = [F.lit(1.0), *[F.col(f).cast("double") for f in features], F.col(target).cast("double")]
    pairs = _moment_names(len(terms))
    sums = [F.sum(terms[i] * terms[j]).alias(f"_m{n}") for n, (i, j) in enumerate(pairs)]
    return df.groupBy(*keys).agg(*sums).select(*keys, F.array(*[f"_m{n}" for n in range(len(pairs))]).alias("moments"))


def _solve(row: np.ndarray, k: int) -> list[float] | None:
    """Minimum-norm coefficients (intercept first) from one moment array."""
    full = np.zeros((k + 2, k + 2))
    for value, (i, j) in zip(row, _moment_names(k + 2)):
        full[i, j] = full[j, i] = value
    if full[0, 0] <= 0:
        return None
    gram, right = full[: k + 1, : k + 1], full[: k + 1, k + 1]
    inverse = np.linalg.pinv(gram, rcond=1e-12, hermitian=True)
    found = inverse @ right
    for _ in range(2):  # the moments are not centred; what a solve leaves over is taken in longer floats and solved again
        left = right.astype(np.longdouble) - gram.astype(np.longdouble) @ found.astype(np.longdouble)
        found = found + inverse @ left.astype(float)
    return [float(c) for c in found]


def solve_moments(table: DataFrame, k: int) -> DataFrame:
    """Add ``coefficients`` to a table of moment arrays; one small matrix per row."""
    @F.pandas_udf("array<double>")
    def solve(m: pd.Series) -> pd.Series:
        return m.map(lambda row: _solve(np.asarray(row, dtype=float), k))

    return table.withColumn("coefficients", solve("moments")).drop("moments")


def fit(df: DataFrame, features: Sequence[str], target: str) -> DataFrame:
    """One row with the coefficients of the full fit."""
    return solve_moments(moments(df, [], features, target), len(features))


def linear_score(features: Sequence[str], coefficients: str = "coefficients") -> Column:
    score = F.col(coefficients)[0]
    for i, f in enumerate(features):
        score = score + F.col(coefficients)[i + 1] * F.col(f).cast("double")
    return score


def predict(df: DataFrame, model: DataFrame, features: Sequence[str], name: str) -> DataFrame:
    scored = df.crossJoin(F.broadcast(model.select("coefficients")))  # model: one row
    return scored.withColumn(name, linear_score(features)).drop("coefficients")


def leave_one_out_models(df: DataFrame, entity: str, features: Sequence[str], target: str, within: Sequence[str] = ()) -> DataFrame:
    """Coefficients per entity, fitted on all other entities as total minus own moments.

    With ``within`` every value of those columns has models of its own. A single entity has
    no others and falls back to its own fit, with 0 training entities.
    """
    own = moments(df, [*within, entity], features, target)
    size = len(_moment_names(len(features) + 2))
    total = own.groupBy(*within).agg(*[F.sum(F.col("moments")[i]).alias(f"_t{i}") for i in range(size)], F.count("*").alias("_entities"))
    both = own.join(total, list(within)) if within else own.crossJoin(F.broadcast(total))  # total: one row
    rest = F.array(*[F.col(f"_t{i}") - F.col("moments")[i] for i in range(size)])
    chosen = F.when(F.col("_entities") > 1, rest).otherwise(F.col("moments"))
    left = both.select(*within, entity, chosen.alias("moments"), (F.col("_entities") - 1).alias("training_entities"))
    return solve_moments(left, len(features))


def leave_one_out_predictions(df: DataFrame, entity: str, features: Sequence[str], target: str, name: str, within: Sequence[str] = ()) -> DataFrame:
    models = leave_one_out_models(df, entity, features, target, within)
    return df.join(models, [*within, entity]).withColumn(name, linear_score(features)).drop("coefficients")


def entity_split(df: DataFrame, entity: str, test_fraction: float, seed: int) -> DataFrame:
    """Mark rows of training entities: entities in hash order, the first max(1, floor(n * (1 - f))) train.

    The ranking runs over distinct entities only.
    """
    names = df.select(entity).distinct()
    n = names.agg(F.count("*").alias("_n"))
    order = Window.orderBy(F.md5(F.concat_ws("::", F.col(entity).cast("string"), F.lit(str(seed)))), entity)
    ranked = names.withColumn("_rank", F.row_number().over(order)).crossJoin(F.broadcast(n))  # n: one row
    keep = F.greatest(F.floor(F.col("_n") * F.lit(1.0 - test_fraction)), F.lit(1))
    return df.join(ranked.select(entity, (F.col("_rank") <= keep).alias("is_train")), entity)
