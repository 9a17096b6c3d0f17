"""Models, cross-validation and metrics. Fits are distributed; loops run over folds and seeds."""

from __future__ import annotations

import random
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.ml import Estimator, Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, RandomForestClassifier
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskloom.learning import curves, sampling
from riskloom.operators import aggregates as ag
from riskloom.operators import windows as wn
from riskloom.operators.sets import union_all

# Settings of the two tree models.
FOREST = {"numTrees": 1500, "maxDepth": 30, "featureSubsetStrategy": "sqrt"}  # 30: the deepest that Spark grows
BOOSTED = {"maxIter": 1000, "maxDepth": 4, "stepSize": 0.03, "subsamplingRate": 0.8}

SCORED = ["project", "row_id", "label", "score", "predicted"]


def estimator(kind: str, features: Sequence[str], seed: int, **params: object) -> Pipeline:
    """Assembler and classifier; ``params`` override the fixed settings."""
    common = {"featuresCol": "_features", "labelCol": "label", "seed": seed}
    model: Estimator
    if kind == "random_forest":
        model = RandomForestClassifier(**{**common, **FOREST, **params})
    elif kind == "boosted":
        model = GBTClassifier(**{**common, **BOOSTED, **params})
    else:
        raise ValueError(f"unknown model {kind!r}")
    return Pipeline(stages=[VectorAssembler(inputCols=list(features), outputCol="_features", handleInvalid="keep"), model])


def score_rows(model: PipelineModel, test: DataFrame) -> DataFrame:
    out = model.transform(test).withColumn("score", vector_to_array("probability")[1])
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int")).select(*SCORED)


def importances(spark, model: PipelineModel, features: Sequence[str]) -> DataFrame:
    """One row per feature."""
    values = model.stages[-1].featureImportances.toArray()
    return spark.createDataFrame([(f, float(v)) for f, v in zip(features, values)], "feature string, importance double")


def equalised(train: DataFrame, features: Sequence[str], seed: int, resample: str | None = "under") -> DataFrame:
    """Training rows with equal classes: less of the larger, ``smote`` of the smaller, or as they are (None)."""
    if resample == "under":
        return sampling.under_sample(train, "label", ["project", "row_id"], seed)
    if resample == "smote":
        extra = sampling.smote(train, "label", "row_id", features, seed)
        minority = train.groupBy("label").count().orderBy("count", F.desc("label")).first()  # two rows
        return train.select("label", *features).unionByName(extra.select(F.lit(minority["label"]).alias("label"), *features))
    return train


def fit_and_score(
    train: DataFrame, test: DataFrame, kind: str, features: Sequence[str], seed: int, resample: str | None = "under", **params: object
) -> tuple[DataFrame, PipelineModel | None]:
    """Scored test rows and the model; ``kind`` random scores by the training rate.

    The classes of the training rows are made equal by leaving out rows of the larger one,
    by synthetic rows of the smaller one (``smote``), or not at all (None).
    """
    if kind == "random":
        out = sampling.random_baseline(train, test, "label", ["project", "row_id"], seed)
        return out.withColumn("score", F.col("predicted").cast("double")).select(*SCORED), None
    train = equalised(train, features, seed, resample)
    model = estimator(kind, features, seed, **params).fit(train)
    return score_rows(model, test), model


def time_folds(df: DataFrame, k: int, recent: bool, entity: str = "project") -> DataFrame:
    """Sequential chunk ``_chunk`` per row; entities with fewer than 2k rows drop out."""
    return day_chunks(df, k, entity, least=2 * k)


def day_chunks(df: DataFrame, k: int, entity: str = "project", least: int = 1) -> DataFrame:
    """Consecutive chunks of ceil(n / k) rows by day, then by row id, numbered from 0.

    Places come from running totals per day and range of ids, so the rows of one entity never
    meet in a task.
    """
    placed = wn.history_counts(df, [entity], ["row_id"], {"_place": F.lit(1)})
    sizes = df.groupBy(entity).agg(F.count("*").alias("_n")).filter(F.col("_n") >= least)
    chunk = F.floor((F.col("_place") - 1) / F.greatest(F.ceil(F.col("_n") / F.lit(k)), F.lit(1)))
    return placed.join(sizes, entity).withColumn("_chunk", chunk).drop("_place", "_n")


def time_series_validation(
    rows: DataFrame, entities: Sequence[str], kind: str, features: Sequence[str], k: int, seed: int, recent: bool = False, **params: object
) -> DataFrame:
    """Walk-forward validation inside each entity: train on earlier chunks, test the next."""
    chunked = time_folds(rows, k, recent)
    parts = []
    for entity in entities:
        own = chunked.filter(F.col("project") == entity)
        # classes per chunk: at most 2k rows
        seen: dict[int, set[int]] = {}
        for r in own.select("_chunk", "label").distinct().collect():
            seen.setdefault(int(r["_chunk"]), set()).add(r["label"])
        for fold in range(1, len(seen)):
            low = fold - 1 if recent else 0
            if len(set().union(*[seen.get(c, set()) for c in range(low, fold)])) < 2:
                continue
            train = own.filter(F.col("_chunk").between(low, fold - 1))
            scored, _ = fit_and_score(train, own.filter(F.col("_chunk") == fold), kind, features, seed, **params)
            parts.append(scored.withColumn("fold", F.lit(f"fold-{fold}")))
    if not parts:
        return rows.limit(0).select("project", "row_id", "label", F.lit(0.0).alias("score"), F.lit(0).alias("predicted"), F.lit("").alias("fold"))
    return union_all(parts)


def cross_entity_validation(
    rows: DataFrame,
    target: str,
    kind: str,
    features: Sequence[str],
    seed: int,
    scope: str = "exclude_target",
    listed: Sequence[str] = (),
    mode: str = "full",
    k: int = 5,
    **params: object,
) -> tuple[DataFrame, PipelineModel | None] | None:
    """Train once on other entities and score the target, in one hold-out or by folds.

    None when the training rows have one class.
    """
    schema = {"project": "string", "row_id": "bigint", "label": "int", **{f: "double" for f in features}}
    train = sampling.training_set(rows, scope, target, schema, listed)
    if train is None:
        return None
    test = rows.filter(F.col("project") == target)
    scored, model = fit_and_score(train, test, kind, features, seed, **params)
    labels = test_folds(test, mode, k, seed).select("project", "row_id", "fold")
    return scored.join(labels, ["project", "row_id"]), model


def test_folds(rows: DataFrame, mode: str, k: int, seed: int) -> DataFrame:
    """``fold`` of each row inside its project: one hold-out, stratified folds, or chunks by day."""
    if mode == "full":
        return rows.withColumn("fold", F.lit("full"))
    if mode == "stratified":
        dealt = sampling.stratified_folds(rows, "label", ["project", "row_id"], k, seed, by=["project"], name="_f")
    elif mode == "time":
        dealt = day_chunks(rows, k).withColumnRenamed("_chunk", "_f")
    else:
        raise ValueError(f"unknown mode {mode!r}")
    return dealt.withColumn("fold", F.concat(F.lit("fold-"), F.col("_f") + 1)).drop("_f")


def fold_sizes(rows: DataFrame, mode: str, k: int, seed: int) -> DataFrame:
    """Per target and fold: sizes and positives of the test rows, of the training rows (all
    other entities) and of the training rows after equalising; ``skipped`` marks one class."""
    count = lambda n, p: [F.count("*").alias(n), F.sum("label").cast("bigint").alias(p)]
    tests = test_folds(rows, mode, k, seed).groupBy("project", "fold").agg(*count("n_test", "pos_test"))
    own = rows.groupBy("project").agg(*count("_n", "_p"))
    out = ag.with_constants(tests.join(own, "project"), own.agg(F.sum("_n").alias("_all"), F.sum("_p").alias("_pos")))
    out = out.withColumns({"n_train": F.col("_all") - F.col("_n"), "pos_train": F.col("_pos") - F.col("_p")})
    least = F.least("pos_train", F.col("n_train") - F.col("pos_train"))
    return out.withColumns({"n_equal": 2 * least, "skipped": least == 0}).drop("_n", "_p", "_all", "_pos")


def walk_forward_sizes(rows: DataFrame, k: int, recent: bool = False) -> DataFrame:
    """Per entity and fold of ``time_series_validation``: training and test sizes and positives."""
    per = time_folds(rows, k, recent).groupBy("project", "_chunk").agg(F.count("*").alias("n_test"), F.sum("label").cast("bigint").alias("pos_test"))
    order = Window.partitionBy("project").orderBy("_chunk").rowsBetween(-1 if recent else Window.unboundedPreceding, -1)
    out = per.withColumns({"n_train": F.sum("n_test").over(order), "pos_train": F.sum("pos_test").over(order)}).filter("_chunk > 0")
    one = (F.col("pos_train") == 0) | (F.col("pos_train") == F.col("n_train"))
    return out.select("project", F.concat(F.lit("fold-"), "_chunk").alias("fold"), "n_train", "pos_train", "n_test", "pos_test", one.alias("skipped"))


def repeated_scores(rows: DataFrame, targets: Sequence[str], kind: str, features: Sequence[str], repetitions: int, seed: int, **options: object) -> DataFrame:
    """Scored rows of every target and repetition (seed, seed + 1, ...)."""
    parts = []
    for target in targets:
        for i in range(repetitions):
            got = cross_entity_validation(rows, target, kind, features, seed + i, **options)
            if got is not None:
                parts.append(got[0].withColumn("repetition", F.lit(i)))
    return reduce(lambda a, b: a.unionByName(b), parts)


def average_scores(scored: DataFrame) -> DataFrame:
    """Mean score per row over repetitions."""
    return scored.groupBy("project", "row_id").agg(F.max("label").alias("label"), F.avg("score").alias("score"))


def experiments(
    rows: DataFrame, targets: Sequence[str], kind: str, feature_sets: Mapping[str, Sequence[str]], repetitions: int, seed: int, **options: object
) -> DataFrame:
    """Averaged scores of each feature set."""
    parts = [
        average_scores(repeated_scores(rows, targets, kind, features, repetitions, seed, **options)).withColumn("experiment", F.lit(name))
        for name, features in feature_sets.items()
    ]
    return union_all(parts)


def risk_columns(table: DataFrame, scores: DataFrame, names: Sequence[str], keys: Sequence[str], threshold: float = 0.5) -> DataFrame:
    """Add ``predicted_risk_X`` and ``predicted_label_X`` per experiment to the table's rows."""
    wide = scores.groupBy(*keys).pivot("experiment", list(names)).agg(F.max("score"))
    out = table.join(wide, list(keys), "left")
    for n in names:
        label = F.when(F.col(n) >= threshold, 1).when(F.col(n) < threshold, 0)
        out = out.withColumns({f"predicted_risk_{n}": F.col(n), f"predicted_label_{n}": label}).drop(n)
    return out


def fold_metrics(scored: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Class report, areas, positive rate and sizes per key, null where undefined."""
    report = scored.groupBy(*keys).agg(*ag.confusion("label", "predicted")).select(*keys, *ag.class_report())
    return report.join(curves.ranking_areas(scored, "score", "label", keys), list(keys))


def parameter_search(
    rows: DataFrame, kind: str, features: Sequence[str], space: Mapping[str, Sequence[object]], draws: int, seed: int, folds: int = 3, resample: str | None = "under", **fixed: object
) -> tuple[DataFrame, dict[str, object], PipelineModel]:
    """Random search over expanding time folds by area under the PR curve, then a refit.

    ``rows`` has a ``_chunk`` from 0 to ``folds``. Classes of training rows are made equal as in
    ``fit_and_score``; test rows stay as they are. Returns one row per draw, the best
    settings and the model fitted on everything.
    """
    rng = random.Random(seed)
    evaluator = BinaryClassificationEvaluator(rawPredictionCol="score", labelCol="label", metricName="areaUnderPR")
    results = []
    for n in range(draws):
        chosen = {p: rng.choice(list(v)) for p, v in space.items()}
        marks = []
        for fold in range(1, folds + 1):
            train, test = rows.filter(F.col("_chunk") < fold), rows.filter(F.col("_chunk") == fold)
            model = estimator(kind, features, seed, **{**fixed, **chosen}).fit(equalised(train, features, seed, resample))
            marks.append(evaluator.evaluate(score_rows(model, test)))
        results.append((n, str(chosen), sum(marks) / len(marks), chosen))
    best = max(results, key=lambda r: (r[2], -r[0]))
    model = estimator(kind, features, seed, **{**fixed, **best[3]}).fit(equalised(rows, features, seed, resample))
    table = rows.sparkSession.createDataFrame([r[:3] for r in results], "draw int, settings string, pr_auc double")
    return table, best[3], model
