"""Many forests and boosted models at once: every fit of an evaluation is part of one Spark job.

A training set is named by ``set`` (a target left out, a fold, ...) and bounded: the first ``most``
labelled rows of each class in the order of a hash of the row. That is the only bound; test rows
are never sampled. Trees are dealt out in units, units to parts. A task gets the rows of a set once,
grows its units and lets the set's test rows pass, so no model is kept and nothing returns to the
driver. Sums per row and fit are added up by Spark.
"""

from __future__ import annotations

import json
import math
import random
from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from riskloom.learning import curves, trees
from riskloom.learning.sampling import seeded_hash

MOST_ROWS = 4096  # labelled training rows of a class in a set
UNIT = 125  # trees that grow together
PART_UNITS = 6  # units of a task
BATCH = 10_000  # test rows that are scored together; equal bins are scored once

# Settings of the two tree models.
FOREST = {"trees": 1500, "candidates": "sqrt", "bootstrap": True}
BOOSTED = {"rounds": 1000, "max_depth": 4, "rate": 0.03, "min_leaf": 1.0, "subsample": 0.8, "columns": 0.8, "l1": 1.0, "l2": 2.0, "least_gain": 1.0, "min_split": 0.0}
# The settings a random search draws from.
FOREST_SPACE: dict[str, list[object]] = {
    "trees": [200, 500, 1000, 1500],
    "max_depth": [None, 5, 10, 20, 30],
    "min_split": [2, 5, 10, 20, 50],
    "min_leaf": [1, 2, 5, 10, 20],
    "candidates": ["sqrt", "log2", 0.3, 0.5, 0.8, 1.0],
    "bootstrap": [True, False],
}
BOOSTED_SPACE: dict[str, list[object]] = {
    "rounds": [200, 500, 800, 1200],
    "max_depth": [3, 4, 6, 8, 10],
    "rate": [0.01, 0.05, 0.1, 0.2, 0.3],
    "subsample": [0.5, 0.7, 0.9, 1.0],
    "columns": [0.5, 0.7, 0.9, 1.0],
    "min_leaf": [1, 3, 5, 10, 20],
    "least_gain": [0, 1, 5, 10],
    "l1": [0, 1, 5, 10],
    "l2": [1, 5, 10, 20],
}
SPACES = {"random_forest": FOREST_SPACE, "boosted": BOOSTED_SPACE}


@dataclass(frozen=True)
class Fit:
    """One model: ``features`` are places in the vectors ``x``, None for all of them."""

    name: str
    set: str
    kind: str
    seed: int
    params: Mapping[str, object] = field(default_factory=dict)
    features: tuple[int, ...] | None = None
    equalise: bool = True

    def settings(self) -> dict[str, object]:
        if self.kind not in SPACES:
            raise ValueError(f"unknown model {self.kind!r}")
        return {**(FOREST if self.kind == "random_forest" else BOOSTED), **self.params}

    def units(self) -> list[int]:
        """Trees of each unit; rounds depend on each other and are one."""
        if self.kind == "boosted":
            return [int(self.settings()["rounds"])]
        count = int(self.settings()["trees"])
        return [min(UNIT, count - i) for i in range(0, count, UNIT)]


def vectors(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """With ``x``, the features as one array; null is 0."""
    return df.withColumn("x", F.array(*[F.coalesce(F.col(f).cast("double"), F.lit(0.0)) for f in features]))


def training_rows(train: DataFrame, most: int = MOST_ROWS) -> DataFrame:
    """(set, row_id, label, x, place): the first ``most`` rows of each set and class by hash.

    Spark drops rows beyond that place before the shuffle. Null labels are left out.
    """
    hashed = train.filter("label IS NOT NULL").withColumn("_h", seeded_hash(0, "row_id"))
    place = F.row_number().over(Window.partitionBy("set", "label").orderBy("_h", "row_id"))
    return hashed.withColumn("place", place).filter(F.col("place") <= most).select("set", "row_id", "label", "x", "place")


def _candidates(rule: object, width: int) -> int:
    if rule is None:
        return width
    if rule in ("sqrt", "log2"):
        return max(1, int(math.sqrt(width) if rule == "sqrt" else math.log2(width)))
    return max(1, int(float(rule) * width))


def grow_unit(x: np.ndarray, y: np.ndarray, spec: Mapping[str, object]) -> tuple[list[trees.Block], list[np.ndarray]]:
    """The trees of one unit and the cuts of their bins; classes are made equal by leaving out rows."""
    s, seed, cuts = spec["settings"], int(spec["seed"]), trees.bin_cuts(x)
    if spec["equalise"]:
        rng = np.random.default_rng((seed, 0))
        least = min(int(y.sum()), int(len(y) - y.sum()))
        rows = np.sort(np.concatenate([rng.permutation(np.nonzero(y == c)[0])[:least] for c in (0, 1)]))
        x, y = x[rows], y[rows]
    bins = trees.to_bins(x, cuts)
    shape = trees.Shape(max_depth=s.get("max_depth"), min_split=float(s.get("min_split", 2)), min_leaf=float(s.get("min_leaf", 1)))
    if spec["kind"] == "boosted":
        shape = replace(shape, l1=float(s["l1"]), l2=float(s["l2"]), least_gain=max(float(s["least_gain"]), 1e-6))
        return trees.grow_boosted(bins, y, int(spec["count"]), float(s["rate"]), shape, (seed, 1), float(s["subsample"]), float(s["columns"])), cuts
    shape = replace(shape, candidates=_candidates(s["candidates"], x.shape[1]))
    return [trees.grow_forest(bins, y, int(spec["count"]), shape, (seed, 1, int(spec["unit"])), bool(s["bootstrap"]))], cuts


class _Part:
    """The models of one part: grown once, then asked for each batch of test rows."""

    def __init__(self, set_name: str, labels: list[int], x: list[list[float]], specs: list[dict[str, object]]):
        self.set, self.models = set_name, []
        y, matrix = np.array(labels, dtype=float), np.array(x, dtype=float).reshape(len(labels), -1)
        if len(set(labels)) < 2:
            return  # one class gives no model
        for spec in specs:
            own = spec["features"] if spec["features"] is not None else list(range(matrix.shape[1]))
            blocks, cuts = grow_unit(matrix[:, own], y, spec)
            self.models.append((spec["fit"], own, cuts, blocks))

    def importances(self) -> Iterator[tuple[str, int, float]]:
        """(fit, feature, gain as a share of its tree's, added up over trees)."""
        for fit, own, _, blocks in self.models:
            gains = np.concatenate([b.gains for b in blocks])
            share = gains / np.where(gains.sum(axis=1, keepdims=True) > 0, gains.sum(axis=1, keepdims=True), 1.0)
            yield from ((fit, f, float(v)) for f, v in zip(own, share.sum(axis=0)))

    def scores(self, x: np.ndarray) -> Iterator[tuple[str, np.ndarray]]:
        """(fit, sum over this part's trees of the value each row meets)."""
        binned: dict[tuple[int, ...], tuple[np.ndarray, np.ndarray]] = {}
        for fit, own, cuts, blocks in self.models:
            if tuple(own) not in binned:  # cuts depend on the set and the features only
                distinct, back = np.unique(trees.to_bins(x[:, own], cuts), axis=0, return_inverse=True)
                binned[tuple(own)] = distinct, back.ravel()
            distinct, back = binned[tuple(own)]
            total = np.zeros(len(distinct))
            for block in blocks:
                total += block.leaves(distinct).sum(axis=0)
            yield fit, total[back]


_OUT = "set string, fit string, row_id long, feature int, value double"


def _task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of a (set, part) follow each other: training rows, units, test rows."""
    now, held, specs, part = None, None, [], None

    def out(fit: list[str], row_id: list[int | None], feature: list[int | None], value: np.ndarray | list[float]) -> pa.RecordBatch:
        kinds = [pa.string(), pa.string(), pa.int64(), pa.int32(), pa.float64()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(([now[0]] * len(fit), fit, row_id, feature, value), kinds)], ["set", "fit", "row_id", "feature", "value"])

    def ready() -> Iterator[pa.RecordBatch]:
        nonlocal part
        if part is None and held is not None:
            part = _Part(now[0], *held, specs)
            rows = list(part.importances())
            yield out([r[0] for r in rows], [None] * len(rows), [r[1] for r in rows], [r[2] for r in rows])

    for whole in batches:
        for start in range(0, whole.num_rows, BATCH):
            batch = whole.slice(start, BATCH)
            keys = list(zip(*(batch.column(c).to_pylist() for c in ("set", "part", "kind"))))
            cuts = [0, *(i for i in range(1, len(keys)) if keys[i] != keys[i - 1]), len(keys)]
            for a, b in zip(cuts, cuts[1:]):
                if keys[a][:2] != now:
                    if now is not None:
                        yield from ready()
                    now, held, specs, part = keys[a][:2], None, [], None
                run = batch.slice(a, b - a)
                if keys[a][2] == 0:
                    held = run.column("labels")[0].as_py(), run.column("xs")[0].as_py()
                elif keys[a][2] == 1:
                    specs += [json.loads(t) for t in run.column("spec").to_pylist()]
                else:
                    yield from ready()
                    if part is not None and part.models:
                        x = run.column("x").flatten().to_numpy(zero_copy_only=False).reshape(b - a, -1)
                        for fit, values in part.scores(x):
                            yield out([fit] * (b - a), run.column("row_id").to_pylist(), [None] * (b - a), values)
    if now is not None:
        yield from ready()


def _grown(fits: Sequence[Fit], train: DataFrame, test: DataFrame, most: int) -> DataFrame:
    spark, units, parts = train.sparkSession, [], {}
    for fit in fits:
        for no, count in enumerate(fit.units()):
            parts[fit.set] = parts.get(fit.set, -1) + 1
            spec = {"fit": fit.name, "kind": fit.kind, "seed": fit.seed, "unit": no, "count": count, "settings": fit.settings(), "features": fit.features, "equalise": fit.equalise}
            units.append((fit.set, parts[fit.set] // PART_UNITS, json.dumps(spec)))
    slots = [(name, i) for name, last in parts.items() for i in range(last // PART_UNITS + 1)]
    slot = F.broadcast(spark.createDataFrame(slots, "set string, part int"))  # as long as the list of fits asks for
    packed = training_rows(train, most).groupBy("set").agg(F.array_sort(F.collect_list(F.struct("label", "place", "x"))).alias("rows"))
    none = lambda kind: F.lit(None).cast(kind)
    shape = {"labels": "array<int>", "xs": "array<array<double>>", "spec": "string", "row_id": "long", "x": "array<double>"}

    def shaped(df: DataFrame, kind: int) -> DataFrame:
        return df.select("set", "part", F.lit(kind).alias("kind"), *[F.col(c) if c in df.columns else none(t).alias(c) for c, t in shape.items()])

    rows = packed.select("set", F.transform("rows", lambda r: r["label"].cast("int")).alias("labels"), F.transform("rows", lambda r: r["x"]).alias("xs"))
    both = shaped(rows.join(slot, "set"), 0).unionByName(shaped(spark.createDataFrame(units, "set string, part int, spec string"), 1))
    both = both.unionByName(shaped(test.select("set", "row_id", "x").join(slot, "set"), 2))
    return both.repartition(min(2 * len(slots), 4096), "set", "part").sortWithinPartitions("set", "part", "kind").mapInArrow(_task, _OUT)


def _sizes(spark: SparkSession, fits: Sequence[Fit]) -> DataFrame:
    rows = [(f.set, f.name, f.kind, int(f.settings().get("trees", 1))) for f in fits]
    return F.broadcast(spark.createDataFrame(rows, "set string, fit string, kind string, trees int"))  # the list of fits


def score(fits: Sequence[Fit], train: DataFrame, test: DataFrame, most: int = MOST_ROWS) -> DataFrame:
    """(set, fit, row_id, score): every fit of a set scores the set's test rows.

    ``train`` has (set, row_id, label, x), ``test`` (set, row_id, x) with one row per id. Names of
    fits are unique in a set. A set with fewer than two classes gives no rows.
    """
    sums = _grown(fits, train, test, most).filter("row_id IS NOT NULL").groupBy("set", "fit", "row_id").agg(F.sum("value").alias("value"))
    value = F.when(F.col("kind") == "boosted", 1 / (1 + F.exp(-F.col("value")))).otherwise(F.col("value") / F.col("trees"))
    return sums.join(_sizes(train.sparkSession, fits), ["set", "fit"]).select("set", "fit", "row_id", value.alias("score"))


def importances(fits: Sequence[Fit], train: DataFrame, most: int = MOST_ROWS) -> DataFrame:
    """(set, fit, feature, importance): share of the gain, averaged over trees; a fit's shares sum to 1
    unless no tree has a split."""
    rows = _grown(fits, train, train.limit(0), most).filter("feature IS NOT NULL")
    sums = rows.groupBy("set", "fit", "feature").agg(F.sum("value").alias("value"))
    total = F.sum("value").over(Window.partitionBy("set", "fit"))  # one row per feature
    return sums.select("set", "fit", "feature", F.when(total > 0, F.col("value") / total).otherwise(0.0).alias("importance"))


# evaluations


def others(rows: DataFrame, targets: Sequence[str], entity: str = "project") -> DataFrame:
    """Rows with ``set``, once for every target they do not belong to."""
    sets = F.filter(F.array(*[F.lit(t) for t in targets]), lambda t: ~t.eqNullSafe(F.col(entity)))
    return rows.withColumn("set", F.explode(sets))


def across_entities(
    rows: DataFrame, targets: Sequence[str], kind: str, feature_sets: Mapping[str, Sequence[str]], repetitions: int, seed: int, most: int = MOST_ROWS, **params: object
) -> DataFrame:
    """Each target scored by models of all other entities: (experiment, repetition, project, row_id, label, score).

    All experiments, targets and repetitions (seed, seed + 1, ...) are one job.
    """
    names = sorted({f for own in feature_sets.values() for f in own})
    x = vectors(rows, names)
    fits = [
        Fit(f"{experiment}/{i}", t, kind, seed + i, params, tuple(names.index(f) for f in own))
        for experiment, own in feature_sets.items() for t in targets for i in range(repetitions)
    ]
    test = x.filter(F.col("project").isin(*targets)).withColumn("set", F.col("project"))
    cut = F.split("fit", "/")
    got = score(fits, others(x, targets), test, most).select(cut[0].alias("experiment"), cut[1].cast("int").alias("repetition"), F.col("set").alias("project"), "row_id", "score")
    return got.join(rows.select("project", "row_id", "label"), ["project", "row_id"])


def inside_entities(chunked: DataFrame, kind: str, features: Sequence[str], folds: int, seed: int, recent: bool = False, most: int = MOST_ROWS, entities: Sequence[str] = (), **params: object) -> DataFrame:
    """Walk-forward scores (project, row_id, label, score, fold): chunk i by a model of the chunks before it, or of the last one.

    ``chunked`` has ``_chunk`` from 0 to ``folds`` - 1. Folds whose training rows have one class give no rows.
    """
    x = vectors(chunked, features).filter(F.col("project").isin(*entities))
    named = F.concat("project", F.lit("/"), "fold")
    last = F.col("_chunk") + 1 if recent else F.lit(folds - 1)
    train = x.filter(F.col("_chunk") < folds - 1).withColumn("fold", F.explode(F.sequence(F.col("_chunk").cast("int") + 1, last.cast("int")))).withColumn("set", named)
    test = x.filter("_chunk > 0").withColumn("fold", F.col("_chunk").cast("int")).withColumn("set", named)
    fits = [Fit("model", f"{e}/{i}", kind, seed, params) for e in entities for i in range(1, folds)]
    got = score(fits, train, test, most).select("set", "row_id", "score")
    return test.select("set", "project", "row_id", "label", F.concat(F.lit("fold-"), "fold").alias("fold")).join(got, ["set", "row_id"]).drop("set")


def search(
    chunked: DataFrame, kind: str, features: Sequence[str], draws: int, seed: int, folds: int = 3, space: Mapping[str, Sequence[object]] | None = None, most: int = MOST_ROWS, **fixed: object
) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """Random search over expanding folds: (draw, settings, pr_auc), and a scorer fitted on all rows with the best draw.

    ``chunked`` has ``_chunk`` from 0 to ``folds``. All draws and folds are one job; the mark of a
    draw is its mean average precision over folds. Of equal marks the first draw wins.
    """
    rng, space = random.Random(seed), space or SPACES[kind]
    chosen = [{**fixed, **{p: rng.choice(list(v)) for p, v in space.items()}} for _ in range(draws)]
    x = vectors(chunked, features)
    train = x.filter(F.col("_chunk") < folds).withColumn("fold", F.explode(F.sequence(F.col("_chunk").cast("int") + 1, F.lit(folds)))).withColumn("set", F.col("fold").cast("string"))
    test = x.filter("_chunk > 0").withColumn("set", F.col("_chunk").cast("int").cast("string"))
    fits = [Fit(str(n), str(fold), kind, seed, s) for n, s in enumerate(chosen) for fold in range(1, folds + 1)]
    scored = score(fits, train, test, most).join(test.select("set", "row_id", "label"), ["set", "row_id"])
    marks = curves.ranking_areas(scored, "score", "label", ["fit", "set"]).groupBy("fit").agg(F.avg("average_precision").alias("pr_auc"))
    texts = chunked.sparkSession.createDataFrame([(n, json.dumps(s, sort_keys=True)) for n, s in enumerate(chosen)], "draw int, settings string")
    table = texts.join(marks.select(F.col("fit").cast("int").alias("draw"), "pr_auc"), "draw", "left")

    def refit(rows: DataFrame) -> DataFrame:
        best = table.orderBy(F.desc_nulls_last("pr_auc"), "draw").first()["draw"]  # one row
        whole = lambda df: vectors(df, features).withColumn("set", F.lit("all"))
        return score([Fit("best", "all", kind, seed, chosen[best])], whole(chunked), whole(rows), most).select("row_id", "score")

    return table, refit
