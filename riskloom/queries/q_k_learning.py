"""Modelling and evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskloom.learning import curves
from riskloom.learning import ensembles as en
from riskloom.learning import evaluation as ev
from riskloom.learning import regression as rg
from riskloom.learning import sampling as sp
from riskloom.operators import windows as wn
from riskloom.operators.sets import union_all
from riskloom.queries import standins as s
from riskloom.queries.q_e_windows import CURVE_CTE
from riskloom.queries.registry import query
from riskloom.session import load, settle

FEATURES = ["added", "deleted", "commit_count"]
# Trees, rounds, repetitions, folds and draws are those of the shipped jobs. A training set is
# bounded to 256 labelled rows of each class, test rows are whole. What does not depend on
# random draws (folds, sizes, classes, first splits) has queries of its own with SQL.
MOST = 256
FOLDS, REPETITIONS, DRAWS = 10, 30, 20
GROUPS = [f"g{i}" for i in range(5)]

ROWS_CTE = s.SCORED_CTE + """,
rows AS (SELECT 'g' || (CAST(substr(project, 2) AS INTEGER) % 5) AS project, CAST(substr(project, 2) AS BIGINT) * 100000 + date_diff('day', DATE '1990-01-01', day) AS row_id, day,
  flagged AS label, CAST(added AS DOUBLE) AS added, CAST(deleted AS DOUBLE) AS deleted, CAST(commit_count AS DOUBLE) AS commit_count, risk FROM scored)"""


def learning_rows(spark, sf):
    """Scored days of all projects in five groups, with a unique row id."""
    no = F.substring("project", 2, 9).cast("bigint")
    row_id = no * 100000 + F.datediff("day", F.lit("1990-01-01").cast("date"))
    df = s.scored(spark, sf).select(F.concat(F.lit("g"), no % 5).alias("project"), row_id.alias("row_id"), "day", "flagged", *FEATURES, "risk")
    prepared = sp.prepare_rows(df, "flagged", [*FEATURES, "risk"], ["project", "row_id", "day"])
    return prepared


@query("k01_prepare_rows", f"WITH {ROWS_CTE} SELECT project, row_id, label, added, deleted, commit_count, risk FROM rows ORDER BY day, row_id")
def prepare_rows(spark, sf):
    return learning_rows(spark, sf).orderBy("day", "row_id").drop("day")


@query("k02_training_set", f"WITH {ROWS_CTE} SELECT project, row_id, label, added, deleted, commit_count, 0.0::DOUBLE AS absent FROM rows WHERE project <> 'g2'")
def training_set(spark, sf):
    schema = {"project": "string", "row_id": "bigint", "label": "int", **{f: "double" for f in FEATURES}, "absent": "double"}
    return sp.training_set(learning_rows(spark, sf), "exclude_target", "g2", schema, one_class=True)


@query("k03_under_sample", f"""WITH {ROWS_CTE}, r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY md5(project || '::' || row_id || '::7')) AS place FROM rows)
SELECT row_id, label FROM r WHERE place <= (SELECT min(n) FROM (SELECT count(*) AS n FROM rows GROUP BY label))""")
def under_sample(spark, sf):
    return sp.under_sample(learning_rows(spark, sf), "label", ["project", "row_id"], 7).select("row_id", "label")


@query("k04_smote", """
WITH r AS (SELECT doc_id AS id, toxic AS label, CAST(n_chars AS DOUBLE) AS n_chars, CAST(length(text) - length(replace(text, ' ', '')) AS DOUBLE) AS blanks FROM documents JOIN labels USING (doc_id)),
sz AS (SELECT count(*) FILTER (WHERE label = 1) AS p, count(*) FILTER (WHERE label = 0) AS n FROM r), m AS (SELECT * FROM r WHERE label = 1),
pl AS (SELECT m.*, row_number() OVER (ORDER BY md5(id || '::11')) AS place FROM m),
sd AS (SELECT pl.*, unnest(generate_series(1, (n - p) // p + CASE WHEN place <= (n - p) % p THEN 1 ELSE 0 END)) AS draw FROM pl, sz),
nb AS (SELECT a.id, b.id AS other, b.n_chars AS o_chars, b.blanks AS o_blanks, row_number() OVER (PARTITION BY a.id ORDER BY sqrt((a.n_chars-b.n_chars)*(a.n_chars-b.n_chars) + (a.blanks-b.blanks)*(a.blanks-b.blanks)), b.id) AS rank FROM m a JOIN m b ON a.id <> b.id),
ch AS (SELECT sd.*, 1 + floor(CAST(('0x' || substr(md5(id || '::' || draw || '::11'), 1, 8)) AS BIGINT) / 4294967296.0 * least(5, p - 1)) AS pick,
  CAST(('0x' || substr(md5(id || '::' || draw || '::12'), 1, 8)) AS BIGINT) / 4294967296.0 AS gap FROM sd, sz)
SELECT ch.id, draw, round(n_chars + gap * (o_chars - n_chars), 6) AS n_chars, round(blanks + gap * (o_blanks - blanks), 6) AS blanks FROM ch JOIN nb ON nb.id = ch.id AND nb.rank = ch.pick""")
def smote(spark, sf):
    docs = load(spark, sf, "documents").join(load(spark, sf, "labels"), "doc_id")
    blanks = F.length("text") - F.length(F.replace("text", F.lit(" "), F.lit("")))
    rows = docs.select("doc_id", F.col("toxic").alias("label"), F.col("n_chars").cast("double").alias("n_chars"), blanks.cast("double").alias("blanks"))
    out = sp.smote(rows, "label", "doc_id", ["n_chars", "blanks"], 11)
    return out.select("id", "draw", F.round("n_chars", 6).alias("n_chars"), F.round("blanks", 6).alias("blanks"))


def _rows(spark, sf):
    return settle(learning_rows(spark, sf), "rows")


def _holdout(spark, sf, kind, **params):
    scored = en.across_entities(_rows(spark, sf), GROUPS, kind, {"all": FEATURES}, 1, 1, MOST, **params)
    return scored.select("project", "row_id", "label", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


@query("k05_random_forest")
def random_forest(spark, sf):
    return _holdout(spark, sf, "random_forest")


@query("k06_boosted_trees")
def boosted_trees(spark, sf):
    return _holdout(spark, sf, "boosted")


def _split_sql(l1: float, l2: float, least_gain: float, g: str, h: str, leaf: str) -> str:
    """Scores of one tree of two levels on all features, from the gradients ``g`` and Hessians ``h`` of training rows."""
    names = [f"'{f}'" for f in FEATURES]
    of = lambda n: f"(CASE WHEN abs({n}) > {l1} THEN sign({n}) * (abs({n}) - {l1}) ELSE 0 END)"

    def level(rows: str, keys: str) -> str:
        left, right = of("gl"), of("(gt - gl)")
        return f"""SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY round(gain, 7) DESC, f, cut) AS best FROM (
          SELECT {keys}, f, cut, ({left})**2 / (hl + {l2}) + ({right})**2 / (ht - hl + {l2}) - ({of("gt")})**2 / (ht + {l2}) AS gain FROM (
            SELECT {keys}, f, cut, sum(CASE WHEN v <= cut THEN g ELSE 0 END) AS gl, sum(CASE WHEN v <= cut THEN h ELSE 0 END) AS hl, sum(g) AS gt, sum(h) AS ht
            FROM {rows} JOIN cuts USING (tset, f) GROUP BY {keys}, f, cut) WHERE hl >= 1 AND ht - hl >= 1 AND ht >= 2)
          WHERE gain >= {least_gain}) WHERE best = 1"""

    side = "CASE WHEN {0}.v <= s.cut THEN 0 ELSE 1 END"
    return f"""WITH {ROWS_CTE},
    sets AS (SELECT DISTINCT project AS tset FROM rows),
    pool AS (SELECT * FROM (SELECT tset, rows.*, row_number() OVER (PARTITION BY tset, label ORDER BY md5(row_id || '::0'), row_id) AS place FROM rows JOIN sets ON tset <> project) WHERE place <= {MOST}),
    cells AS (SELECT tset, row_id, label, {g} AS g, {h} AS h, unnest([0, 1, 2]) AS f, unnest([{", ".join(FEATURES)}]) AS v FROM pool),
    sorted AS (SELECT tset, f, list_sort(list(v)) AS vs, count(DISTINCT v) AS n, max(v) AS top FROM cells GROUP BY tset, f),
    cuts AS (SELECT DISTINCT tset, f, cut FROM (SELECT tset, f, n, top, unnest(CASE WHEN n <= 64 THEN vs ELSE list_transform(range(1, 64), lambda i: vs[1 + CAST(floor(i / 64.0::DOUBLE * (len(vs) - 1)) AS BIGINT)]) END) AS cut FROM sorted) WHERE n > 64 OR cut < top),
    one AS ({level("cells", "tset")}),
    sided AS (SELECT c.*, {side.format("k")} AS side FROM cells c JOIN one s USING (tset) JOIN cells k ON k.tset = c.tset AND k.row_id = c.row_id AND k.f = s.f),
    two AS ({level("sided", "tset, side")}),
    test AS (SELECT project AS tset, row_id, label, unnest([0, 1, 2]) AS f, unnest([{", ".join(FEATURES)}]) AS v FROM rows),
    first_side AS (SELECT t.tset, t.row_id, t.label, {side.format("t")} AS side FROM test t JOIN one s USING (tset, f)),
    second_side AS (SELECT a.*, CASE WHEN s.f IS NULL THEN 2 WHEN t.v <= s.cut THEN 0 ELSE 1 END AS deep FROM first_side a LEFT JOIN two s USING (tset, side)
      LEFT JOIN test t ON t.tset = a.tset AND t.row_id = a.row_id AND t.f = s.f),
    leaves AS (SELECT c.tset, c.side, CASE WHEN s.f IS NULL THEN 2 WHEN k.v <= s.cut THEN 0 ELSE 1 END AS deep, sum(c.g) AS gt, sum(c.h) AS ht
      FROM (SELECT * FROM sided WHERE f = 0) c LEFT JOIN two s USING (tset, side) LEFT JOIN cells k ON k.tset = c.tset AND k.row_id = c.row_id AND k.f = s.f GROUP BY ALL)
    SELECT tset AS project, row_id, label, round({leaf.format(of("gt"))}, 9) AS score FROM second_side JOIN leaves USING (tset, side, deep)"""


def _first_splits(spark, sf, kind, **params):
    """One tree of two levels, on all rows of the training sets and all features."""
    rows = en.vectors(_rows(spark, sf), FEATURES)
    fits = [en.Fit("tree", t, kind, 1, {"max_depth": 2, **params}, equalise=False) for t in GROUPS]
    scored = en.score(fits, en.others(rows, GROUPS), rows.withColumn("set", F.col("project")), MOST)
    scored = scored.select(F.col("set").alias("project"), "row_id", F.round("score", 9).alias("score"))
    return rows.select("project", "row_id", "label").join(scored, ["project", "row_id"])


@query("k05_first_splits", _split_sql(0, 0, -1e-9, "-label::DOUBLE", "1.0::DOUBLE", "-gt / ht"))
def forest_first_splits(spark, sf):
    return _first_splits(spark, sf, "random_forest", trees=1, bootstrap=False, candidates=None)


@query("k06_first_round", _split_sql(1, 2, 1, "0.5::DOUBLE - label", "0.25::DOUBLE", "1 / (1 + exp(0.03 * {0} / (ht + 2)))"))
def boosted_first_round(spark, sf):
    return _first_splits(spark, sf, "boosted", rounds=1, subsample=1.0, columns=1.0)


@query("k07_random_baseline", f"""WITH {ROWS_CTE}, rate AS (SELECT project, avg(label) AS p FROM rows WHERE day < DATE '1998-01-01' GROUP BY 1)
SELECT r.project, row_id, CASE WHEN CAST(('0x' || substr(md5(r.project || '::' || row_id || '::3'), 1, 8)) AS BIGINT) / 4294967296.0 < p THEN 1 ELSE 0 END AS predicted
FROM rows r JOIN rate ON r.project = rate.project WHERE day >= DATE '1998-01-01'""")
def random_baseline(spark, sf):
    rows, cut = learning_rows(spark, sf), F.lit("1998-01-01").cast("date")
    out = sp.random_baseline(rows.filter(F.col("day") < cut), rows.filter(F.col("day") >= cut), "label", ["project", "row_id"], 3, entity=["project"])
    return out.select("project", "row_id", "predicted")


@query("k08_parameter_search")
def parameter_search(spark, sf):
    # chunks of the whole table by day: one chunk per quarter of the days on record
    rows = learning_rows(spark, sf)
    days = wn.sequential_chunks(rows.select("day").distinct().withColumn("_all", F.lit(1)), "_all", 4, "_chunk").select("day", "_chunk")
    chunked = settle(rows.join(days, "day"), "search")
    return en.search(chunked, "random_forest", FEATURES, DRAWS, seed=1, folds=3, most=MOST)[0]


@query("k09_time_series_validation")
def time_series_validation(spark, sf):
    # rows of a group carry several projects, so the day is made unique per group first
    rows = learning_rows(spark, sf).groupBy("project", "day").agg(
        F.min("row_id").alias("row_id"), F.max("label").alias("label"), *[F.sum(f).alias(f) for f in FEATURES]
    )
    chunked = settle(ev.time_folds(settle(rows, "daily"), FOLDS, False), "chunks")
    scored = en.inside_entities(chunked, "random_forest", FEATURES, FOLDS, seed=1, most=MOST, entities=GROUPS)
    scored = settle(scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int")), "scores")
    return ev.fold_metrics(scored, ["project", "fold"])


_DAILY_SQL = "daily AS (SELECT project, day, min(row_id) AS row_id, max(label) AS label FROM rows GROUP BY ALL)"


@query("k09_walk_forward_sizes", f"""WITH {ROWS_CTE}, {_DAILY_SQL},
c AS (SELECT *, floor((row_number() OVER (PARTITION BY project ORDER BY day) - 1) / greatest(ceil(count(*) OVER (PARTITION BY project) / 10.0), 1)) AS chunk, count(*) OVER (PARTITION BY project) AS m FROM daily),
b AS (SELECT project, chunk, count(*) AS n, sum(label) AS p FROM c WHERE m >= 20 GROUP BY ALL),
f AS (SELECT t.project, t.chunk, t.n AS n_test, t.p AS pos_test, sum(e.n) AS n_train, sum(e.p) AS pos_train FROM b t JOIN b e ON e.project = t.project AND e.chunk < t.chunk GROUP BY ALL)
SELECT project, 'fold-' || CAST(chunk AS INTEGER) AS fold, CAST(n_train AS BIGINT) AS n_train, CAST(pos_train AS BIGINT) AS pos_train, n_test, CAST(pos_test AS BIGINT) AS pos_test, pos_train = 0 OR pos_train = n_train AS skipped FROM f""")
def walk_forward_sizes(spark, sf):
    rows = learning_rows(spark, sf).groupBy("project", "day").agg(F.min("row_id").alias("row_id"), F.max("label").alias("label"))
    return ev.walk_forward_sizes(settle(rows, "daily"), FOLDS)


@query("k10_stratified_folds", f"""WITH {ROWS_CTE}
SELECT project, row_id, label, CAST((row_number() OVER (PARTITION BY project, label ORDER BY md5(project || '::' || row_id || '::5')) - 1) % 5 AS INTEGER) AS fold FROM rows""")
def stratified_folds(spark, sf):
    out = sp.stratified_folds(learning_rows(spark, sf), "label", ["project", "row_id"], 5, 5, by=["project"])
    return out.select("project", "row_id", "label", "fold")


@query("k11_cross_entity_validation")
def cross_entity_validation(spark, sf):
    rows = _rows(spark, sf)
    scored = en.across_entities(rows, GROUPS, "random_forest", {"all": FEATURES}, 1, 1, MOST)
    scored = settle(scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int")), "scores")
    parts = [ev.test_folds(rows, mode, FOLDS, 1).select("project", "row_id", "fold", F.lit(mode).alias("mode")) for mode in MODES]
    return ev.fold_metrics(scored.join(union_all(parts), ["project", "row_id"]), ["mode", "project", "fold"])


MODES = ("full", "stratified", "time")
_OWN = "own AS (SELECT project, count(*) AS n, sum(label) AS p FROM rows GROUP BY 1)"


@query("k11_fold_sizes", f"""WITH {ROWS_CTE}, {_OWN},
st AS (SELECT *, row_number() OVER (PARTITION BY project, label ORDER BY md5(project || '::' || row_id || '::1')) AS r, row_number() OVER (PARTITION BY project ORDER BY day, row_id) AS t, count(*) OVER (PARTITION BY project) AS m FROM rows),
f AS (SELECT 'full' AS mode, project, 'full' AS fold, label FROM rows UNION ALL SELECT 'stratified', project, 'fold-' || ((r - 1) % 10 + 1), label FROM st
  UNION ALL SELECT 'time', project, 'fold-' || CAST(floor((t - 1) / greatest(ceil(m / 10.0), 1)) + 1 AS INTEGER), label FROM st),
z AS (SELECT mode, project, fold, count(*) AS n_test, CAST(sum(label) AS BIGINT) AS pos_test FROM f GROUP BY ALL),
a AS (SELECT sum(n) AS n, sum(p) AS p FROM own)
SELECT z.*, CAST(a.n - own.n AS BIGINT) AS n_train, CAST(a.p - own.p AS BIGINT) AS pos_train, CAST(2 * least(a.p - own.p, a.n - own.n - a.p + own.p) AS BIGINT) AS n_equal,
  least(a.p - own.p, a.n - own.n - a.p + own.p) = 0 AS skipped FROM z JOIN own ON own.project = z.project, a""")
def fold_sizes(spark, sf):
    rows = settle(learning_rows(spark, sf), "rows")
    parts = [ev.fold_sizes(rows, mode, FOLDS, 1).withColumn("mode", F.lit(mode)) for mode in MODES]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("k12_repeated_scores")
def repeated_scores(spark, sf):
    return ev.average_scores(en.across_entities(_rows(spark, sf), GROUPS, "random_forest", {"all": FEATURES}, REPETITIONS, 1, MOST))


@query("k13_feature_set_experiments")
def feature_set_experiments(spark, sf):
    sets = {"added": ["added"], "deleted": ["deleted"], "counts": ["commit_count"], "lines": ["added", "deleted"], "all": FEATURES}
    scored = en.across_entities(_rows(spark, sf), GROUPS, "random_forest", sets, REPETITIONS, 1, MOST)
    return scored.groupBy("experiment", "project", "row_id").agg(F.max("label").alias("label"), F.avg("score").alias("score"))


@query("k14_importances")
def importances(spark, sf):
    rows = en.vectors(_rows(spark, sf), FEATURES)
    fits = [en.Fit(str(i), t, "random_forest", 1 + i) for t in GROUPS for i in range(REPETITIONS)]
    found = en.importances(fits, en.others(rows, GROUPS), MOST)
    name = F.element_at(F.array(*[F.lit(f) for f in FEATURES]), F.col("feature") + 1)
    return found.groupBy(name.alias("feature")).agg(F.avg("importance").alias("importance"))


@query("k15_risk_columns", f"""WITH {ROWS_CTE}
SELECT row_id, risk AS predicted_risk_a, CASE WHEN risk >= 0.5 THEN 1 ELSE 0 END AS predicted_label_a,
  CASE WHEN row_id % 3 > 0 THEN risk / 2 END AS predicted_risk_b, CASE WHEN row_id % 3 > 0 THEN CASE WHEN risk / 2 >= 0.5 THEN 1 ELSE 0 END END AS predicted_label_b FROM rows""")
def risk_columns(spark, sf):
    rows = learning_rows(spark, sf).select("project", "row_id", "risk")
    a = rows.select("project", "row_id", F.col("risk").alias("score"), F.lit("a").alias("experiment"))
    b = rows.filter("row_id % 3 > 0").select("project", "row_id", (F.col("risk") / 2).alias("score"), F.lit("b").alias("experiment"))
    out = ev.risk_columns(rows.drop("risk"), a.unionByName(b), ["a", "b"], ["project", "row_id"])
    return out.drop("project")


@query("k16_fold_metrics", f"""WITH {ROWS_CTE}, f AS (SELECT project, row_id % 3 AS fold, label, risk AS score, CASE WHEN risk >= 0.6 THEN 1 ELSE 0 END AS predicted FROM rows),
k AS (SELECT project, fold, count(*) FILTER (WHERE label = 1 AND predicted = 1)::DOUBLE AS tp, count(*) FILTER (WHERE label = 0 AND predicted = 1)::DOUBLE AS fp,
  count(*) FILTER (WHERE label = 1 AND predicted = 0)::DOUBLE AS fn, count(*) FILTER (WHERE label = 0 AND predicted = 0)::DOUBLE AS tn FROM f GROUP BY ALL),
r AS (SELECT *, rank() OVER (PARTITION BY project, fold ORDER BY score) + (count(*) OVER (PARTITION BY project, fold, score) - 1) / 2.0 AS rk FROM f),
a AS (SELECT project, fold, sum(label) AS p, count(*) - sum(label) AS n, sum(CASE WHEN label = 1 THEN rk END) AS rs FROM r GROUP BY ALL)
SELECT k.project, k.fold, round(tp / (tp + fp), 6) AS precision, round(tp / (tp + fn), 6) AS recall, round(2 * tp / (2 * tp + fp + fn), 6) AS f1, round((tp + tn) / (tp + fp + fn + tn), 6) AS accuracy,
  round((tp*tn - fp*fn) / sqrt((tp+fp)*(tp+fn)*(tn+fp)*(tn+fn)), 6) AS mcc, round((rs - p * (p + 1) / 2.0) / (p * n), 6) AS auc_roc, round(p::DOUBLE / (p + n), 6) AS pos_rate, CAST(p AS BIGINT) AS n_pos, CAST(p + n AS BIGINT) AS n_test
FROM k JOIN a ON k.project = a.project AND k.fold = a.fold""")
def fold_metrics(spark, sf):
    rows = learning_rows(spark, sf).select(
        "project", (F.col("row_id") % 3).alias("fold"), "label", F.col("risk").alias("score"), (F.col("risk") >= 0.6).cast("int").alias("predicted")
    )
    out = ev.fold_metrics(rows, ["project", "fold"])
    doubles = ["precision", "recall", "f1", "accuracy", "mcc", "auc_roc", "pos_rate"]
    return out.select("project", "fold", *[F.round(m, 6).alias(m) for m in doubles], "n_pos", "n_test")


@query("k17_simple_regression", f"""WITH {s.SCORED_CTE}
SELECT project, round(regr_slope(deleted, added), 6) AS slope, round(regr_intercept(deleted, added), 6) AS intercept, count(*) AS count FROM scored GROUP BY 1""")
def simple_regression(spark, sf):
    out = rg.simple_fit(s.scored(spark, sf), ["project"], "added", "deleted")
    return out.withColumns({c: F.round(c, 6) for c in ("slope", "intercept")})


_NORMAL = """m AS (SELECT count(*)::DOUBLE AS n, sum(added) AS a, sum(commit_count) AS c, sum(deleted) AS y, sum(added * added) AS aa, sum(added * commit_count) AS ac, sum(commit_count * commit_count) AS cc,
  sum(added * deleted) AS ay, sum(commit_count * deleted) AS cy FROM scored),
z AS (SELECT *, aa - a * a / n AS saa, ac - a * c / n AS sac, cc - c * c / n AS scc, ay - a * y / n AS say, cy - c * y / n AS scy FROM m),
b AS (SELECT (say * scc - scy * sac) / (saa * scc - sac * sac) AS b1, (scy * saa - say * sac) / (saa * scc - sac * sac) AS b2, a, c, y, n FROM z)"""


@query("k18_multi_regression", f"""WITH {s.SCORED_CTE}, {_NORMAL}
SELECT project, CAST(day AS VARCHAR) AS day, round((y - b1 * a - b2 * c) / n + b1 * added + b2 * commit_count, 4) AS fitted FROM scored, (SELECT b1, b2, a, c, y, n FROM b)""")
def multi_regression(spark, sf):
    rows = s.scored(spark, sf)
    out = rg.predict(rows, rg.fit(rows, ["added", "commit_count"], "deleted"), ["added", "commit_count"], "fitted")
    return out.select("project", F.col("day").cast("string").alias("day"), F.round("fitted", 4).alias("fitted"))


@query("k19_leave_one_out_regression", f"""WITH {s.SCORED_CTE}, fit AS (SELECT p.project, regr_slope(s.deleted, s.added) AS b, regr_intercept(s.deleted, s.added) AS a FROM (SELECT DISTINCT project FROM scored) p JOIN scored s ON s.project <> p.project GROUP BY 1)
SELECT s.project, CAST(s.day AS VARCHAR) AS day, round(a + b * s.added, 4) AS fitted FROM scored s JOIN fit ON s.project = fit.project""")
def leave_one_out_regression(spark, sf):
    out = rg.leave_one_out_predictions(s.scored(spark, sf), "project", ["added"], "deleted", "fitted")
    return out.select("project", F.col("day").cast("string").alias("day"), F.round("fitted", 4).alias("fitted"))


@query("k20_entity_split", f"""WITH {s.SCORED_CTE}, e AS (SELECT project, row_number() OVER (ORDER BY md5(project || '::42'), project) AS r, count(*) OVER () AS n FROM (SELECT DISTINCT project FROM scored))
SELECT s.project, CASE WHEN r <= greatest(floor(n * (1.0::DOUBLE - 0.2::DOUBLE)), 1) THEN 1 ELSE 0 END AS is_train, count(*) AS rows FROM scored s JOIN e ON s.project = e.project GROUP BY ALL""")
def entity_split(spark, sf):
    out = rg.entity_split(s.scored(spark, sf), "project", 0.2, 42)
    return out.groupBy("project", F.col("is_train").cast("int").alias("is_train")).agg(F.count("*").alias("rows"))


@query("k21_precision_recall_per_entity", f"""WITH {s.SCORED_CTE}, {CURVE_CTE}, pp AS (SELECT project, risk AS threshold, sum(flagged) AS pos, count(*) AS n FROM scored GROUP BY ALL),
pc AS (SELECT project, threshold, CAST(sum(pos) OVER w AS BIGINT) AS tp, CAST(sum(n) OVER w AS BIGINT) AS sel, CAST(sum(pos) OVER (PARTITION BY project) AS BIGINT) AS total FROM pp WINDOW w AS (PARTITION BY project ORDER BY threshold DESC))
SELECT 'all' AS project, threshold, round(precision, 6) AS precision, round(recall, 6) AS recall, tp, fp, fn FROM pr
UNION ALL SELECT project, threshold, round(tp::DOUBLE / sel, 6), round(coalesce(tp::DOUBLE / nullif(total, 0), 0), 6), tp, sel - tp, total - tp FROM pc""")
def precision_recall_per_entity(spark, sf):
    rows = s.scored(spark, sf)
    everything = curves.precision_recall(rows, "risk", "flagged").select(F.lit("all").alias("project"), "*")
    out = everything.unionByName(curves.precision_recall(rows, "risk", "flagged", ["project"]))
    return out.withColumns({m: F.round(m, 6) for m in ("precision", "recall")})
