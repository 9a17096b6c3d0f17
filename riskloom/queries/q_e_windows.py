"""Window functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskloom.learning import curves
from riskloom.operators import ranking
from riskloom.operators import windows as wn
from riskloom.queries import standins as s
from riskloom.queries.registry import query
from riskloom.session import load

TIMELINE_CTE = f"""{s.SCORED_CTE}, {s.RATES_CTE},
timeline AS (
  SELECT project, day, rate, day_index, CASE WHEN rate > 0 THEN day_index * rate - rate + 1 ELSE day_index * rate END AS unit_start,
    day_index * rate AS unit_end, day_index * rate AS cumulative_units, commit_count
  FROM (SELECT s.project, s.day, CAST(coalesce(r.rate, 0) AS BIGINT) AS rate, commit_count,
          row_number() OVER (PARTITION BY s.project ORDER BY s.day) AS day_index
        FROM scored s LEFT JOIN rates r ON s.project = r.project))"""


def timeline(spark, sf, scored=None):
    daily = (scored if scored is not None else s.scored(spark, sf)).select("project", "day", "commit_count")
    return wn.capacity_timeline(daily.join(s.rates(spark, sf), "project", "left"), "rate")


@query("e01_capacity_timeline", f"""WITH {TIMELINE_CTE}
SELECT project, CAST(day AS VARCHAR) AS day, rate, CAST(day_index AS BIGINT) AS day_index, unit_start, unit_end, cumulative_units FROM timeline""")
def capacity_timeline(spark, sf):
    return timeline(spark, sf).select(
        "project", F.col("day").cast("string").alias("day"), "rate", F.col("day_index").cast("bigint").alias("day_index"), "unit_start", "unit_end", "cumulative_units"
    )


@query("e02_calendar_lag", f"""WITH {s.USER_DAYS_CTE}
SELECT a.user_id, CAST(a.day AS VARCHAR) AS day, b.n AS n_lag, CAST(b.n - c.n AS BIGINT) AS n_delta FROM user_days a
LEFT JOIN user_days b ON a.user_id = b.user_id AND b.day = a.day - 2 LEFT JOIN user_days c ON a.user_id = c.user_id AND c.day = a.day - 3""")
def calendar_lag(spark, sf):
    out = wn.lag_and_delta(s.user_days(spark, sf), "user_id", "n", 2)
    return out.select("user_id", F.col("day").cast("string").alias("day"), "n_lag", "n_delta")


@query("e03_expanding_median", f"""WITH {s.SCORED_CTE}
SELECT project, CAST(day AS VARCHAR) AS day, quantile_cont(CASE WHEN flagged = 1 THEN added END, 0.5)
  OVER (PARTITION BY project ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS past_median FROM scored""")
def expanding_median(spark, sf):
    out = wn.expanding_median(s.scored(spark, sf), "project", "added", F.col("flagged") == 1, "past_median")
    return out.select("project", F.col("day").cast("string").alias("day"), "past_median")


@query("e04_trailing_counts", f"""WITH {s.COMMIT_FILES_CTE}, ev AS (SELECT DISTINCT path, day FROM commit_files WHERE flagged = 1),
pr AS (SELECT DISTINCT path, day FROM commit_files)
SELECT pr.path, CAST(pr.day AS VARCHAR) AS day, count(ev.day) FILTER (WHERE ev.day > pr.day - 180) AS count_180d, count(ev.day) AS count_ever
FROM pr LEFT JOIN ev ON ev.path = pr.path AND ev.day < pr.day GROUP BY pr.path, pr.day""")
def trailing_counts(spark, sf):
    files = s.commit_files(spark, sf)
    out = wn.past_event_counts(files, files.filter("flagged = 1"), ["path"], [180])
    return out.select("path", F.col("day").cast("string").alias("day"), "count_180d", "count_ever")


_CHUNKS = f"""{s.SCORED_CTE}, ordered AS (SELECT project, day, row_number() OVER (PARTITION BY project ORDER BY day) - 1 AS i, count(*) OVER (PARTITION BY project) AS n FROM scored),
chunks AS (SELECT project, day, CAST(floor(i / greatest(ceil(n / 4.0), 1)) AS BIGINT) AS chunk FROM ordered)"""


@query("e05_sequential_chunks", f"WITH {_CHUNKS} SELECT project, CAST(day AS VARCHAR) AS day, chunk FROM chunks")
def sequential_chunks(spark, sf):
    out = wn.sequential_chunks(s.scored(spark, sf).select("project", "day"), "project", 4)
    return out.select("project", F.col("day").cast("string").alias("day"), "chunk")


@query("e06_walk_forward_folds", f"""WITH {_CHUNKS}, b AS (SELECT project, chunk, min(day) AS s, max(day) AS e, count(*) AS n FROM chunks GROUP BY ALL),
f AS (SELECT 'expanding' AS kind, t.project, t.chunk, t.s AS ts, t.e AS te, min(p.s) AS trs, max(p.e) AS tre, sum(p.n) AS trn FROM b t JOIN b p ON t.project = p.project AND p.chunk < t.chunk GROUP BY ALL
  UNION ALL SELECT 'recent', t.project, t.chunk, t.s, t.e, p.s, p.e, p.n FROM b t JOIN b p ON t.project = p.project AND p.chunk = t.chunk - 1)
SELECT kind, project, 'fold-' || chunk AS fold, CAST(ts AS VARCHAR) AS test_start, CAST(te AS VARCHAR) AS test_end, CAST(trs AS VARCHAR) AS train_start,
  CAST(tre AS VARCHAR) AS train_end, CAST(trn AS BIGINT) AS train_rows FROM f""")
def walk_forward_folds(spark, sf):
    daily = s.scored(spark, sf).select("project", "day")
    out = None
    for kind in ("expanding", "recent"):
        folds, _ = wn.walk_forward(daily, "project", 4, recent=kind == "recent")
        part = folds.select(
            F.lit(kind).alias("kind"), "project", "fold", *[F.col(c).cast("string").alias(c) for c in ("test_start", "test_end", "train_start", "train_end")], "train_rows"
        )
        out = part if out is None else out.unionByName(part)
    return out


@query("e07_top_per_group", """
SELECT o_orderpriority, o_orderkey, CAST(rank AS BIGINT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM orders) WHERE rank <= 10""")
def top_per_group(spark, sf):
    top = ranking.top_per_group(load(spark, sf, "orders"), ["o_orderpriority"], [F.desc("o_totalprice"), F.col("o_orderkey")], 10, "rank")
    return top.select("o_orderpriority", "o_orderkey", F.col("rank").cast("bigint").alias("rank"))


@query("e08_previous_revision", f"""WITH {s.COMMITS_CTE}, r AS (SELECT project, day, max(commit_id) AS revision FROM commits GROUP BY ALL)
SELECT * FROM (SELECT project, CAST(day AS VARCHAR) AS day, revision, lag(revision) OVER (PARTITION BY project ORDER BY day) AS previous FROM r) WHERE previous IS NOT NULL""")
def previous_revision(spark, sf):
    daily = s.commits(spark, sf).groupBy("project", "day").agg(F.max("commit_id").alias("revision"))
    return wn.previous_row(daily, "project", "revision", "previous").withColumn("day", F.col("day").cast("string"))


CURVE_CTE = """
pts AS (SELECT risk AS threshold, CAST(sum(flagged) AS BIGINT) AS pos, count(*) AS n FROM scored GROUP BY 1),
curve AS (SELECT threshold, pos, n, CAST(sum(pos) OVER w AS BIGINT) AS tp, CAST(sum(n) OVER w AS BIGINT) AS sel, CAST(sum(pos) OVER () AS BIGINT) AS total FROM pts WINDOW w AS (ORDER BY threshold DESC)),
pr AS (SELECT threshold, tp::DOUBLE / sel AS precision, tp::DOUBLE / total AS recall, tp, sel - tp AS fp, total - tp AS fn FROM curve)"""


@query("e09_precision_recall_curve", f"WITH {s.SCORED_CTE}, {CURVE_CTE} SELECT threshold, round(precision, 6) AS precision, round(recall, 6) AS recall, tp, fp, fn FROM pr")
def precision_recall_curve(spark, sf):
    out = curves.precision_recall(s.scored(spark, sf), "risk", "flagged")
    return out.withColumns({m: F.round(m, 6) for m in ("precision", "recall")})


@query("e10_allocate_budget", f"""WITH {s.SCORED_CTE}, r AS (SELECT project, day, added % 7 AS requested FROM scored),
t AS (SELECT *, sum(requested) OVER (PARTITION BY project) AS total, 500 + length(project) * 100 AS cap FROM r),
sc AS (SELECT *, CASE WHEN total > 0 THEN requested * (cap::DOUBLE / total) ELSE 0 END AS scaled FROM t),
b AS (SELECT *, floor(scaled) AS base FROM sc),
p AS (SELECT *, cap - sum(base) OVER (PARTITION BY project) AS remaining, row_number() OVER (PARTITION BY project ORDER BY scaled - base DESC, requested DESC, day) AS place FROM b)
SELECT project, CAST(day AS VARCHAR) AS day, CAST(CASE WHEN total <= cap THEN requested ELSE base + CASE WHEN place <= remaining AND base < requested THEN 1 ELSE 0 END END AS BIGINT) AS allocated FROM p""")
def allocate_budget(spark, sf):
    df = s.scored(spark, sf).select("project", "day", (F.col("added") % 7).alias("requested"), (F.lit(500.0) + F.length("project") * 100).alias("cap"))
    out = wn.allocate_budget(df, "project", "requested", "cap", "day")
    return out.select("project", F.col("day").cast("string").alias("day"), "allocated")


@query("e11_days_since_last", f"""WITH {s.COMMIT_FILES_CTE}
SELECT a.path, CAST(a.day AS VARCHAR) AS day, CAST(date_diff('day', max(b.day), a.day) AS INTEGER) AS days_since FROM (SELECT DISTINCT path, day FROM commit_files) a
JOIN (SELECT DISTINCT path, day FROM commit_files WHERE flagged = 1) b ON a.path = b.path AND b.day < a.day GROUP BY a.path, a.day""")
def days_since_last(spark, sf):
    files = s.commit_files(spark, sf)
    past = wn.past_event_counts(files, files.filter("flagged = 1"), ["path"], []).filter("last_day IS NOT NULL")
    return past.select("path", F.col("day").cast("string").alias("day"), F.datediff("day", "last_day").alias("days_since"))


@query("e12_timeline_summary", f"""WITH {TIMELINE_CTE}
SELECT project, CAST(max(day) AS VARCHAR) AS last_day, CAST(max(day_index) AS BIGINT) AS day_index, max(cumulative_units) AS cumulative_units, arg_min(unit_start, day) AS unit_start, max(unit_end) AS unit_end
FROM timeline GROUP BY 1""")
def timeline_summary(spark, sf):
    out = wn.timeline_summary(timeline(spark, sf))
    return out.withColumns({"last_day": F.col("last_day").cast("string"), "day_index": F.col("day_index").cast("bigint")})


@query("e13_running_id", f"""WITH {s.SCORED_CTE}
SELECT project, CAST(day AS VARCHAR) AS day, CAST(sum(flagged) OVER (PARTITION BY project ORDER BY day) AS BIGINT) AS hit_no FROM scored""")
def running_id(spark, sf):
    out = wn.running_id(s.scored(spark, sf), ["project"], "flagged", "hit_no")
    return out.select("project", F.col("day").cast("string").alias("day"), "hit_no")


@query("e14_peer_percentile", f"""WITH {s.COMMITS_CTE}, d AS (SELECT project, author, day, count(*) AS n FROM commits GROUP BY ALL),
t AS (SELECT x.project, x.day, d.author, sum(d.n) AS own FROM (SELECT DISTINCT project, day FROM d) x JOIN d ON d.project = x.project AND d.day BETWEEN x.day - 30 AND x.day GROUP BY ALL)
SELECT a.project, a.author, CAST(a.day AS VARCHAR) AS day, round((2 * count(*) FILTER (WHERE p.own < a.own) + count(*) FILTER (WHERE p.own = a.own) + 1) / (2.0 * count(*)), 6) AS percentile
FROM t a JOIN d ON d.project = a.project AND d.day = a.day AND d.author = a.author JOIN t p ON p.project = a.project AND p.day = a.day GROUP BY a.project, a.author, a.day""")
def peer_percentile(spark, sf):
    out = wn.peer_percentile(s.commits(spark, sf), "project", "author")
    return out.select("project", "author", F.col("day").cast("string").alias("day"), F.round("percentile", 6).alias("percentile"))


@query("e15_rank_sum_auc", f"""WITH {s.SCORED_CTE}, r AS (SELECT project, flagged, rank() OVER (PARTITION BY project ORDER BY risk) + (count(*) OVER (PARTITION BY project, risk) - 1) / 2.0 AS rk FROM scored),
a AS (SELECT project, sum(flagged) AS p, count(*) - sum(flagged) AS n, sum(CASE WHEN flagged = 1 THEN rk END) AS rs FROM r GROUP BY 1)
SELECT project, CAST(p AS BIGINT) AS n_pos, round((rs - p * (p + 1) / 2.0) / (p * n), 6) AS auc_roc FROM a""")
def rank_sum_auc(spark, sf):
    out = curves.ranking_areas(s.scored(spark, sf), "risk", "flagged", ["project"])
    return out.select("project", "n_pos", F.round("auc_roc", 6).alias("auc_roc"))


@query("e16_precision_areas", f"""WITH {s.SCORED_CTE}, pts AS (SELECT project, risk AS t, sum(flagged) AS pos, count(*) AS n FROM scored GROUP BY ALL),
c AS (SELECT *, sum(pos) OVER w AS tp, sum(n) OVER w AS sel, sum(pos) OVER (PARTITION BY project) AS total FROM pts WINDOW w AS (PARTITION BY project ORDER BY t DESC)),
x AS (SELECT *, tp / sel AS p1, coalesce(lag(tp / sel) OVER (PARTITION BY project ORDER BY t DESC), 1) AS p0 FROM c)
SELECT project, round(sum(pos / total * p1), 6) AS average_precision, round(sum(pos / total * (p1 + p0) / 2), 6) AS pr_auc_trapezoid FROM x GROUP BY 1""")
def precision_areas(spark, sf):
    out = curves.ranking_areas(s.scored(spark, sf), "risk", "flagged", ["project"])
    return out.select("project", *[F.round(m, 6).alias(m) for m in ("average_precision", "pr_auc_trapezoid")])


@query("e17_previous_change", f"""WITH {s.COMMIT_FILES_CTE}
SELECT path, commit_id, CAST(lag(day) OVER (PARTITION BY path ORDER BY day, commit_id) AS VARCHAR) AS previous_day FROM commit_files""")
def previous_change(spark, sf):
    out = wn.previous_change_day(s.commit_files(spark, sf), ["path"], ["commit_id"])
    return out.select("path", "commit_id", F.col("previous_day").cast("string").alias("previous_day"))
