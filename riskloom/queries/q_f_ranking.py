"""Sorts, limits and top-k."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskloom.learning import curves
from riskloom.operators import aggregates as ag
from riskloom.operators import ranking as rk
from riskloom.operators import scans
from riskloom.queries import standins as s
from riskloom.queries.q_e_windows import CURVE_CTE
from riskloom.queries.registry import query
from riskloom.session import load


@query("f01_stable_sort", """
SELECT event_type, CASE WHEN event_id % 11 = 0 THEN NULL ELSE value END AS score, event_id FROM events ORDER BY event_type DESC, score NULLS LAST, event_id""")
def stable_sort(spark, sf):
    df = load(spark, sf, "events").select("event_type", F.when(F.col("event_id") % 11 != 0, F.col("value")).alias("score"), "event_id")
    return df.orderBy(F.desc("event_type"), F.asc_nulls_last("score"), "event_id")


@query("f02_order_by_list", """
SELECT o_orderkey, o_orderpriority FROM orders ORDER BY CASE o_orderpriority WHEN '5-LOW' THEN 1 WHEN '1-URGENT' THEN 2 ELSE 3 END, o_orderkey""")
def order_by_list(spark, sf):
    return rk.order_by_list(load(spark, sf, "orders"), "o_orderpriority", ["5-LOW", "1-URGENT"], "o_orderkey").select("o_orderkey", "o_orderpriority")


@query("f03_keep_top_entities", """
WITH top AS (SELECT user_id, count(*) FILTER (WHERE value > 50) AS hits FROM events GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10)
SELECT e.user_id, event_id, hits FROM events e JOIN top ON e.user_id = top.user_id""")
def keep_top_entities(spark, sf):
    out = rk.keep_top_entities(load(spark, sf, "events"), "user_id", F.count_if(F.col("value") > 50), 10, "hits")
    return out.select("user_id", "event_id", "hits")


@query("f04_top_features_by_median", """
WITH m AS (SELECT l_suppkey AS feature, quantile_cont(l_extendedprice, 0.5) AS med FROM lineitem GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10)
SELECT feature, l_orderkey, l_partkey, l_linenumber, round(med, 6) AS median FROM lineitem JOIN m ON l_suppkey = feature""")
def top_features_by_median(spark, sf):
    rows = load(spark, sf, "lineitem").select(F.col("l_suppkey").alias("feature"), "l_orderkey", "l_partkey", "l_linenumber", "l_extendedprice")
    medians = scans.exact_quantiles(rows, ["feature"], "l_extendedprice", {"median": 0.5})
    top = medians.orderBy(F.desc("median"), "feature").limit(10).select("feature", F.round("median", 6).alias("median"))
    return rows.drop("l_extendedprice").join(F.broadcast(top), "feature")  # ten rows


@query("f05_top_mean_importance", """
SELECT l_partkey AS feature, round(CAST(sum(CAST(l_quantity AS BIGINT)) AS DOUBLE) / count(*), 6) AS importance FROM lineitem GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 30""")
def top_mean_importance(spark, sf):
    means = load(spark, sf, "lineitem").groupBy(F.col("l_partkey").alias("feature")).agg(
        F.round(F.sum(F.col("l_quantity").cast("bigint")).cast("double") / F.count("*"), 6).alias("importance")
    )
    return means.orderBy(F.desc("importance"), "feature").limit(30)


@query("f06_threshold_for_precision", f"""WITH {s.SCORED_CTE}, {CURVE_CTE}, want AS (SELECT unnest([0.2, 0.3, 0.4, 0.9])::DOUBLE AS target)
SELECT false AS sentinel, target AS precision_target, max(threshold) AS threshold, round(arg_max(precision, threshold), 6) AS precision, arg_max(tp, threshold) AS tp FROM want JOIN pr ON precision >= target GROUP BY 2
UNION ALL SELECT true, target, (SELECT max(threshold) + 1 FROM pr), 1.0, 0 FROM want""")
def threshold_for_precision(spark, sf):
    curve = curves.precision_recall(s.scored(spark, sf), "risk", "flagged")
    out = None
    for sentinel in (False, True):
        got = rk.thresholds_for_precision(curve, [0.2, 0.3, 0.4, 0.9], include_sentinel=sentinel)
        part = got.select(F.lit(sentinel).alias("sentinel"), "precision_target", "threshold", F.round("precision", 6).alias("precision"), "tp")
        out = part if out is None else out.unionByName(part)
    return out


@query("f07_first_row_per_day", """
SELECT CAST(day AS VARCHAR) AS day, l_orderkey, l_partkey FROM (SELECT CAST(l_shipdate AS DATE) AS day, l_orderkey, l_partkey,
  row_number() OVER (PARTITION BY CAST(l_shipdate AS DATE) ORDER BY l_orderkey, l_partkey, l_linenumber) AS r FROM lineitem) WHERE r = 1""")
def first_row_per_day(spark, sf):
    df = load(spark, sf, "lineitem").select(F.to_date("l_shipdate").cast("string").alias("day"), "l_orderkey", "l_partkey", "l_linenumber")
    return ag.first_by(df, ["day"], ["l_orderkey", "l_partkey", "l_linenumber"], ["day", "l_orderkey", "l_partkey"])
