"""Set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskloom.functions import text as tx
from riskloom.operators import sets as st
from riskloom.queries import standins as s
from riskloom.queries.registry import query
from riskloom.session import load


@query("g01_union_by_name", """
SELECT c_custkey AS id, c_acctbal AS balance, c_mktsegment AS segment, NULL::VARCHAR AS supplier FROM customer
UNION ALL SELECT s_suppkey, s_acctbal, NULL, s_name FROM supplier""")
def union_by_name(spark, sf):
    a = load(spark, sf, "customer").selectExpr("c_custkey AS id", "c_acctbal AS balance", "c_mktsegment AS segment")
    b = load(spark, sf, "supplier").selectExpr("s_name AS supplier", "s_acctbal AS balance", "s_suppkey AS id")
    return st.union_all([a, b])


@query("g02_common_entities", """
SELECT user_id FROM events GROUP BY 1 HAVING count(DISTINCT event_type || (event_id % 4)) = (SELECT count(DISTINCT event_type || (event_id % 4)) FROM events)""")
def common_entities(spark, sf):
    df = load(spark, sf, "events").select("user_id", F.col("event_type").alias("model"), (F.col("event_id") % 4).alias("experiment"))
    return st.common_entities(df, "user_id", ["model", "experiment"])


@query("g03_dedupe_list", """
SELECT doc_id, array_to_string(list_transform(list_filter(list_zip(w, range(1, len(w) + 1)), lambda x: list_position(w, x[1]) = x[2]), lambda x: x[1]), ' ') AS words, len(list_distinct(w)) AS n
FROM (SELECT doc_id, string_split(text, ' ') AS w FROM documents)""")
def dedupe_list(spark, sf):
    words = tx.dedupe_keep_order(F.split("text", " "))
    return load(spark, sf, "documents").select("doc_id", F.concat_ws(" ", words).alias("words"), F.size(words).cast("bigint").alias("n"))


@query("g04_merge_relabelled", """
SELECT o_orderstatus AS strategy, o_orderkey AS id, o_totalprice AS cost FROM orders WHERE o_orderstatus <> 'P'
UNION ALL SELECT 'S5', o_orderkey, o_totalprice / 2 FROM orders WHERE o_orderstatus = 'P'""")
def merge_relabelled(spark, sf):
    df = load(spark, sf, "orders")
    base = df.filter("o_orderstatus <> 'P'").selectExpr("o_orderstatus AS strategy", "o_orderkey AS id", "o_totalprice AS cost")
    extra = df.selectExpr("o_orderstatus AS strategy", "o_orderkey AS id", "o_totalprice / 2 AS multi_cost")
    return st.merge_relabelled(base, extra, F.col("strategy") == "P", {"multi_cost": "cost"}, {"P": "S5"}, "strategy")


@query("g05_merge_new_rows", """
SELECT id, CASE WHEN id % 3 = 0 THEN 'old' ELSE 'new' END AS source FROM (SELECT o_orderkey AS id FROM orders)""")
def merge_new_rows(spark, sf):
    df = load(spark, sf, "orders").select(F.col("o_orderkey").alias("id"))
    return st.merge_new_rows(df.filter("id % 3 = 0").withColumn("source", F.lit("old")), df.withColumn("source", F.lit("new")), ["id"], ["source"])


@query("g06_distinct_entities", """
SELECT CAST(c_nationkey AS VARCHAR) AS project FROM customer UNION SELECT CAST(s_nationkey AS VARCHAR) FROM supplier UNION SELECT o_orderpriority FROM orders""")
def distinct_entities(spark, sf):
    return st.distinct_entities(
        [(load(spark, sf, "customer"), "c_nationkey"), (load(spark, sf, "supplier"), "s_nationkey"), (load(spark, sf, "orders"), "o_orderpriority")]
    )


@query("g07_canonical_rows", f"""WITH {s.DETECTIONS_CTE}, {s.RATES_CTE}
SELECT project, count(*) FILTER (WHERE part_no IN (SELECT p_partkey FROM part WHERE p_type = 'ECONOMY')) AS kept, count(*) AS original FROM detections GROUP BY 1""")
def canonical_rows(spark, sf):
    canonical = load(spark, sf, "part").filter("p_type = 'ECONOMY'").select(F.col("p_partkey").alias("part_no"))
    return st.canonical_rows(s.detections(spark, sf), canonical, ["part_no"], "project")[1]
