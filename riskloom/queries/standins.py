"""Risk-analytics tables derived from the star schema, as DataFrames and as SQL twins.

Each ``*_CTE`` text is the body of a WITH entry equal to the function of the same name.
Sums of money columns go through decimals, so both engines add exactly.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.operators import tables as tb
from riskloom.session import load

COMMITS_CTE = """
commits AS (
  SELECT o_orderkey AS commit_id, o_custkey AS author, o_orderpriority AS project,
         CAST(o_orderdate AS DATE) AS day,
         CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS flagged,
         CASE WHEN o_orderkey % 5 = 0 THEN 1 ELSE 0 END AS is_fix
  FROM orders)"""


def commits(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "orders").select(
        F.col("o_orderkey").alias("commit_id"),
        F.col("o_custkey").alias("author"),
        F.col("o_orderpriority").alias("project"),
        F.to_date("o_orderdate").alias("day"),
        F.when(F.col("o_orderstatus") == "F", 1).otherwise(0).alias("flagged"),
        F.when(F.col("o_orderkey") % 5 == 0, 1).otherwise(0).alias("is_fix"),
    )


COMMIT_FILES_CTE = COMMITS_CTE + """,
commit_files AS (
  SELECT c.commit_id, c.author, c.project, c.day, c.flagged, c.is_fix,
         'sub' || (l_partkey % 20) || '/dir' || (l_partkey % 100) || '/f' || l_partkey
           || CASE l_partkey % 4 WHEN 0 THEN '.c' WHEN 1 THEN '.H' WHEN 2 THEN '.cpp' ELSE '.md' END AS path,
         CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS added,
         CAST(sum(l_linenumber) AS BIGINT) AS deleted
  FROM lineitem JOIN commits c ON l_orderkey = c.commit_id
  GROUP BY ALL)"""


def part_path(part_key: str = "l_partkey"):
    p = F.col(part_key)
    ending = F.when(p % 4 == 0, ".c").when(p % 4 == 1, ".H").when(p % 4 == 2, ".cpp").otherwise(".md")
    return F.concat(F.lit("sub"), p % 20, F.lit("/dir"), p % 100, F.lit("/f"), p, ending)


def commit_files(spark: SparkSession, sf: str) -> DataFrame:
    table = load(spark, sf, "lineitem")
    lines = table.select(
        F.col("l_orderkey").alias("commit_id"),
        "l_partkey",
        F.col("l_quantity").cast("bigint").alias("q"),
        "l_linenumber",
    )
    # dealt by commit, so that the join and what is counted per commit need no further shuffle; a part has one path
    per_file = tb.dealt(lines, table.count(), "commit_id").groupBy("commit_id", "l_partkey").agg(
        F.sum("q").alias("added"), F.sum("l_linenumber").cast("bigint").alias("deleted")
    )
    return per_file.join(commits(spark, sf), "commit_id").select(
        "commit_id", "author", "project", "day", "flagged", "is_fix", part_path().alias("path"), "added", "deleted"
    )


SCORED_CTE = """
scored AS (
  SELECT 'p' || s_nationkey AS project, CAST(l_shipdate AS DATE) AS day,
         round(CAST(sum(CAST(l_discount AS DECIMAL(4,2))) AS DOUBLE) / count(*) * 10, 4) AS risk,
         CASE WHEN sum(CASE WHEN l_returnflag = 'R' THEN 2 ELSE 0 END) > count(*) THEN 1 ELSE 0 END AS flagged,
         CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS added,
         CAST(sum(l_linenumber) AS BIGINT) AS deleted,
         count(*) AS commit_count
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey
  GROUP BY ALL)"""


def lines_by_project(spark: SparkSession, sf: str, *columns: str) -> DataFrame:
    """Line rows with their supplier's nation as project."""
    lines = load(spark, sf, "lineitem").select("l_suppkey", *columns)
    owners = load(spark, sf, "supplier").select(
        F.col("s_suppkey").alias("l_suppkey"), F.concat(F.lit("p"), "s_nationkey").alias("project")
    )
    return lines.join(owners, "l_suppkey")


def scored(spark: SparkSession, sf: str) -> DataFrame:
    """One row per project and day: risk score, label, churn and change count."""
    lines = lines_by_project(spark, sf, "l_shipdate", "l_discount", "l_returnflag", "l_quantity", "l_linenumber")
    return (
        lines.groupBy("project", F.to_date("l_shipdate").alias("day"))
        .agg(
            F.sum(F.col("l_discount").cast("decimal(4,2)")).cast("double").alias("d"),
            F.sum(F.when(F.col("l_returnflag") == "R", 2).otherwise(0)).alias("r"),
            F.sum(F.col("l_quantity").cast("bigint")).alias("added"),
            F.sum("l_linenumber").cast("bigint").alias("deleted"),
            F.count("*").alias("commit_count"),
        )
        .select(
            "project",
            "day",
            F.round(F.col("d") / F.col("commit_count") * 10, 4).alias("risk"),
            F.when(F.col("r") > F.col("commit_count"), 1).otherwise(0).alias("flagged"),
            "added",
            "deleted",
            "commit_count",
        )
    )


RATES_CTE = """
rates AS (
  SELECT 'p' || n_nationkey AS project,
         CASE WHEN n_nationkey % 7 = 6 THEN NULL ELSE CAST(n_nationkey % 4 AS DOUBLE) END AS rate
  FROM nation)"""


def rates(spark: SparkSession, sf: str) -> DataFrame:
    """Work units per day and project; null and zero rates occur."""
    key = F.col("n_nationkey")
    return load(spark, sf, "nation").select(
        F.concat(F.lit("p"), key).alias("project"),
        F.when(key % 7 != 6, (key % 4).cast("double")).alias("rate"),
    )


DETECTIONS_CTE = """
detections AS (
  SELECT 'p' || s_nationkey AS project, CAST(o_orderdate AS DATE) AS commit_day,
         date_diff('day', CAST(o_orderdate AS DATE), CAST(l_shipdate AS DATE)) AS days,
         l_orderkey AS order_no, l_linenumber AS line_no, l_partkey AS part_no,
         CASE WHEN l_linenumber % 3 = 0 THEN '' ELSE 'v' || l_orderkey || '-' || l_linenumber END AS issue_id,
         CASE WHEN l_linenumber = 6 THEN ' ' ELSE 'c' || l_orderkey END AS introduced
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey
  WHERE l_returnflag = 'R' AND l_linestatus = 'F')"""


def detections(spark: SparkSession, sf: str) -> DataFrame:
    """Found weaknesses with the days from the change to the report (some negative)."""
    lines = (
        load(spark, sf, "lineitem")
        .filter((F.col("l_returnflag") == "R") & (F.col("l_linestatus") == "F"))
        .select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_shipdate")
    )
    orders = load(spark, sf, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderdate")
    owners = load(spark, sf, "supplier").select(
        F.col("s_suppkey").alias("l_suppkey"), F.concat(F.lit("p"), "s_nationkey").alias("project")
    )
    line_no = F.col("l_linenumber")
    return (
        lines.join(owners, "l_suppkey")
        .join(orders, "l_orderkey")
        .select(
            "project",
            F.to_date("o_orderdate").alias("commit_day"),
            F.datediff(F.to_date("l_shipdate"), F.to_date("o_orderdate")).cast("bigint").alias("days"),
            F.col("l_orderkey").alias("order_no"),
            line_no.alias("line_no"),
            F.col("l_partkey").alias("part_no"),
            F.when(line_no % 3 == 0, "").otherwise(F.concat(F.lit("v"), "l_orderkey", F.lit("-"), line_no)).alias("issue_id"),
            F.when(line_no == 6, " ").otherwise(F.concat(F.lit("c"), "l_orderkey")).alias("introduced"),
        )
    )


ACTIVITY_CTE = """
activity AS (
  SELECT event_type AS project, CAST(ts AS DATE) AS day, count(*) AS commit_count,
         CAST(sum(CAST(value AS DECIMAL(12,2))) AS DOUBLE) AS amount
  FROM events GROUP BY ALL)"""


def activity(spark: SparkSession, sf: str) -> DataFrame:
    """Dense daily series: events per type and day."""
    return (
        load(spark, sf, "events")
        .groupBy(F.col("event_type").alias("project"), F.to_date("ts").alias("day"))
        .agg(F.count("*").alias("commit_count"), F.sum(F.col("value").cast("decimal(12,2)")).cast("double").alias("amount"))
    )


USER_DAYS_CTE = """
user_days AS (
  SELECT user_id, CAST(ts AS DATE) AS day, count(*) AS n,
         CAST(sum(CAST(value AS DECIMAL(12,2))) AS DOUBLE) AS amount
  FROM events GROUP BY ALL)"""


def user_days(spark: SparkSession, sf: str) -> DataFrame:
    """Sparse daily series: events per user and day."""
    return (
        load(spark, sf, "events")
        .groupBy("user_id", F.to_date("ts").alias("day"))
        .agg(F.count("*").alias("n"), F.sum(F.col("value").cast("decimal(12,2)")).cast("double").alias("amount"))
    )
