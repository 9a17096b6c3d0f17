"""Scalar functions over text, dates, numbers, arrays, maps and JSON."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskloom.functions import numeric as nm
from riskloom.functions import records as rec
from riskloom.functions import text as tx
from riskloom.queries import standins as s
from riskloom.queries.registry import query
from riskloom.session import load

_URLS_SQL = """
repos AS (
  SELECT p_partkey AS id, CASE p_partkey % 6
    WHEN 0 THEN 'https://Host.org/Own' || (p_partkey % 7) || '/Lib' || p_size || '.git'
    WHEN 1 THEN ' http://host.org/Own' || (p_partkey % 7) || '/lib' || p_size || '/ '
    WHEN 2 THEN 'git://host.org/own' || (p_partkey % 7) || '/lib' || p_size || '.GIT'
    WHEN 3 THEN 'git@host.org:own' || (p_partkey % 7) || '/lib' || p_size || '.git'
    WHEN 4 THEN 'https://host.org/group/own' || (p_partkey % 7) || '/lib' || p_size || '//'
    ELSE 'https://host.org/solo' || p_size END AS url FROM part)"""


def repos(spark, sf):
    k = F.col("p_partkey")
    o, z = (k % 7).cast("string"), F.col("p_size").cast("string")
    url = (
        F.when(k % 6 == 0, F.concat(F.lit("https://Host.org/Own"), o, F.lit("/Lib"), z, F.lit(".git")))
        .when(k % 6 == 1, F.concat(F.lit(" http://host.org/Own"), o, F.lit("/lib"), z, F.lit("/ ")))
        .when(k % 6 == 2, F.concat(F.lit("git://host.org/own"), o, F.lit("/lib"), z, F.lit(".GIT")))
        .when(k % 6 == 3, F.concat(F.lit("git@host.org:own"), o, F.lit("/lib"), z, F.lit(".git")))
        .when(k % 6 == 4, F.concat(F.lit("https://host.org/group/own"), o, F.lit("/lib"), z, F.lit("//")))
        .otherwise(F.concat(F.lit("https://host.org/solo"), z))
    )
    return load(spark, sf, "part").select(k.alias("id"), url.alias("url"))


_KEEP_CASE = "regexp_replace(rtrim(trim(url), '/'), '\\.git$', '', 'i')"
_HTTPS = "regexp_replace(regexp_replace(trim(url), '^git@([^:/]+):', 'https://\\1/'), '^(git|http|ssh)://', 'https://')"


@query("h01_repo_key", f"WITH {_URLS_SQL} SELECT id, {_KEEP_CASE} AS case_kept, lower({_KEEP_CASE}) AS lowered FROM repos")
def repo_key(spark, sf):
    return repos(spark, sf).select("id", tx.repo_key("url", lower=False).alias("case_kept"), tx.repo_key("url").alias("lowered"))


@query("h02_https_url", f"WITH {_URLS_SQL} SELECT id, {_HTTPS} AS url FROM repos")
def https_url(spark, sf):
    return repos(spark, sf).select("id", tx.https_url("url").alias("url"))


@query("h03_owner_and_name", f"""WITH {_URLS_SQL}
SELECT id, CASE id % 6 WHEN 5 THEN '' ELSE 'own' || (id % 7) || '/lib' || p_size END AS owner_and_name,
  CASE id % 6 WHEN 0 THEN 'Lib' || p_size WHEN 5 THEN 'solo' || p_size ELSE 'lib' || p_size END AS repo_name
FROM repos JOIN part ON id = p_partkey""")
def owner_and_name(spark, sf):
    return repos(spark, sf).select("id", tx.owner_and_name("url").alias("owner_and_name"), tx.repo_name("url").alias("repo_name"))


@query("h04_first_of_list", """
SELECT o_orderkey, CASE o_orderkey % 5 WHEN 4 THEN NULL ELSE 'c' || o_orderkey END AS first_commit FROM orders""")
def first_of_list(spark, sf):
    k = F.col("o_orderkey")
    c1, c2 = F.concat(F.lit("c"), k), F.concat(F.lit("c"), k + 1)
    raw = (
        F.when(k % 5 == 0, F.concat(c1, F.lit("; "), c2))
        .when(k % 5 == 1, F.concat(F.lit(" "), c1, F.lit(", "), c2))
        .when(k % 5 == 2, F.concat(c1, F.lit(" "), c2))
        .when(k % 5 == 3, c1)
        .otherwise("--")
    )
    return load(spark, sf, "orders").select("o_orderkey", tx.first_of_list(raw).alias("first_commit"))


@query("h05_stable_id", """
SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN 'm' || o_orderkey WHEN o_orderkey % 4 = 1 THEN 's' || o_orderkey
  WHEN o_orderkey % 4 = 2 THEN 'introduced:c' || o_custkey ELSE 'row_' || o_orderkey END AS issue FROM orders""")
def stable_id(spark, sf):
    k = F.col("o_orderkey")
    first = F.when(k % 4 == 0, F.concat(F.lit(" m"), k)).otherwise("  ")
    second = F.when(k % 4 == 1, F.concat(F.lit("s"), k))
    introduced = F.when(k % 4 == 2, F.concat(F.lit("c"), "o_custkey")).otherwise("")
    return load(spark, sf, "orders").select("o_orderkey", tx.stable_id([first, second], introduced, k).alias("issue"))


@query("h06_first_positive", """
SELECT c_custkey, CASE WHEN c_custkey % 7 <> 0 AND c_acctbal > 0 THEN c_acctbal WHEN c_nationkey > 0 THEN c_nationkey ELSE 'inf'::DOUBLE END AS threshold
FROM customer""")
def first_positive(spark, sf):
    balance = F.when(F.col("c_custkey") % 7 == 0, "n/a").otherwise(F.col("c_acctbal").cast("string"))
    return load(spark, sf, "customer").select("c_custkey", nm.first_positive([balance, "c_nationkey"]).alias("threshold"))


@query("h07_scaled_duration", f"""WITH {s.DETECTIONS_CTE}, {s.RATES_CTE}
SELECT project, order_no, line_no, part_no, CASE WHEN rate > 0 AND order_no % 5 <> 0 THEN days * rate ELSE CAST(days AS DOUBLE) END AS units
FROM detections LEFT JOIN rates USING (project) WHERE days >= 0 AND line_no <> 7""")
def scaled_duration(spark, sf):
    df = s.detections(spark, sf).join(s.rates(spark, sf), "project", "left")
    days = F.when(F.col("line_no") == 7, "n/a").otherwise(F.col("days").cast("string"))
    rate = F.when(F.col("order_no") % 5 == 0, "unknown").otherwise(F.col("rate").cast("string"))
    units = df.select("project", "order_no", "line_no", "part_no", nm.scaled_duration(days, rate).alias("units"))
    return units.filter("units IS NOT NULL")


@query("h08_whole_days", """
SELECT event_id, CASE WHEN event_id % 9 = 0 THEN NULL ELSE CAST(floor(date_diff('microsecond', TIMESTAMP '2024-01-10 12:00:00', ts) / 86400000000) AS BIGINT) END AS days FROM events""")
def whole_days(spark, sf):
    k, iso = F.col("event_id"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    end = F.when(k % 9 == 0, "n/a").when(k % 2 == 0, iso).otherwise(F.col("ts").cast("string"))
    return load(spark, sf, "events").select("event_id", nm.whole_days_between(F.lit("2024-01-10T21:00:00+09:00"), end).alias("days"))


@query("h09_parse_list", """
SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 'a' || o_orderkey || '.c|b.h' WHEN 1 THEN 'x.c|y' || o_orderkey || '.h'
  ELSE '' END AS files, CASE o_orderkey % 4 WHEN 0 THEN 2 WHEN 1 THEN 2 ELSE 0 END AS n FROM orders""")
def parse_list(spark, sf):
    k = F.col("o_orderkey")
    raw = (
        F.when(k % 4 == 0, F.concat(F.lit("['a"), k, F.lit(".c', 'b.h']")))
        .when(k % 4 == 1, F.concat(F.lit("x.c;y"), k, F.lit(".h")))
        .when(k % 4 == 2, "[broken")
    )
    files = tx.parse_list(raw)
    return load(spark, sf, "orders").select("o_orderkey", F.concat_ws("|", files).alias("files"), F.size(files).alias("n"))


_ADVISORY_SQL = """
advisory AS (
  SELECT o_orderkey AS id, 'https://tracker.org/issues/' || o_custkey AS url,
    o_orderkey % 3 AS kind, 'p' || (o_orderkey % 25) AS package, o_orderpriority AS sev FROM orders)"""


def advisory_json(spark, sf):
    """Nested advisory records as JSON text, one per order."""
    k = F.col("o_orderkey")
    q = lambda x: F.concat(F.lit('"'), x, F.lit('"'))
    url = q(F.concat(F.lit("https://tracker.org/issues/"), "o_custkey"))
    events = F.concat(
        F.lit('[{"introduced":"i'), k, F.lit('"},{"fixed":"f'), k, F.lit('"},{"introduced":"j'), k, F.lit('"}]')
    )
    severity = (
        F.when(k % 3 == 0, F.concat(F.lit('"ecosystem_specific":{"severity":'), q(F.col("o_orderpriority")), F.lit("},")))
        .when(k % 3 == 1, F.concat(F.lit('"database_specific":{"severity":'), q(F.lit("LOW")), F.lit("},")))
        .otherwise("")
    )
    return load(spark, sf, "orders").select(
        F.concat(
            F.lit('{"id":"A-'), k, F.lit('","summary":"s'), k, F.lit('","details":"d",'),
            F.lit('"published":"'), F.date_format("o_orderdate", "yyyy-MM-dd'T'00:00:00'Z'"),
            F.lit('","modified":"'), F.date_format("o_orderdate", "yyyy-MM-dd'T'12:00:00'Z'"),
            F.lit('","references":[{"type":"WEB","url":"https://x.org/1"},{"type":"REPORT","url":'), url, F.lit("}],"),
            F.lit('"affected":[{"package":{"name":"p'), k % 25, F.lit('","ecosystem":"src"},'), severity,
            F.lit('"versions":["1.'), k % 4, F.lit('"],"ranges":[{"type":"SEMVER","events":[{"introduced":"0"}]},'),
            F.lit('{"type":"GIT","repo":"https://host.org/r'), k % 25, F.lit('.git","events":'), events,
            F.lit("}]}]"),
            F.when(k % 3 == 2, ',"severity":[{"type":"V3","score":"7.5"}]').otherwise(""),
            F.lit("}"),
        ).alias("raw")
    )


@query("h10_flatten_advisory", f"""WITH {_ADVISORY_SQL}
SELECT 'A-' || id AS advisory_id, CAST(regexp_extract(url, '(\\d+)$', 1) AS BIGINT) AS issue_id, package, 'src' AS ecosystem,
  'https://host.org/r' || (id % 25) || '.git' AS repo, 'i' || id || ';j' || id AS introduced_commits, 'f' || id AS fixed_commits,
  '1.' || (id % 4) AS versions, CASE kind WHEN 0 THEN sev WHEN 1 THEN 'LOW' ELSE '7.5' END AS severity, url AS report_url
FROM advisory""")
def flatten_advisory(spark, sf):
    parsed = advisory_json(spark, sf).select(F.from_json("raw", rec.ADVISORY_SCHEMA).alias("a"))
    return parsed.select(*rec.advisory_columns("a")).select(
        "advisory_id", "issue_id", "package", "ecosystem", "repo", "introduced_commits", "fixed_commits", "versions", "severity", "report_url"
    )


@query("h11_flatten_coverage", """
SELECT l_orderkey AS id,
  CAST(count(*) AS BIGINT) AS lines_count, CAST(sum(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS BIGINT) AS lines_covered,
  0::DOUBLE AS lines_percent, CAST(max(l_linenumber) AS BIGINT) AS branches_count, 0::BIGINT AS branches_covered, 0::BIGINT AS branches_notcovered, 0::DOUBLE AS branches_percent,
  0::BIGINT AS functions_count, 0::BIGINT AS functions_covered, CAST(max(l_linenumber) * 0.5 AS DOUBLE) AS functions_percent, CAST(min(l_linenumber) AS BIGINT) AS instantiations_count,
  0::BIGINT AS instantiations_covered, 0::DOUBLE AS instantiations_percent, 0::BIGINT AS regions_count, CAST(max(l_partkey) AS BIGINT) AS regions_covered, CAST(min(l_partkey) AS BIGINT) AS regions_notcovered, 0::DOUBLE AS regions_percent
FROM lineitem GROUP BY 1""")
def flatten_coverage(spark, sf):
    rows = load(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(
        F.struct(
            F.struct(
                F.count("*").alias("count"), F.count_if(F.col("l_returnflag") == "R").alias("covered"), F.lit(None).cast("double").alias("percent")
            ).alias("lines"),
            F.struct(F.max("l_linenumber").cast("bigint").alias("count")).alias("branches"),
            F.struct((F.max("l_linenumber") * 0.5).alias("percent")).alias("functions"),
            F.struct(F.min("l_linenumber").cast("bigint").alias("count")).alias("instantiations"),
            F.struct(F.max("l_partkey").alias("covered"), F.min("l_partkey").alias("notcovered")).alias("regions"),
        ).alias("summary")
    )
    summary = F.from_json(F.to_json("summary"), rec.COVERAGE_SUMMARY)
    return rows.select("id", summary.alias("summary")).select("id", *rec.coverage_columns("summary"))


@query("h12_churn_weight", """
SELECT o_orderkey, round(CASE WHEN o_orderkey % 10 > 0 THEN ln(1 + o_totalprice) / ln(1 + (o_orderkey % 10)) ELSE 1 END, 6) AS weight,
  round(CASE WHEN o_orderkey % 10 > 0 THEN least(ln(1 + o_totalprice) / ln(1 + (o_orderkey % 10)), 6) ELSE 1 END, 6) AS capped FROM orders""")
def churn_weight(spark, sf):
    base = F.col("o_orderkey") % 10
    return load(spark, sf, "orders").select(
        "o_orderkey",
        F.round(nm.churn_weight("o_totalprice", base), 6).alias("weight"),
        F.round(nm.churn_weight("o_totalprice", base, 6.0), 6).alias("capped"),
    )


@query("h13_rounding", """
SELECT l_orderkey, l_linenumber, l_partkey, CAST(ceil(l_quantity / 4 - 1e-9) AS BIGINT) AS up, CAST(floor(l_quantity / 4 + 1e-9) AS BIGINT) AS down,
  CAST(round_even(l_quantity / 4, 0) AS BIGINT) AS half_even FROM lineitem""")
def rounding(spark, sf):
    v = F.col("l_quantity") / 4
    return load(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey",
        nm.rounded(v, "ceil").alias("up"), nm.rounded(v, "floor").alias("down"), nm.rounded(v, "round").alias("half_even"),
    )


@query("h14_feature_signature", """
SELECT p_partkey, sha256(p_name || chr(10) || p_brand || chr(10) || p_type || chr(10) || 'age') AS signature FROM part""")
def feature_signature(spark, sf):
    names = ["p_name", "p_brand", "p_type", F.lit("age")]
    return load(spark, sf, "part").select("p_partkey", tx.feature_signature(names).alias("signature"))


@query("h15_keyed_uniform", """
SELECT o_orderkey, CAST(('0x' || substr(md5(o_orderpriority || '::' || o_orderkey || '::42'), 1, 8)) AS BIGINT) / 4294967296.0 * 10 + 5 AS draw FROM orders""")
def keyed_uniform(spark, sf):
    draw = nm.keyed_uniform(42, "o_orderpriority", "o_orderkey") * 10 + 5
    return load(spark, sf, "orders").select("o_orderkey", draw.alias("draw"))


@query("h16_percent", """
SELECT l_orderkey, CASE WHEN sum(CASE WHEN l_linestatus = 'F' THEN 1 ELSE 0 END) > 0
  THEN CAST(sum(CASE WHEN l_linestatus = 'F' AND l_returnflag = 'R' THEN 1 ELSE 0 END) AS DOUBLE) / CAST(sum(CASE WHEN l_linestatus = 'F' THEN 1 ELSE 0 END) AS DOUBLE) * 100.0
  ELSE 0.0 END AS percent FROM lineitem GROUP BY 1""")
def percent(spark, sf):
    open_line = F.col("l_linestatus") == "F"
    per_order = load(spark, sf, "lineitem").groupBy("l_orderkey").agg(
        F.count_if(open_line & (F.col("l_returnflag") == "R")).alias("p"), F.count_if(open_line).alias("w")
    )
    return per_order.select("l_orderkey", nm.percent("p", "w").alias("percent"))


@query("h17_result_formats", """
SELECT o_orderpriority, cost, found, found || ' / ' || total AS found_text,
  round(CASE WHEN rate <= 1 THEN rate * 100 ELSE rate END, 2) AS trigger_rate, round(CASE WHEN found > 0 THEN cost / found END, 2) AS cost_per_hit
FROM (SELECT o_orderpriority, CAST(sum(CAST(o_totalprice AS DECIMAL(14,2))) AS DOUBLE) AS cost,
  CAST(sum(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) AS BIGINT) AS found, count(*) AS total,
  CAST(sum(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) AS DOUBLE) / count(*) AS rate FROM orders GROUP BY 1)""")
def result_formats(spark, sf):
    totals = load(spark, sf, "orders").groupBy("o_orderpriority").agg(
        F.sum(F.col("o_totalprice").cast("decimal(14,2)")).cast("double").alias("cost"),
        F.count_if(F.col("o_orderstatus") == "F").alias("found"),
        F.count("*").alias("total"),
    )
    return totals.select(
        "o_orderpriority", "cost", "found",
        F.concat_ws(" / ", "found", "total").alias("found_text"),
        F.round(nm.as_percentage(F.col("found") / F.col("total")), 2).alias("trigger_rate"),
        F.round(nm.ratio_or_null("cost", "found"), 2).alias("cost_per_hit"),
    )


@query("h18_scope_label", """
SELECT n_regionkey, array_to_string(list_slice(list_sort(list(n_name)), 1, 3), '-') || CASE WHEN count(*) > 3 THEN '-plus' || (count(*) - 3) ELSE '' END AS label,
  regexp_replace('region ' || n_regionkey || ': a/b', '[^A-Za-z0-9._-]+', '_', 'g') AS safe
FROM nation GROUP BY n_regionkey""")
def scope_label(spark, sf):
    # nation holds one row per country, so a region's list is bounded by that
    names = load(spark, sf, "nation").groupBy("n_regionkey").agg(F.collect_list("n_name").alias("names"))
    safe = tx.path_safe(F.concat(F.lit("region "), "n_regionkey", F.lit(": a/b")))
    return names.select("n_regionkey", tx.scope_label("names", 3).alias("label"), safe.alias("safe"))


@query("h19_path_parts", f"""WITH {s.COMMIT_FILES_CTE}
SELECT commit_id, path, split_part(path, '/', 1) AS top, split_part(path, '/', 1) || '/' || split_part(path, '/', 2) AS parent,
  lower('.' || split_part(path, '.', 2)) AS ext FROM commit_files""")
def path_parts(spark, sf):
    return s.commit_files(spark, sf).select(
        "commit_id", "path", tx.top_directory("path").alias("top"), tx.parent_directory("path").alias("parent"), tx.extension("path").alias("ext")
    )


@query("h20_repair_message", """
SELECT doc_id, CASE WHEN regexp_matches(lower(text), 'bug|defect|fix|error|repair|patch|issue|exception') THEN 1 ELSE 0 END AS is_fix FROM documents""")
def repair_message(spark, sf):
    return load(spark, sf, "documents").select("doc_id", tx.is_repair_message("text").alias("is_fix"))
