"""Sources and sinks. Files are written from the given tables into the shared folder and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskloom.functions import records as rec
from riskloom.operators import text_features as tf
from riskloom.queries.q_h_functions import advisory_json
from riskloom.queries.registry import query
from riskloom.session import load, scratch_path
from riskloom.sources import readers as rd
from riskloom.sources import writers as wr


def in_order_of_keys(df, *keys):
    """Rows of one output folder together, so a partitioned write makes few files per folder.

    A rebalance and not a repartition: a folder that holds a third of the rows is split.
    """
    return df.hint("rebalance", *keys)


@query("a01_csv_scan", """
SELECT o_orderkey, o_orderpriority, CASE WHEN o_orderkey % 10 > 0 THEN o_totalprice END AS o_totalprice FROM orders""")
def csv_scan(spark, sf):
    path = scratch_path(spark, "csv")
    price = F.when(F.col("o_orderkey") % 10 == 0, "NaN").otherwise(F.col("o_totalprice").cast("string"))
    df = load(spark, sf, "orders").select("o_orderkey", "o_orderpriority", price.alias("o_totalprice"))
    wr.write_csv(df, path, ["o_orderkey", "o_orderpriority", "o_totalprice"])
    got = rd.read_csv(spark, path, "o_orderkey bigint, o_orderpriority string, o_totalprice double")
    nothing = rd.read_csv(spark, path + "-absent", "o_orderkey bigint, o_orderpriority string, o_totalprice double")
    return got.unionByName(nothing)


@query("a02_entity_from_path", """SELECT o_orderpriority AS project, count(*) AS n, max(o_orderkey) AS newest FROM orders GROUP BY 1""")
def entity_from_path(spark, sf):
    path = scratch_path(spark, "by-project")
    df = load(spark, sf, "orders").select("o_orderkey", F.col("o_orderpriority").alias("project"))
    wr.write_csv(df, path, ["o_orderkey"], partition_by=["project"])
    got = rd.read_csv(spark, path, "o_orderkey bigint", recursive=True, project=rd.path_part("project"))
    return got.groupBy("project").agg(F.count("*").alias("n"), F.max("o_orderkey").alias("newest"))


@query("a03_preferred_file", """SELECT o_orderpriority AS project, count(*) AS n FROM orders WHERE o_orderstatus = 'F' GROUP BY 1""")
def preferred_file(spark, sf):
    # three candidates per project: the flat one of status F is the shallowest
    path = scratch_path(spark, "candidates")
    df = load(spark, sf, "orders").select("o_orderkey", F.col("o_orderpriority").alias("project"), F.col("o_orderstatus").alias("model"))
    flat = in_order_of_keys(df.filter("model = 'F'"), "project")
    wr.write_csv(flat.drop("model"), f"{path}/flat", ["o_orderkey"], partition_by=["project"])
    wr.write_csv(in_order_of_keys(df.filter("model <> 'F'"), "project", "model"), f"{path}/deep", ["o_orderkey"], partition_by=["project", "model"])
    entity = F.url_decode(F.regexp_extract("path", r"/project=([^/]+)/", 1))
    chosen = rd.preferred_files(rd.list_files(spark, path, "*.csv"), entity)
    rows = rd.read_csv(spark, path, "o_orderkey bigint", recursive=True, project=rd.path_part("project"), file_path=rd.file_path())
    return rd.keep_files(rows, chosen).groupBy("project").agg(F.count("*").alias("n"))


def _coverage_reports(spark, sf):
    """Coverage JSON, one report per order, in folders by status and month; two envelopes."""
    path = scratch_path(spark, "coverage")
    summary = F.struct(
        F.struct(F.col("q").alias("count"), F.col("l_linenumber").cast("bigint").alias("covered"), F.lit(50.0).alias("percent")).alias("lines")
    )
    lines = load(spark, sf, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber", F.col("l_quantity").cast("bigint").alias("q"))
    # an order holds a handful of lines, so a report stays small
    files = lines.groupBy("l_orderkey").agg(
        F.collect_list(F.struct(F.concat(F.lit("/src/f"), "l_partkey", F.lit(".c")).alias("filename"), summary.alias("summary"))).alias("files"),
        F.sum("q").alias("q"), F.sum("l_linenumber").alias("l_linenumber"),
    )
    block = F.struct("files", summary.alias("totals"))
    wrapped = F.to_json(F.struct(F.array(block).alias("data")))
    orders = load(spark, sf, "orders").select(
        F.col("o_orderkey").alias("l_orderkey"), F.col("o_orderstatus").alias("project"), F.date_format(F.date_trunc("month", "o_orderdate"), "yyyyMMdd").alias("day")
    )
    docs = files.join(orders, "l_orderkey").select(
        F.when(F.col("l_orderkey") % 2 == 0, wrapped).otherwise(F.to_json(block)).alias("value"), "project", "day"
    )
    wr.write_json(in_order_of_keys(docs, "project", "day"), path, "value", ["project", "day"])
    return path


@query("a04_coverage_scan", """
SELECT o_orderstatus AS project, strftime(date_trunc('month', o_orderdate), '%Y%m%d') AS date, 'f' || l_partkey || '.c' AS filename,
  CAST(l_quantity AS BIGINT) AS lines_count, CAST(l_linenumber AS BIGINT) AS lines_covered FROM lineitem JOIN orders ON l_orderkey = o_orderkey""")
def coverage_scan(spark, sf):
    reports = rd.read_coverage(spark, _coverage_reports(spark, sf), multi_line=False)
    rows = reports.select("project", "date", F.explode("files").alias("f")).select("project", "date", "f.filename", "f.summary")
    flat = rows.select("project", "date", F.replace("filename", F.lit("/src/"), F.lit("")).alias("filename"), *rec.coverage_columns("summary"))
    return flat.select("project", "date", "filename", "lines_count", "lines_covered")


@query("a05_advisory_scan", """
SELECT 'A-' || o_orderkey AS id, strftime(o_orderdate, '%Y-%m-%dT00:00:00Z') AS published, 'p' || (o_orderkey % 25) AS package, 2 AS refs FROM orders""")
def advisory_scan(spark, sf):
    path = scratch_path(spark, "advisories")
    wr.write_json(advisory_json(spark, sf), path, "raw")
    got = rd.read_advisories(spark, path, multi_line=False)
    return got.select("id", "published", F.col("affected")[0]["package"]["name"].alias("package"), F.size("references").alias("refs"))


def source_maps(spark, sf):
    """Source maps as JSON, one map per order, in folders by status and month."""
    path = scratch_path(spark, "srcmap")
    lines = load(spark, sf, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey").distinct()
    info = F.struct(
        F.lit("git").alias("type"),
        F.when(F.col("l_partkey") % 9 != 0, F.concat(F.lit("https://host.org/own/lib"), "l_partkey", F.lit(".git"))).alias("url"),
        F.concat(F.lit("r"), "l_suppkey").alias("rev"),
    )
    entry = F.struct(F.concat(F.lit("/src/lib"), "l_partkey", F.lit("-"), "l_suppkey"), info)
    maps = lines.groupBy("l_orderkey").agg(F.to_json(F.map_from_entries(F.collect_list(entry))).alias("value"))
    orders = load(spark, sf, "orders").select(
        F.col("o_orderkey").alias("l_orderkey"), F.col("o_orderstatus").alias("project"), F.date_format(F.date_trunc("month", "o_orderdate"), "yyyyMMdd").alias("day")
    )
    wr.write_json(in_order_of_keys(maps.join(orders, "l_orderkey"), "project", "day"), path, "value", ["project", "day"])
    return path


SRCMAP_CTE = """
srcmap AS (SELECT project, date, repo_name, url, revision FROM (
  SELECT DISTINCT l_orderkey, o_orderstatus AS project, strftime(date_trunc('month', o_orderdate), '%Y%m%d') AS date, 'lib' || l_partkey || '-' || l_suppkey AS repo_name,
    'https://host.org/own/lib' || l_partkey || '.git' AS url, 'r' || l_suppkey AS revision FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_partkey % 9 <> 0))"""


@query("a06_source_map_scan", f"WITH {SRCMAP_CTE} SELECT * FROM srcmap")
def source_map_scan(spark, sf):
    return rd.read_source_maps(spark, source_maps(spark, sf), whole_files=False)


def experiments(spark, sf):
    """Experiment metrics as JSON and importances as CSV per model and project."""
    path = scratch_path(spark, "experiments")
    base = load(spark, sf, "customer").select(
        F.col("c_mktsegment").alias("model"), F.concat(F.lit("p"), "c_nationkey").alias("project"), F.lit("exp4").alias("experiment"), "c_custkey", "c_acctbal"
    )
    keys = ["model", "project", "experiment"]
    metrics = base.groupBy(*keys).agg(F.count("*").alias("n"), F.count_if(F.col("c_acctbal") > 0).alias("k"))
    share = F.round(F.col("k") / F.col("n"), 4)
    class1 = F.struct(share.alias("precision"), F.lit(0.5).alias("recall"), F.when(F.col("n") % 5 != 0, share / 2).alias("mcc"))
    docs = metrics.select(F.to_json(F.struct(share.alias("mcc"), F.struct(class1.alias("class_1")).alias("classification_report_dict"))).alias("value"), *keys)
    wr.write_json(docs, f"{path}/metrics", "value", keys)
    features = base.groupBy(*keys, F.concat(F.lit("f"), F.col("c_custkey") % 10).alias("feature")).agg(
        F.sum(F.col("c_acctbal").cast("decimal(12,2)")).cast("double").alias("importance")
    )
    wr.write_csv(in_order_of_keys(features, *keys), f"{path}/importances", ["feature", "importance"], partition_by=keys)
    return path


@query("a07_experiment_scan", """
WITH m AS (SELECT c_mktsegment AS model, 'p' || c_nationkey AS project, count(*) AS n, round(CAST(count(*) FILTER (WHERE c_acctbal > 0) AS DOUBLE) / count(*), 4) AS share FROM customer GROUP BY ALL),
f AS (SELECT c_mktsegment AS model, 'p' || c_nationkey AS project, 'f' || (c_custkey % 10) AS feature, greatest(CAST(sum(CAST(c_acctbal AS DECIMAL(12,2))) AS DOUBLE), 0) AS importance FROM customer GROUP BY ALL)
SELECT m.model, m.project, feature, importance, share AS precision, CASE WHEN n % 5 <> 0 THEN share / 2 END AS mcc FROM m JOIN f ON m.model = f.model AND m.project = f.project""")
def experiment_scan(spark, sf):
    path = experiments(spark, sf)
    metrics = rd.read_experiment_metrics(spark, f"{path}/metrics", multi_line=False)
    importances = rd.read_importances(spark, f"{path}/importances")
    return metrics.join(importances, ["model", "project"]).select("model", "project", "feature", "importance", "precision", "mcc")


@query("a08_config_scan", """
SELECT 'p' || c_nationkey AS project, CASE c_nationkey % 3 WHEN 0 THEN 'c' WHEN 1 THEN 'c++' END AS language, 'https://host.org/n' || c_nationkey AS main_repo,
  CAST(count(*) AS VARCHAR) AS builds_per_day, CASE c_nationkey % 3 WHEN 2 THEN 'language' ELSE '' END AS missing FROM customer GROUP BY c_nationkey""")
def config_scan(spark, sf):
    path = scratch_path(spark, "configs")
    per = load(spark, sf, "customer").groupBy("c_nationkey").agg(F.count("*").alias("n"))
    k = F.col("c_nationkey")
    language = F.when(k % 3 == 0, "language: c # plain\nlanguage: rust\n").when(k % 3 == 1, "language: 'c++'\n").otherwise("# language: go\n")
    text = F.concat(F.lit("homepage: x\n"), language, F.lit('main_repo: "https://host.org/n'), k, F.lit('"\nno colon here\nbuilds_per_day: '), "n")
    docs = per.select(text.alias("value"), F.concat(F.lit("p"), k).alias("project"))
    in_order_of_keys(docs, "project").write.partitionBy("project").option("lineSep", "\n").text(path)
    return rd.read_configs(spark, path, ["language", "main_repo"], ["builds_per_day"]).select("project", "language", "main_repo", "builds_per_day", "missing")


@query("a09_key_list_scan", """SELECT 'k' || c_custkey AS key FROM customer UNION ALL SELECT 'n' || c_nationkey FROM customer WHERE c_custkey % 2 = 0""")
def key_list_scan(spark, sf):
    path = scratch_path(spark, "keys")
    k, n = F.concat(F.lit("k"), "c_custkey"), F.concat(F.lit("n"), "c_nationkey")
    line = F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit(" "), k, F.lit(", "), n, F.lit(",, "))).otherwise(k)
    load(spark, sf, "customer").select(line.alias("value")).write.text(path)
    return rd.read_key_list(spark, path)


@query("a10_mapping_scan", """
SELECT 'json' AS kind, 'b' || p_partkey AS key, p_name AS value FROM part WHERE p_partkey % 2 = 0
UNION ALL SELECT 'csv', 'b' || p_partkey, p_brand FROM part WHERE p_partkey % 3 <> 0""")
def mapping_scan(spark, sf):
    part, path = load(spark, sf, "part"), scratch_path(spark, "mapping")
    key = F.concat(F.lit("b"), "p_partkey")
    doc = F.to_json(F.create_map(F.concat(F.lit(" "), key), F.concat("p_name", F.lit(" "))))
    part.filter("p_partkey % 2 = 0").select(doc.alias("value")).write.text(f"{path}/json")
    part.select(key.alias("key"), F.when(F.col("p_partkey") % 3 != 0, F.col("p_brand")).alias("value")).write.csv(f"{path}/csv")
    got_json = rd.read_mapping(spark, f"{path}/json", "json", whole_files=False).select(F.lit("json").alias("kind"), "key", "value")
    got_csv = rd.read_mapping(spark, f"{path}/csv", "csv").select(F.lit("csv").alias("kind"), "key", "value")
    return got_json.unionByName(got_csv)


@query("a11_object_paths", """
SELECT l_orderkey, l_partkey, l_linenumber, 'p' || (l_suppkey % 25) AS project, strftime(l_shipdate, '%Y-%m-%d') AS day,
  CASE l_linenumber % 3 WHEN 0 THEN 't' || l_partkey ELSE 'no_target' END AS target FROM lineitem
WHERE l_linenumber % 3 < 2 AND l_shipdate BETWEEN DATE '1996-01-01' AND DATE '1998-12-31' AND l_linenumber <> 6""")
def object_paths(spark, sf):
    n = F.col("l_linenumber")
    head = F.concat(F.lit("p"), F.col("l_suppkey") % 25, F.lit("/reports/"), F.date_format("l_shipdate", "yyyyMMdd"))
    path = (
        F.when(n == 6, F.concat(head, F.lit("/linux/style.css")))
        .when(n % 3 == 0, F.concat(head, F.lit("/t"), "l_partkey", F.lit("/linux/summary.json")))
        .when(n % 3 == 1, F.concat(head, F.lit("/linux/summary.json")))
        .otherwise(F.concat(F.lit("p/reports/latest/linux/summary.json")))
    )
    df = load(spark, sf, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber", path.alias("path"))
    bounds = [F.lit(d).cast("date") for d in ("1996-01-01", "1998-12-31")]
    out = rd.parse_object_paths(df, "path", ["summary.json", "summary.json.gz"], *bounds)
    return out.select("l_orderkey", "l_partkey", "l_linenumber", "project", F.col("day").cast("string").alias("day"), "target")


@query("a12_request_grid", """
SELECT s_suppkey, CAST(CAST(d AS DATE) AS VARCHAR) AS day FROM supplier, unnest(generate_series(DATE '2024-01-01', DATE '2024-01-31', INTERVAL 1 DAY)) AS g(d)""")
def request_grid(spark, sf):
    keys = load(spark, sf, "supplier").select("s_suppkey")
    grid = rd.request_grid(keys, F.lit("2024-01-01").cast("date"), F.lit("2024-01-31").cast("date"))
    return grid.withColumn("day", F.col("day").cast("string"))


DOC_LINES_CTE = """
doc_lines AS (SELECT doc_id, i AS line_no, line FROM (SELECT doc_id, string_split(text, chr(10)) AS a FROM documents), unnest(a) WITH ORDINALITY AS u(line, i))"""


def report_pages(spark, sf):
    """Coverage pages whose code rows are the lines of the documents; every seventh row comes twice."""
    # one page per document: rows are built from the array of its own lines
    escaped = F.col("text")
    for char, entity in [("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")]:
        escaped = F.replace(escaped, F.lit(char), F.lit(entity))

    def row(line, i):
        no = (i + 1).cast("string")
        count = F.when((i + 1) % 4 == 0, F.lit("")).when((i + 1) % 4 == 1, F.lit("1.5k")).when((i + 1) % 4 == 2, F.lit("2M")).otherwise(F.lit("0"))
        css = F.when((i + 1) % 4 == 3, "uncovered-line").otherwise("covered-line")
        tr = F.concat(
            F.lit("<tr><td class='line-number'><a name='L"), no, F.lit("'><pre>"), no, F.lit("</pre></a></td><td class='"), css, F.lit("'><pre>"), count,
            F.lit("</pre></td><td class='code'><pre>"), line, F.lit("</pre></td></tr>"),
        )
        again = F.concat(F.lit("<tr><td class='line-number'>"), no, F.lit("</td><td class='code'><pre>other</pre></td></tr>"))
        return F.when((i + 1) % 7 == 0, F.concat(tr, again)).otherwise(tr)

    html = F.concat(F.lit("<html><table><tr><td>head</td></tr>"), F.array_join(F.transform(F.split(escaped, "\n"), row), ""), F.lit("</table></html>"))
    return load(spark, sf, "documents").select("doc_id", html.alias("html"))


_SPACES = "regexp_replace(line, '^\\s+|\\s+$', '', 'g')"


@query("a13_report_lines", f"""WITH {DOC_LINES_CTE}
SELECT doc_id, line_no, {_SPACES} AS content, CAST(CASE line_no % 4 WHEN 1 THEN 1500 WHEN 2 THEN 2000000 WHEN 3 THEN 0 END AS BIGINT) AS execute FROM doc_lines""")
def report_lines(spark, sf):
    return rd.report_lines(report_pages(spark, sf), ["doc_id"], "html")


@query("a14_csv_sink", """SELECT c_mktsegment AS segment, n, round(total / 7, 3) AS share FROM (
  SELECT c_mktsegment, count(*) AS n, CAST(sum(CAST(c_acctbal AS DECIMAL(12,2))) AS DOUBLE) AS total FROM customer GROUP BY 1)""")
def csv_sink(spark, sf):
    path = scratch_path(spark, "sink")
    df = load(spark, sf, "customer").groupBy(F.col("c_mktsegment").alias("segment")).agg(
        (F.sum(F.col("c_acctbal").cast("decimal(12,2)")).cast("double") / 7).alias("share"), F.count("*").alias("n")
    )
    wr.write_csv(df, path, ["segment", "n", "share"], {"share": 3})
    return rd.read_csv(spark, path, "segment string, n bigint, share double")


@query("a15_append_sink", """SELECT o_orderstatus AS status, count(*) AS n FROM orders GROUP BY 1""")
def append_sink(spark, sf):
    path = scratch_path(spark, "append")
    df = load(spark, sf, "orders").select("o_orderkey", F.col("o_orderstatus").alias("status"))
    for part in (0, 1):
        wr.append_rows(df.filter(F.col("o_orderkey") % 2 == part), path, "status")
    got = spark.read.schema("o_orderkey bigint, status string").parquet(path)
    return got.groupBy("status").agg(F.count("*").alias("n"))


@query("a16_json_sink", """SELECT c_custkey, CASE WHEN c_custkey % 4 > 1 THEN c_acctbal END AS balance, c_nationkey AS nation FROM customer""")
def json_sink(spark, sf):
    path = scratch_path(spark, "json")
    k = F.col("c_custkey") % 4
    value = F.when(k == 0, float("nan")).when(k == 1, float("inf")).otherwise(F.col("c_acctbal"))
    doc = wr.json_safe({"c_custkey": F.col("c_custkey").cast("double"), "balance": value, "nation": F.col("c_nationkey").cast("double")})
    wr.write_json(load(spark, sf, "customer").select(doc.alias("doc")), path, "doc")
    got = spark.read.schema("c_custkey double, balance double, nation double").json(path)
    return got.select(F.col("c_custkey").cast("bigint").alias("c_custkey"), "balance", F.col("nation").cast("int").alias("nation"))


@query("a17_incremental_run", """SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'first' ELSE 'second' END AS run FROM orders""")
def incremental_run(spark, sf):
    path = scratch_path(spark, "incremental")
    df = load(spark, sf, "orders").select("o_orderkey")
    df.filter("o_orderkey % 3 = 0").withColumn("run", F.lit("first")).write.parquet(path)
    return wr.extend_table(spark, df.withColumn("run", F.lit("second")), path, ["o_orderkey"])


@query("a18_refresh_labels", """
WITH w AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(lower(text), '[a-z]{2,}')) AS word, quality FROM documents JOIN labels USING (doc_id)),
top AS (SELECT word FROM (SELECT unnest(regexp_extract_all(lower(text), '[a-z]{2,}')) AS word FROM documents JOIN labels USING (doc_id)) GROUP BY 1 ORDER BY count(*) DESC, word LIMIT 3)
SELECT l.doc_id, l.quality AS label, CAST(count(w.word) AS BIGINT) AS top_words FROM labels l JOIN documents USING (doc_id) LEFT JOIN w ON w.doc_id = l.doc_id AND w.word IN (SELECT word FROM top) GROUP BY ALL""")
def refresh_labels(spark, sf):
    path = scratch_path(spark, "labelled")
    docs = load(spark, sf, "documents").join(load(spark, sf, "labels"), "doc_id")
    old = docs.select("doc_id", "text", F.col("toxic").alias("label"), F.lit(0).alias("w1"), F.lit(0).alias("w2"))
    old.write.parquet(path)
    labels = load(spark, sf, "labels").select("doc_id", F.col("quality").alias("label"))
    stored = spark.read.schema(old.schema).parquet(path)
    fresh = tf.relabel(stored, labels, "doc_id", "label", derived=r"^w\d+$")
    out = f"{path}-new"
    tf.add_tfidf(fresh, "doc_id", "text", k=3, stop_words=(), pattern=r"[a-z]{2,}").write.parquet(out)
    got = spark.read.parquet(out)
    present = sum((F.col(f"w{i}") > 0).cast("bigint") for i in (1, 2, 3))
    return got.select("doc_id", "label", present.alias("top_words"))
