"""Cleaning, filters and predicates."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskloom.functions import clean as c
from riskloom.operators import tables as tb
from riskloom.queries import standins as s
from riskloom.queries.registry import query
from riskloom.session import load

# what stands behind the day of an order, by the key modulo 10, and the time it means in UTC
_TAILS = {3: (" 00:00:00", "00:00:00"), 5: ("T03:04:37.331327Z", "03:04:37.331327"), 6: (" 10:00:00+09:00", "01:00:00"), 7: ("T10:00:00", "10:00:00"), 8: ("T10:00:00+0900", "01:00:00")}


def mixed_times(key, day):
    """Times as feeds write them: days of three shapes, fractions, zones with and without colon."""
    raw = F.when(key % 10 == 0, F.date_format(day, "yyyy-MM-dd")).when(key % 10 == 1, F.date_format(day, "yyyyMMdd")).when(key % 10 == 2, F.date_format(day, "yyyy/MM/dd"))
    raw = raw.when(key % 10 == 4, F.concat(F.lit(" "), F.date_format(day, "yyyy-MM-dd"), F.lit(" ")))
    for k, (tail, _) in _TAILS.items():
        raw = raw.when(key % 10 == k, F.concat(F.date_format(day, "yyyy-MM-dd"), F.lit(tail)))
    return raw.otherwise("n/a")


_MIXED_SQL = f"""mixed AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 10 = 9 THEN NULL ELSE CAST(o_orderdate AS TIMESTAMP) + CASE o_orderkey % 10
  {" ".join(f"WHEN {k} THEN INTERVAL '{t}'" for k, (_, t) in _TAILS.items())} ELSE INTERVAL '0 seconds' END END AS ts FROM orders)"""


def _mixed(spark, sf):
    k = F.col("o_orderkey")
    return load(spark, sf, "orders").select(k.alias("id"), mixed_times(k, F.col("o_orderdate")).alias("raw"))


@query("b01_lenient_timestamp", f"""WITH {_MIXED_SQL}
SELECT id, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS ts FROM mixed""")
def lenient_timestamp(spark, sf):
    return _mixed(spark, sf).select("id", F.date_format(c.lenient_timestamp("raw"), "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("ts"))


@query("b02_day_text", """
SELECT event_id, CASE event_id % 4 WHEN 3 THEN '' ELSE strftime(ts, '%Y-%m-%d') END AS day FROM events""")
def day_text(spark, sf):
    k, t = F.col("event_id"), F.col("ts")
    raw = (
        F.when(k % 4 == 0, F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss'Z'"))
        .when(k % 4 == 1, F.date_format(t, "yyyy-MM-dd"))
        .when(k % 4 == 2, F.concat(F.date_format(t, "yyyy-MM-dd"), F.lit(" about noon")))
        .otherwise("unknown")
    )
    return load(spark, sf, "events").select("event_id", c.day_text(raw).alias("day"))


@query("b03_utc_iso_text", f"""WITH {_MIXED_SQL}
SELECT 'event' AS kind, event_id AS id, strftime(ts, '%Y-%m-%dT%H:%M:%S') || '+00:00' AS iso FROM events
UNION ALL SELECT 'order', id, strftime(ts, '%Y-%m-%dT%H:%M:%S') || '+00:00' FROM mixed""")
def utc_iso_text(spark, sf):
    events = load(spark, sf, "events").select(F.lit("event").alias("kind"), F.col("event_id").alias("id"), c.utc_iso_text("ts").alias("iso"))
    return events.unionByName(_mixed(spark, sf).select(F.lit("order").alias("kind"), "id", c.utc_iso_text("raw").alias("iso")))


_FLAG_TEXT_SQL = """
flags AS (
  SELECT event_id, CASE event_id % 8 WHEN 0 THEN 'True' WHEN 1 THEN 'False' WHEN 2 THEN ' yes ' WHEN 3 THEN 'T'
    WHEN 4 THEN '0.5' WHEN 5 THEN '1.0' WHEN 6 THEN 'no' ELSE NULL END AS raw FROM events)"""


def _flag_text(spark, sf):
    k = F.col("event_id") % 8
    texts = {0: "True", 1: "False", 2: " yes ", 3: "T", 4: "0.5", 5: "1.0", 6: "no"}
    raw = F.lit(None).cast("string")
    for i, text in texts.items():
        raw = F.when(k == i, text).otherwise(raw)
    return load(spark, sf, "events").select("event_id", raw.alias("raw"))


@query("b04_truthy_text", f"""WITH {_FLAG_TEXT_SQL}
SELECT event_id, CASE raw WHEN 'True' THEN 1 WHEN 'False' THEN 0 END AS exact_words,
  CASE WHEN lower(trim(coalesce(raw, ''))) IN ('true','1','t','yes') THEN 1 ELSE 0 END AS listed_words,
  CASE WHEN coalesce(try_cast(raw AS DOUBLE), 0) >= 0.5 THEN 1 ELSE 0 END AS from_half,
  CASE WHEN coalesce(try_cast(raw AS DOUBLE), 0) >= 1.0 THEN 1 ELSE 0 END AS from_one
FROM flags""")
def truthy_text(spark, sf):
    return _flag_text(spark, sf).select(
        "event_id",
        c.truthy_exact("raw").alias("exact_words"),
        c.truthy_words("raw").alias("listed_words"),
        c.truthy_number("raw", 0.5).alias("from_half"),
        c.truthy_number("raw", 1.0).alias("from_one"),
    )


@query("b05_number_coercion", """
SELECT o_orderkey, CASE WHEN o_orderkey % 4 < 2 THEN o_totalprice END AS number_or_null,
  CASE WHEN o_orderkey % 4 < 2 THEN o_totalprice ELSE 0 END AS number_or_zero FROM orders""")
def number_coercion(spark, sf):
    k = F.col("o_orderkey") % 4
    raw = F.when(k == 0, F.col("o_totalprice").cast("string")).when(
        k == 1, F.concat(F.lit(" "), F.col("o_totalprice").cast("string"))
    ).when(k == 2, "NaN").otherwise("n/a")
    return load(spark, sf, "orders").select(
        "o_orderkey", c.number_or_null(raw).alias("number_or_null"), c.number_or_zero(raw).alias("number_or_zero")
    )


@query("b06_key_trim", """
SELECT trim(project) AS project, count(*) AS n FROM (
  SELECT CASE n_nationkey % 5 WHEN 0 THEN '  ' WHEN 1 THEN ' ' || n_name ELSE n_name || ' ' END AS project
  FROM customer JOIN nation ON c_nationkey = n_nationkey) WHERE trim(project) <> '' GROUP BY 1""")
def key_trim(spark, sf):
    k = F.col("n_nationkey") % 5
    names = load(spark, sf, "nation").select(
        F.col("n_nationkey").alias("c_nationkey"),
        F.when(k == 0, "  ").when(k == 1, F.concat(F.lit(" "), "n_name")).otherwise(F.concat("n_name", F.lit(" "))).alias("project"),
    )
    df = load(spark, sf, "customer").select("c_nationkey").join(names, "c_nationkey")
    return tb.trim_key(df, "project").groupBy("project").agg(F.count("*").alias("n"))


@query("b07_bulk_rename", """
SELECT s_suppkey AS "supplier.id", s_name AS name, s_nationkey AS nationkey, s_acctbal AS balance FROM supplier""")
def bulk_rename(spark, sf):
    df = load(spark, sf, "supplier")
    return tb.bulk_rename(df, {"s_suppkey": "supplier.id", "s_acctbal": "s_balance"}, remove="s_")


@query("b08_column_alias", """
SELECT CAST(o_orderdate AS DATE)::VARCHAR AS merge_date, CAST(count(*) AS BIGINT) AS n,
       CAST(sum(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) AS BIGINT) AS flagged FROM orders GROUP BY 1""")
def column_alias(spark, sf):
    df = load(spark, sf, "orders").select(
        F.to_date("o_orderdate").cast("string").alias("Label_Date"),
        (F.col("o_orderstatus") == "F").cast("int").alias("y_flagged"),
    )
    df = tb.normalise_columns(df, {"merge_date": ["merge_date", "label_date", "date"], "flagged": ["flagged", "y_flagged"]})
    return df.groupBy("merge_date").agg(F.count("*").alias("n"), F.sum("flagged").alias("flagged"))


@query("b09_required_columns", """
SELECT 'nation' AS table_name, 1 AS usable, '' AS missing, count(*) AS n FROM nation
UNION ALL SELECT 'supplier', 0, 'c_custkey,n_name', 0""")
def required_columns(spark, sf):
    out = None
    for name in ("nation", "supplier"):
        df = load(spark, sf, name)
        missing = tb.missing_columns(df, ["n_name"] if name == "nation" else ["c_custkey", "n_name"])
        row = (df if not missing else df.limit(0)).agg(F.count("*").alias("n")).select(
            F.lit(name).alias("table_name"),
            F.lit(0 if missing else 1).alias("usable"),
            F.lit(",".join(missing)).alias("missing"),
            "n",
        )
        out = row if out is None else out.unionByName(row)
    return out


@query("b10_date_range", """
SELECT 'swapped' AS kind, count(*) AS n FROM orders WHERE o_orderdate BETWEEN DATE '1996-03-01' AND DATE '1997-06-30'
UNION ALL SELECT 'open_end', count(*) FROM orders WHERE o_orderdate >= DATE '1997-06-30'
UNION ALL SELECT 'open_start', count(*) FROM orders WHERE o_orderdate <= DATE '1996-03-01'
UNION ALL SELECT 'open', count(*) FROM orders""")
def date_range(spark, sf):
    df = load(spark, sf, "orders").select(F.to_date("o_orderdate").alias("day"))
    a, b = F.to_date(F.lit("1997-06-30")), F.to_date(F.lit("1996-03-01"))
    tests = {"swapped": (a, b), "open_end": (a, None), "open_start": (None, b), "open": (None, None)}
    counts = df.agg(*[F.count_if(c.within_open_ended("day", *ends)).alias(k) for k, ends in tests.items()])
    return counts.unpivot([], list(tests), "kind", "n")


@query("b11_missing_passes", """
SELECT event_type, count(*) AS n FROM events
WHERE (event_id % 3 = 0 OR ts BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-12')
  AND (event_id % 5 = 0 OR ts BETWEEN TIMESTAMP '2024-01-08' AND TIMESTAMP '2024-01-20') GROUP BY 1""")
def missing_passes(spark, sf):
    k, t = F.col("event_id"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    df = load(spark, sf, "events").select(
        "event_type",
        c.lenient_timestamp(F.when(k % 3 == 0, "soon").otherwise(t)).alias("published"),
        c.lenient_timestamp(F.when(k % 5 != 0, t)).alias("modified"),
    )

    def at(day: str):
        return F.lit(day).cast("timestamp")

    return (
        df.filter(c.missing_or_within("published", at("2024-01-05"), at("2024-01-12")))
        .filter(c.missing_or_within("modified", at("2024-01-08"), at("2024-01-20")))
        .groupBy("event_type")
        .agg(F.count("*").alias("n"))
    )


@query("b12_utc_day", f"""WITH {_MIXED_SQL}
SELECT 'event' AS kind, event_id AS id, CAST(CAST(ts AS DATE) AS VARCHAR) AS day FROM events
UNION ALL SELECT 'order', id, CAST(CAST(ts AS DATE) AS VARCHAR) FROM mixed""")
def utc_day(spark, sf):
    events = load(spark, sf, "events").select(F.lit("event").alias("kind"), F.col("event_id").alias("id"), c.utc_day("ts").cast("string").alias("day"))
    return events.unionByName(_mixed(spark, sf).select(F.lit("order").alias("kind"), "id", c.utc_day("raw").cast("string").alias("day")))


@query("b13_feature_columns", """
SELECT c_custkey, c_acctbal, c_nationkey, CAST(length(c_name) AS INTEGER) AS text_1, CAST(length(c_mktsegment) AS INTEGER) AS text_2 FROM customer""")
def feature_columns(spark, sf):
    df = load(spark, sf, "customer").select(
        "c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment",
        F.length("c_name").alias("text_1"), F.length("c_mktsegment").alias("text_2"), F.lit(1).alias("text_raw"),
    )
    sets = {"account": ["c_acctbal"], "place": ["c_nationkey", "c_acctbal"]}
    chosen = tb.feature_columns(
        df.columns, deny=["c_custkey", "c_name", "c_mktsegment"], named_sets=sets, use=["account", "place"],
        text_prefix="text_", deny_suffix="_raw",
    )
    return df.select("c_custkey", *chosen)


@query("b14_training_scope", """
SELECT 'all' AS scope, count(DISTINCT c_nationkey) AS projects, count(*) AS n FROM customer
UNION ALL SELECT 'exclude_target', count(DISTINCT c_nationkey), count(*) FROM customer WHERE c_nationkey <> 3
UNION ALL SELECT 'list', count(DISTINCT c_nationkey), count(*) FROM customer WHERE c_nationkey IN (1, 2, 5)""")
def training_scope(spark, sf):
    df = load(spark, sf, "customer").select(F.concat(F.lit("p"), "c_nationkey").alias("project"))
    available = load(spark, sf, "nation").select(F.concat(F.lit("p"), "n_nationkey").alias("project"))
    out = None
    for scope in ("all", "exclude_target", "list"):
        rows = tb.training_scope(df, scope, target="p3", listed=["p1", "p2", "p5", "p999"], available=available)
        row = rows.agg(F.countDistinct("project").alias("projects"), F.count("*").alias("n")).select(
            F.lit(scope).alias("scope"), "projects", "n"
        )
        out = row if out is None else out.unionByName(row)
    return out


@query("b15_align_columns", """
SELECT s_suppkey AS id, s_acctbal AS balance, 0.0::DOUBLE AS churn, CAST(NULL AS VARCHAR) AS note FROM supplier""")
def align_columns(spark, sf):
    df = load(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_acctbal").alias("balance"), "s_name")
    return tb.align_columns(df, {"id": "bigint", "balance": "double", "churn": "double", "note": "string"}, zero=["churn"])


@query("b16_clip_low", """SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 0 ELSE c_acctbal END AS balance FROM customer""")
def clip_low(spark, sf):
    return load(spark, sf, "customer").select("c_custkey", c.clip_low("c_acctbal").alias("balance"))


@query("b17_canonical_name", r"""
SELECT CASE p_type WHEN 'ECONOMY' THEN 'Economy class' ELSE regexp_replace(regexp_replace(p_name, '^small ', 'S-', 'g'), 'bolt$', 'Bolt', 'g') END AS label,
       count(*) AS n FROM part GROUP BY 1""")
def canonical_name(spark, sf):
    raw = F.when(F.col("p_type") == "ECONOMY", F.col("p_type")).otherwise(F.col("p_name"))
    label = c.canonical_name(raw, {"ECONOMY": "Economy class"}, [("^small ", "S-"), ("bolt$", "Bolt")])
    return load(spark, sf, "part").groupBy(label.alias("label")).agg(F.count("*").alias("n"))


@query("b18_label_source", f"""WITH {s.SCORED_CTE}
SELECT 'named' AS case_name, 'predicted_label_a' AS source, CAST(NULL AS DOUBLE) AS threshold,
       CAST(sum(flagged) AS BIGINT) AS positives FROM scored
UNION ALL SELECT 'derived', 'predicted_label_a', NULL, CAST(sum(flagged) AS BIGINT) FROM scored
UNION ALL SELECT 'candidate', 'predicted_label_a', NULL, CAST(sum(flagged) AS BIGINT) FROM scored
UNION ALL SELECT 'threshold', 'predicted_risk_b>= 0.500', 0.5, CAST(sum(CASE WHEN risk >= 0.5 THEN 1 ELSE 0 END) AS BIGINT) FROM scored""")
def label_source(spark, sf):
    base = s.scored(spark, sf)
    labelled = base.select(F.col("risk").alias("predicted_risk_a"), F.col("flagged").alias("predicted_label_a"))
    risk_only = base.select(F.col("risk").alias("predicted_risk_b"))
    cases = {
        "named": (labelled, None, "predicted_label_a"),
        "derived": (labelled, "predicted_risk_a", None),
        "candidate": (labelled, "predicted_risk_zzz", "absent"),
        "threshold": (risk_only, "predicted_risk_b", None),
    }
    out = None
    for name, (df, risk, label) in cases.items():
        got = tb.resolve_label(df, risk, label, 0.5)
        row = df.agg(F.sum(got.flag.cast("bigint")).alias("positives")).select(
            F.lit(name).alias("case_name"),
            F.lit(got.source).alias("source"),
            F.lit(got.threshold).cast("double").alias("threshold"),
            "positives",
        )
        out = row if out is None else out.unionByName(row)
    return out


@query("b19_nullable_flag", """
SELECT event_id, CASE WHEN event_id % 7 = 0 THEN NULL WHEN value >= 50 THEN 1 ELSE 0 END AS label FROM events""")
def nullable_flag(spark, sf):
    score = F.when(F.col("event_id") % 7 != 0, F.col("value"))
    return load(spark, sf, "events").select("event_id", c.nullable_flag(score, 50.0).alias("label"))


@query("b20_ignore_case_filter", """SELECT c_custkey, c_mktsegment FROM customer WHERE lower(c_mktsegment) = 'machinery'""")
def ignore_case_filter(spark, sf):
    return load(spark, sf, "customer").filter(c.same_ignoring_case("c_mktsegment", "MachinerY")).select("c_custkey", "c_mktsegment")


@query("b21_row_errors", """
SELECT event_id, CASE WHEN event_id % 9 <> 0 THEN CAST(regexp_extract(props, '(\\d+)', 1) AS BIGINT) END AS k,
  CASE WHEN event_id % 9 = 0 THEN 'no field k in: {"x": 1}' END AS processing_error FROM events""")
def row_errors(spark, sf):
    raw = F.when(F.col("event_id") % 9 == 0, '{"x": 1}').otherwise(F.col("props"))
    df = load(spark, sf, "events").select("event_id", raw.alias("raw"))
    k = F.get_json_object("raw", "$.k").try_cast("bigint")
    return tb.with_row_error(df, "k", k, F.concat(F.lit("no field k in: "), "raw")).drop("raw")


@query("b22_language_filter", """
SELECT CAST(sum(CASE WHEN l IN ('c', 'c++') THEN 1 ELSE 0 END) AS BIGINT) AS processed,
       CAST(sum(CASE WHEN l = '' THEN 1 ELSE 0 END) AS BIGINT) AS missing,
       CAST(sum(CASE WHEN l NOT IN ('c', 'c++', '') THEN 1 ELSE 0 END) AS BIGINT) AS skipped
FROM (SELECT CASE p_size % 4 WHEN 0 THEN 'c' WHEN 1 THEN 'c++' WHEN 2 THEN '' ELSE 'rust' END AS l FROM part)""")
def language_filter(spark, sf):
    k = F.col("p_size") % 4
    lang = F.when(k == 0, " C").when(k == 1, "c++ ").when(k == 2, F.lit(None)).otherwise("Rust")
    return tb.status_counts(load(spark, sf, "part").select(lang.alias("language")), "language", ["c", "c++"])


@query("b23_code_paths", f"""WITH {s.COMMIT_FILES_CTE}
SELECT commit_id, path FROM commit_files WHERE regexp_matches(lower(path), '\\.(c|cc|cpp|cxx|h|hh|hpp|hxx)$')""")
def code_paths(spark, sf):
    return s.commit_files(spark, sf).filter(c.is_code_path("path")).select("commit_id", "path")
