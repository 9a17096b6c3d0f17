"""Readers for the file layouts the jobs meet. Schemas are given, never inferred.

Entity names and days come from the file path through the ``_metadata`` column, so one
scan serves all projects.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType, StructType, _parse_datatype_string

from riskloom.functions import records as rec
from riskloom.functions import text as tx
from riskloom.operators.ranking import top_per_group
from riskloom.operators.tables import computed_once



def unescape(text: Column) -> Column:
    """Percent escapes undone; a plus sign stays one."""
    return F.url_decode(F.replace(text, F.lit("+"), F.lit("%2B")))


def file_path() -> Column:
    """Path of the row's file as it is named on disk."""
    return unescape(F.col("_metadata.file_path"))


def _schema(schema: StructType | str) -> StructType:
    return _parse_datatype_string(schema) if isinstance(schema, str) else schema


def path_part(name: str) -> Column:
    """Value of a ``name=value`` folder in the file path."""
    return unescape(F.regexp_extract(file_path(), rf"/{name}=([^/]+)/", 1))


def path_day() -> Column:
    """First folder of the path that reads as a day, as yyyyMMdd text."""
    return F.replace(F.regexp_extract(file_path(), r"/(?:[a-z_]+=)?(\d{4}-?\d{2}-?\d{2})/", 1), F.lit("-"), F.lit(""))


def read_csv(spark: SparkSession, paths: str | Sequence[str], schema: StructType | str, recursive: bool = False, **extra: Column) -> DataFrame:
    """CSV with a header; malformed cells and NaN become null, a missing path gives no rows.

    ``extra`` adds columns over the file path.
    """
    typed = _schema(schema)
    try:
        df = (
            spark.read.schema(typed)
            .options(header=True, mode="PERMISSIVE", recursiveFileLookup=recursive)
            .csv(paths if isinstance(paths, str) else list(paths))
        )
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], typed).select("*", *[F.lit(None).cast("string").alias(n) for n in extra])
    cells = [
        (F.when(~F.isnan(f.name), F.col(f.name)) if isinstance(f.dataType, (DoubleType, FloatType)) else F.col(f.name)).alias(f.name)
        for f in typed
    ]
    return df.select(*cells, *[e.alias(n) for n, e in extra.items()])


def list_files(spark: SparkSession, root: str, glob: str = "*") -> DataFrame:
    """File paths below ``root``; contents are never read because the column is pruned."""
    files = spark.read.format("binaryFile").options(recursiveFileLookup=True, pathGlobFilter=glob).load(root)
    return files.select("path", (F.size(F.split("path", "/"))).alias("depth"))


def preferred_files(files: DataFrame, entity: Column, preference: Column | None = None) -> DataFrame:
    """One file per entity: by preference, then the shallowest, then by name."""
    order = ([preference] if preference is not None else []) + [F.col("depth"), F.col("path")]
    named = files.withColumn("entity", entity).filter("entity <> ''")
    return top_per_group(named, ["entity"], order, 1).select("entity", "path")


def keep_files(df: DataFrame, chosen: DataFrame, file_column: str = "file_path") -> DataFrame:
    """Rows read from the chosen files (one path per entity)."""
    bare = F.regexp_replace(chosen["path"], r"^[a-z]+:/+", "/")
    return df.join(chosen.select(bare.alias("_p")), F.regexp_replace(file_column, r"^[a-z]+:/+", "/") == F.col("_p"), "left_semi")


COVERAGE_BLOCK = f"struct<files:array<struct<filename:string,summary:{rec.COVERAGE_SUMMARY}>>,totals:{rec.COVERAGE_SUMMARY}>"
COVERAGE_FILE = (
    f"data array<{COVERAGE_BLOCK}>, files array<struct<filename:string,summary:{rec.COVERAGE_SUMMARY}>>, totals {rec.COVERAGE_SUMMARY}"
)


def read_coverage(spark: SparkSession, root: str, multi_line: bool = True) -> DataFrame:
    """Coverage reports in either envelope: project, day, files, totals. Reports without a day drop out."""
    raw = spark.read.schema(COVERAGE_FILE).options(multiLine=multi_line, recursiveFileLookup=True, mode="PERMISSIVE").json(root)
    block = F.try_element_at("data", F.lit(1))
    found = raw.select(
        path_part("project").alias("project"),
        path_day().alias("date"),
        F.coalesce(block["files"], F.col("files")).alias("files"),
        F.coalesce(block["totals"], F.col("totals")).alias("totals"),
    )
    return found.filter("date <> '' AND (files IS NOT NULL OR totals IS NOT NULL)")


def read_advisories(spark: SparkSession, root: str, multi_line: bool = True) -> DataFrame:
    return spark.read.schema(rec.ADVISORY_SCHEMA).options(multiLine=multi_line, recursiveFileLookup=True, mode="PERMISSIVE").json(root)


def read_source_maps(spark: SparkSession, root: str, whole_files: bool = True) -> DataFrame:
    """Source maps (path to revision and address): one row per path; entries lacking either drop out."""
    raw = spark.read.text(root, wholetext=whole_files, recursiveFileLookup=True)
    entries = F.from_json("value", "map<string,struct<type:string,url:string,rev:string>>")
    rows = raw.select(path_part("project").alias("project"), path_day().alias("date"), F.explode(entries).alias("src_path", "info"))
    return rows.filter("info.rev IS NOT NULL AND info.url IS NOT NULL").select(
        "project", "date", F.replace("src_path", F.lit("/src/"), F.lit("")).alias("repo_name"), F.col("info.url").alias("url"), F.col("info.rev").alias("revision")
    )


# Metric names of the positive class.
CLASS_METRICS = ["accuracy", "precision", "recall", "f1-score", "roc_auc", "pr_auc", "mcc"]
EXPERIMENT_FILE = (
    "mcc double, auc_roc double, accuracy double, classification_report_dict struct<class_1:struct<"
    + ",".join(f"`{m}`:double" for m in CLASS_METRICS)
    + ">>"
)


def read_experiment_metrics(spark: SparkSession, root: str, multi_line: bool = True) -> DataFrame:
    raw = spark.read.schema(EXPERIMENT_FILE).options(multiLine=multi_line, recursiveFileLookup=True).json(root)
    return raw.select(
        path_part("model").alias("model"),
        path_part("project").alias("project"),
        path_part("experiment").alias("experiment"),
        *[F.col("classification_report_dict.class_1").getField(m).alias(m.replace("-", "_")) for m in CLASS_METRICS],
    )


def read_importances(spark: SparkSession, root: str) -> DataFrame:
    """Feature importances, held at 0 from below."""
    df = read_csv(spark, root, "feature string, importance double", recursive=True, model=path_part("model"), project=path_part("project"))
    return df.withColumn("importance", F.greatest("importance", F.lit(0.0)))


def parse_config(df: DataFrame, keys: Sequence[str], text: str, wanted: Sequence[str], optional: Sequence[str] = ()) -> DataFrame:
    """``key: value`` texts: comments cut, first value per key, quotes removed.

    Adds one column per wanted key and ``missing``, the required keys without a value.
    """
    lines = df.select(*keys, F.posexplode(F.split(text, r"\r?\n")).alias("_no", "_line"))
    bare = F.trim(F.split_part("_line", F.lit("#"), F.lit(1)))
    pairs = lines.withColumn("_line", bare).filter(F.contains("_line", F.lit(":"))).select(
        *keys, "_no", F.trim(F.substring_index("_line", ":", 1)).alias("_key"), F.trim(F.regexp_replace("_line", r"^[^:]*:", "")).alias("_value")
    )
    value = F.regexp_replace("_value", r"""^(['"])(.*)['"]$""", "$2")
    columns = [*wanted, *[o for o in optional if o not in wanted]]
    # texts are split inside the task that holds them, so the group-by meets partial rows only
    found = pairs.filter(F.col("_key").isin(columns)).groupBy(*keys).agg(
        *[F.min_by(F.when(F.col("_key") == c, value), F.when(F.col("_key") == c, F.col("_no"))).alias(c) for c in columns]
    )
    out = df.select(*keys).join(found, list(keys), "left")
    lacking = F.concat_ws(",", *[F.when(F.col(c).isNull(), c) for c in wanted if c not in optional])
    return out.withColumn("missing", lacking)


def read_configs(spark: SparkSession, root: str, wanted: Sequence[str], optional: Sequence[str] = ()) -> DataFrame:
    """One small config file per project."""
    texts = spark.read.text(root, wholetext=True, recursiveFileLookup=True).select(path_part("project").alias("project"), "value")
    return parse_config(texts, ["project"], "value", wanted, optional)


def read_key_list(spark: SparkSession, path: str) -> DataFrame:
    """Keys one per line or separated by commas or blanks; blanks drop out."""
    lines = spark.read.text(path)
    return lines.select(F.explode(tx.split_list("value", r"[,\s]+")).alias("key"))


def read_mapping(spark: SparkSession, path: str, kind: str, whole_files: bool = True) -> DataFrame:
    """Key/value pairs from JSON objects or two-column CSV without header; incomplete pairs drop out."""
    if kind == "json":
        raw = spark.read.text(path, wholetext=whole_files)
        pairs = raw.select(F.explode(F.from_json("value", "map<string,string>")).alias("key", "value"))
    elif kind == "csv":
        pairs = spark.read.schema("key string, value string").option("mode", "PERMISSIVE").csv(path)
    else:
        raise ValueError(f"unknown mapping kind {kind!r}")
    return pairs.select(F.trim("key").alias("key"), F.trim("value").alias("value")).filter("key <> '' AND value <> ''")


def parse_object_paths(df: DataFrame, path: str, files: Sequence[str], start: Column, end: Column) -> DataFrame:
    """Report paths in two layouts, with or without a target, for wanted files and days.

    ``project/reports/day/target/linux/file`` and ``project/reports/day/linux/file``.
    """
    rows = computed_once(df, _p=F.split(path, "/"))
    p = F.col("_p")
    n = F.size(p)
    long, short = (n == 6) & (p[4] == "linux"), (n == 5) & (p[3] == "linux")
    out = rows.filter((long | short) & F.element_at(p, -1).isin(list(files)) & p[2].rlike(r"^\d{8}$")).select(
        *df.columns,
        p[0].alias("project"),
        F.try_to_timestamp(p[2], F.lit("yyyyMMdd")).cast("date").alias("day"),
        F.when(long, p[3]).otherwise("no_target").alias("target"),
        F.element_at(p, -1).alias("file_name"),
    )
    return out.filter(F.col("day").between(start, end))


def request_grid(keys: DataFrame, start: Column, end: Column) -> DataFrame:
    """Every key with every day of the range."""
    return keys.select("*", F.explode(F.sequence(start, end)).alias("day"))


_ROW = r"(?s)<tr[^>]*>(.*?)</tr>"
_NUMBER = r"""<td[^>]*class=['"]line-number['"][^>]*>(?:\s|<[^>]*>)*(\d+)"""
_COUNT = r"""<td[^>]*class=['"](?:un)?covered-line['"][^>]*>(?:\s|<[^>]*>)*([0-9.]+)([kKmM]?)"""
_CODE = r"""(?s)<td[^>]*class=['"]code['"][^>]*>(.*?)</td>"""
# The entities a report escapes in code text; the ampersand comes last.
_ENTITIES = [("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")]


def _plain(html: Column) -> Column:
    text = F.regexp_replace(html, r"<[^>]*>", "")
    for entity, char in _ENTITIES:
        text = F.replace(text, F.lit(entity), F.lit(char))
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def report_lines(pages: DataFrame, keys: Sequence[str], html: str) -> DataFrame:
    """Line number, code text and hit count from coverage pages; the first row of a line wins.

    Counts may end in ``k`` or ``m``; lines without a count have a null one. Pages are
    partitioned by their key before they are taken apart, so lines never move.
    """
    placed = pages.select(*keys, html).repartition(*keys)
    rows = placed.select(*keys, F.posexplode(F.regexp_extract_all(html, F.lit(_ROW), F.lit(1))).alias("_pos", "_row"))
    rows = rows.filter(F.contains("_row", F.lit("line-number")))
    cells = computed_once(
        rows,
        line_no=F.regexp_extract("_row", _NUMBER, 1).try_cast("bigint"),
        _amount=F.regexp_extract("_row", _COUNT, 1).try_cast("double"),
        _unit=F.lower(F.regexp_extract("_row", _COUNT, 2)),
        _code=F.when(F.col("_row").rlike(r"""class=['"]code['"]"""), F.regexp_extract("_row", _CODE, 1)),
    )
    scale = F.when(F.col("_unit") == "k", 1000).when(F.col("_unit") == "m", 1000000).otherwise(1)
    lines = cells.filter("line_no IS NOT NULL AND _code IS NOT NULL")
    first = F.min_by(F.struct("_code", F.floor(F.col("_amount") * scale).alias("execute")), "_pos")
    firsts = lines.groupBy(*keys, "line_no").agg(first.alias("_v"))
    return firsts.select(*keys, "line_no", _plain(F.col("_v._code")).alias("content"), "_v.execute")
