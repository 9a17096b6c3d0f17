"""Nested records: advisory and coverage schemas and their flat columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ADVISORY_SCHEMA = (
    "id string, summary string, details string, modified string, published string, "
    "references array<struct<type:string,url:string>>, "
    "affected array<struct<package:struct<name:string,ecosystem:string>,versions:array<string>,"
    "ranges:array<struct<type:string,repo:string,events:array<struct<introduced:string,fixed:string>>>>,"
    "ecosystem_specific:struct<severity:string>,database_specific:struct<severity:string>,"
    "severity:array<struct<score:string>>>>, "
    "severity array<struct<score:string>>"
)

# Kinds of counted code and the fields of each.
COVERAGE_KINDS = ["branches", "functions", "instantiations", "lines", "regions"]
COVERAGE_FIELDS = {
    "branches": ["count", "covered", "notcovered", "percent"],
    "functions": ["count", "covered", "percent"],
    "instantiations": ["count", "covered", "percent"],
    "lines": ["count", "covered", "percent"],
    "regions": ["count", "covered", "notcovered", "percent"],
}


def _field_type(field: str) -> str:
    return "double" if field == "percent" else "bigint"


COVERAGE_SUMMARY = "struct<" + ",".join(
    f"{kind}:struct<{','.join(f'{f}:{_field_type(f)}' for f in COVERAGE_FIELDS[kind])}>" for kind in COVERAGE_KINDS
) + ">"


def coverage_columns(summary: str, prefix: str = "") -> list[Column]:
    """One flat column per kind and field, 0 where the record lacks it."""
    return [
        F.coalesce(F.col(f"{summary}.{kind}.{field}"), F.lit(0).cast(_field_type(field))).alias(f"{prefix}{kind}_{field}")
        for kind in COVERAGE_KINDS
        for field in COVERAGE_FIELDS[kind]
    ]


def advisory_columns(a: str) -> list[Column]:
    """Flat advisory columns: first report link, first package, commits of GIT ranges."""
    reports = F.filter(F.col(f"{a}.references"), lambda r: r["type"] == "REPORT")
    report_url = F.try_element_at(reports, F.lit(1))["url"]
    first = F.try_element_at(F.col(f"{a}.affected"), F.lit(1))
    git = F.filter(first["ranges"], lambda r: r["type"] == "GIT")
    events = F.flatten(F.transform(git, lambda r: r["events"]))

    def commits(kind: str) -> Column:
        found = F.filter(F.transform(events, lambda e: e[kind]), lambda c: c.isNotNull() & (c != ""))
        return F.concat_ws(";", found)

    severity = F.coalesce(
        first["ecosystem_specific"]["severity"],
        first["database_specific"]["severity"],
        F.try_element_at(first["severity"], F.lit(1))["score"],
        F.try_element_at(F.col(f"{a}.severity"), F.lit(1))["score"],
    )
    return [
        F.regexp_extract(report_url, r"(\d+)/?$", 1).try_cast("bigint").alias("issue_id"),
        F.col(f"{a}.id").alias("advisory_id"),
        first["package"]["name"].alias("package"),
        first["package"]["ecosystem"].alias("ecosystem"),
        F.try_element_at(git, F.lit(1))["repo"].alias("repo"),
        severity.alias("severity"),
        F.col(f"{a}.summary").alias("summary"),
        F.col(f"{a}.details").alias("details"),
        commits("introduced").alias("introduced_commits"),
        commits("fixed").alias("fixed_commits"),
        F.concat_ws(";", first["versions"]).alias("versions"),
        F.col(f"{a}.published").alias("published"),
        F.col(f"{a}.modified").alias("modified"),
        report_url.alias("report_url"),
    ]
