"""Coverage tables and patch coverage."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.functions import numeric as nm
from riskloom.functions import records as rec
from riskloom.functions.text import from_first_hunk
from riskloom.operators import joins as jn
from riskloom.operators import patches as pt
from riskloom.operators.sets import not_yet_done
from riskloom.sources.readers import report_lines


def coverage_tables(reports: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Per-file rows and total rows of coverage reports, in day and file order."""
    files = reports.select("project", "date", F.explode("files").alias("_f"))
    per_file = files.select(
        "project", "date", F.coalesce("_f.filename", F.lit("N/A")).alias("filename"), F.col("_f.summary").alias("_s")
    ).select("project", "date", "filename", *rec.coverage_columns("_s"))
    totals = reports.filter("totals IS NOT NULL").select("project", "date", *rec.coverage_columns("totals", "totals_"))
    return per_file.orderBy("project", "date", "filename"), totals.orderBy("project", "date")


def patch_coverage(added: DataFrame, report: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Added and covered lines per file and the covered percentage."""
    out = jn.covered_lines(added, report, keys)
    return out.withColumn("patch_coverage", nm.percent("covered_added_lines", "total_added_lines"))


def patch_coverage_table(patches: DataFrame, pages: DataFrame, done: DataFrame | None = None) -> DataFrame:
    """Patch coverage per project, day and file.

    ``patches``: project, date, path, patch. ``pages``: project, date, page_path, html.
    Days of a project already in ``done`` are skipped; files without a page count as
    uncovered, patches without added lines drop out.
    """
    keys = ["project", "date"]
    todo = patches if done is None else not_yet_done(patches, done, keys)
    added = pt.added_lines(todo.withColumn("patch", from_first_hunk("patch")), [*keys, "path"], "patch")
    matched = jn.suffix_join(todo, pages, keys, "path", "page_path", ending=".html")
    # only the pages that matched are taken apart
    wanted = pages.join(matched.select(*keys, "page_path").distinct(), [*keys, "page_path"], "left_semi")
    lines = report_lines(wanted, [*keys, "page_path"], "html").join(matched, [*keys, "page_path"])
    return patch_coverage(added, lines, [*keys, "path"])
