"""Whole-table helpers: keys, column names, required columns, scopes, label choice."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.functions import clean

ROWS_OF_TASK = 150_000  # rows that share a task where several group-bys on them follow each other


def trim_key(df: DataFrame, *keys: str) -> DataFrame:
    """Trim the keys and drop rows where one is blank or missing."""
    out = df.withColumns({k: F.trim(k) for k in keys})
    for k in keys:
        out = out.filter(F.col(k) != "")
    return out


def bulk_rename(df: DataFrame, names: Mapping[str, str], remove: str = "") -> DataFrame:
    renamed = [names.get(c, c) for c in df.columns]
    return df.toDF(*[c.replace(remove, "") if remove else c for c in renamed])


def normalise_columns(df: DataFrame, aliases: Mapping[str, Sequence[str]]) -> DataFrame:
    """Rename the first present spelling of each wanted column, ignoring case."""
    present = {c.lower(): c for c in df.columns}
    renames = {}
    for wanted, spellings in aliases.items():
        found = next((present[s.lower()] for s in spellings if s.lower() in present), None)
        if found is not None and found != wanted:
            renames[found] = wanted
    return df.withColumnsRenamed(renames)


def missing_columns(df: DataFrame, required: Sequence[str]) -> list[str]:
    return sorted(set(required) - set(df.columns))


def require_columns(df: DataFrame, required: Sequence[str], table: str = "table") -> DataFrame:
    missing = missing_columns(df, required)
    if missing:
        raise ValueError(f"{table} lacks columns: {', '.join(missing)}")
    return df


def feature_columns(
    columns: Sequence[str],
    deny: Sequence[str] = (),
    named_sets: Mapping[str, Sequence[str]] | None = None,
    use: Sequence[str] = (),
    text_prefix: str | None = None,
    deny_suffix: str | None = None,
) -> list[str]:
    """Union of the named sets in use and the text columns; all but the denied ones without sets."""
    def allowed(c: str) -> bool:
        return c not in deny and not (deny_suffix and c.endswith(deny_suffix))

    if not named_sets or not use:
        return [c for c in columns if allowed(c)]
    wanted = [c for name in use for c in named_sets[name]]
    if text_prefix:
        wanted += [c for c in columns if c.startswith(text_prefix)]
    return [c for c in dict.fromkeys(wanted) if c in columns and allowed(c)]


def training_scope(
    df: DataFrame,
    scope: str,
    target: str,
    listed: Sequence[str] = (),
    available: DataFrame | None = None,
    entity: str = "project",
) -> DataFrame:
    """Rows of the entities to train on: ``all``, ``exclude_target`` or a ``list``."""
    if scope == "list":
        out = df.filter(F.col(entity).isin(list(listed)))
    elif scope == "exclude_target":
        out = df.filter(F.col(entity) != target)
    elif scope == "all":
        out = df
    else:
        raise ValueError(f"unknown scope {scope!r}")
    return out if available is None else out.join(available.select(entity).distinct(), entity, "left_semi")


def align_columns(df: DataFrame, schema: Mapping[str, str], zero: Sequence[str] = ()) -> DataFrame:
    """Exactly the columns of ``schema``; absent ones become 0 (if in ``zero``) or null."""
    return df.select(
        *[
            (F.col(c) if c in df.columns else F.lit(0 if c in zero else None)).cast(t).alias(c)
            for c, t in schema.items()
        ]
    )


def computed_once(df: DataFrame, **columns: Column) -> DataFrame:
    """Add columns behind a generator, so later filters and projections reuse their values.

    Catalyst otherwise copies an expression into every place that names it; that is right
    for arithmetic and wrong for a regex or a split over a long text.
    """
    row = F.struct(*[c.alias(n) for n, c in columns.items()])
    return df.select("*", F.explode(F.array(row)).alias("_once")).select(*df.columns, "_once.*")


def dealt(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """Deal ``df`` by ``keys`` over as many tasks as hold ``ROWS_OF_TASK`` of its ``rows`` each.

    Group-bys and joins on these keys then follow in the same tasks. Spark would merge partitions
    up to a size in bytes of the shuffle, which keys that pack well turn into many rows.
    """
    return df.repartition(max(1, -(-rows // ROWS_OF_TASK)), *keys)


@dataclass(frozen=True)
class LabelChoice:
    flag: Column
    source: str
    threshold: float | None


def resolve_label(df: DataFrame, risk: str | None, label: str | None, threshold: float) -> LabelChoice:
    """Label column by name, by the risk column's name, any label column, else risk >= threshold."""
    risk_prefix, label_prefix = "predicted_risk_", "predicted_label"
    source = label if label in df.columns else None
    if source is None and risk:
        derived = risk.replace(risk_prefix, f"{label_prefix}_", 1)
        source = derived if derived in df.columns else None
    if source is None:
        candidates = [c for c in df.columns if c.startswith(label_prefix)]
        suffix = (risk or "").replace(risk_prefix, "")
        source = next((c for c in candidates if risk and c.endswith(suffix)), candidates[0] if candidates else None)
    if source is not None:
        return LabelChoice(clean.truthy_label(source) == 1, source, None)
    if risk and risk in df.columns:
        score = F.coalesce(clean.number_or_null(risk), F.lit(0.0))
        return LabelChoice(score >= threshold, f"{risk}>= {threshold:.3f}", threshold)
    raise ValueError("no label column and no risk column")


def with_row_error(df: DataFrame, name: str, value: Column, message: Column) -> DataFrame:
    """Keep rows whose value cannot be computed, with a message in place of the value."""
    return df.withColumn(name, value).withColumn("processing_error", F.when(F.col(name).isNull(), message))


def status_counts(df: DataFrame, column: str, accepted: Sequence[str]) -> DataFrame:
    """How many rows have an accepted value, none, or another one."""
    value = F.lower(F.trim(F.coalesce(F.col(column), F.lit(""))))
    ok = value.isin(list(accepted))
    return df.agg(
        F.count_if(ok).alias("processed"),
        F.count_if(value == "").alias("missing"),
        F.count_if((value != "") & ~ok).alias("skipped"),
    )
