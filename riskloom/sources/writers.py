"""Sinks: CSV in a fixed column order, appends by day, nested JSON, incremental runs."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.functions.clean import missing_to_null
from riskloom.operators.sets import not_yet_done


def write_csv(df: DataFrame, path: str, columns: Sequence[str], digits: Mapping[str, int] | None = None, partition_by: Sequence[str] = ()) -> None:
    """Columns in the given order, floats rounded to fixed digits, with a header."""
    out = df.select(*columns, *[p for p in partition_by if p not in columns])
    out = out.withColumns({c: F.round(c, d) for c, d in (digits or {}).items()})
    out.write.mode("overwrite").option("header", True).partitionBy(*partition_by).csv(path)


def append_rows(df: DataFrame, path: str, partition_by: str) -> None:
    """Append to a day-partitioned table; the schema travels with the files."""
    df.write.mode("append").partitionBy(partition_by).parquet(path)


def json_safe(fields: Mapping[str, str | Column]) -> Column:
    """A JSON object whose NaN and infinite numbers are null (null fields are written out)."""
    parts = [missing_to_null(v).alias(n) for n, v in fields.items()]
    return F.to_json(F.struct(*parts), {"ignoreNullFields": "false"})


def write_json(df: DataFrame, path: str, column: str, partition_by: Sequence[str] = ()) -> None:
    df.select(column, *partition_by).write.mode("overwrite").partitionBy(*partition_by).text(path)


def extend_table(spark: SparkSession, new: DataFrame, path: str, keys: Sequence[str], ignore_case: bool = False) -> DataFrame:
    """Append only rows whose key the table does not hold yet; returns the whole table."""
    done = spark.read.schema(new.schema).parquet(path)
    not_yet_done(new, done, keys, ignore_case).write.mode("append").parquet(path)
    return spark.read.schema(new.schema).parquet(path)
