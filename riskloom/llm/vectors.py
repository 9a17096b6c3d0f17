"""Vector columns: cleaning, the common length, and exchange with numpy."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.llm.texts import only


def usable(vector: Column) -> Column:
    """True where the vector is not null, not empty and holds neither null nor non-finite entries."""
    bad = lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf"))
    return vector.isNotNull() & (F.size(vector) > 0) & ~F.coalesce(F.exists(vector, bad), F.lit(True))


def clean_vectors(table: DataFrame, id_col: str, vector_col: str, but: Column | None = None, dims: int | None = None) -> tuple[DataFrame, int]:
    """(id, v) of usable vectors and their length; ``but`` is a further condition on ``v``.

    A table has one length: ``dims`` or else the most frequent one, the greater of two equally
    frequent ones. Rows of any other length are left out. The length is 0 where nothing is left.
    Floats stay floats; entries of any other type are read as doubles.
    """
    kind = "array<float>" if table.schema[vector_col].dataType.simpleString() == "array<float>" else "array<double>"
    rows = only(table, id=id_col, v=vector_col).select(F.col("id").cast("long").alias("id"), F.col("v").cast(kind).alias("v"))
    rows = rows.filter(usable(F.col("v")) if but is None else usable(F.col("v")) & but)
    if dims:
        return rows.filter(F.size("v") == dims), dims
    sizes = rows.groupBy(F.size("v").alias("size")).agg(F.count("*").alias("n"))
    most = sizes.orderBy(F.desc("n"), F.desc("size")).first()  # one row
    dims = most["size"] if most else 0
    return rows.filter(F.size("v") == dims), dims


def as_matrix(column: pa.Array, dims: int, kind: type = np.float64) -> np.ndarray:
    """Rows of a list column of equal lengths."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(kind, copy=False).reshape(-1, dims)
