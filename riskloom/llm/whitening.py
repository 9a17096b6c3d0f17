"""Whitening of embeddings from a covariance found by polarisation.

Entries become whole numbers. For every dimension and for the sum of every pair of dimensions the
squares of the centred values are added up, in whole numbers and without rounding. The variance
of a sum less the variances of its parts is twice their covariance, so these sums give the whole
covariance matrix, whose eigenvectors whiten the rows.

Values are centred at the whole number next to the mean before they are squared. What is left of
the mean, less than one unit, is taken off the sums afterwards in exact whole numbers.

Tasks return one row per sum and 40-bit digit group: a number of rows fixed by the dimensions,
which Spark adds up. The driver sees these sums and nothing that grows with the rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.llm.vectors import as_matrix, clean_vectors
from riskloom.session import settle

SCALE = 256
DIGITS = 40  # bits in a digit group: 2^23 tasks can be added up in a long
SLICE = 2048  # rows that are squared together
_SUMS = "i int, j int, digit int, value long"
Batches = Iterator[pa.RecordBatch]


@dataclass
class Whitening:
    """What whitens a vector x: the mean sums / n, components by falling eigenvalue."""

    n: int
    sums: list[int]
    covariance: np.ndarray
    components: np.ndarray  # one row per component
    eigenvalues: np.ndarray
    trace: float
    identity_error: float | None = None
    centre: list[int] = field(init=False)

    def __post_init__(self) -> None:
        self.centre = [(2 * s + self.n) // (2 * self.n) for s in self.sums]  # nearest whole number

    @property
    def rest(self) -> list[int]:
        """n * mean less n * centre, per dimension."""
        return [s - self.n * c for s, c in zip(self.sums, self.centre)]

    def full_rank(self) -> np.ndarray:
        """Components whose eigenvalue is more than rounding."""
        return self.eigenvalues > 8 * len(self.sums) * np.finfo(float).eps * self.trace


def centred(rows: np.ndarray, centre: list[int]) -> np.ndarray:
    """Rows less ``centre``, in longs where those hold them and else in Python's whole numbers."""
    most = max((abs(c) for c in centre), default=0)
    if len(rows) and (int(rows.max()) > 2**61 or int(rows.min()) < -(2**61) or most > 2**61):
        return rows.astype(object) - np.array(centre, dtype=object)
    return rows - np.array(centre, dtype=np.int64)


def _largest(y: np.ndarray) -> int:
    return max(abs(int(y.max())), abs(int(y.min()))) if y.size else 0


class Total:
    """A row of exact sums: longs while they hold, Python's whole numbers beyond."""

    def __init__(self, size: int):
        self.whole, self.part, self.bound = np.zeros(size, dtype=object), np.zeros(size, dtype=np.int64), 0

    def add(self, most: int, values: Callable[[type], np.ndarray]) -> None:
        """``values(kind)`` computes what is added, at most ``most`` each, in longs or objects."""
        if most >= 2**62:
            self.whole += values(object)
            return
        if self.bound + most >= 2**62:
            self.whole, self.part, self.bound = self.whole + self.part.astype(object), np.zeros_like(self.part), 0
        self.part += values(np.int64)
        self.bound += most

    def rows(self, names: list[tuple[int, int]]) -> pa.RecordBatch:
        out: list[tuple[int, int, int, int]] = []
        for (i, j), value in zip(names, (self.whole + self.part.astype(object)).tolist()):
            sign, value, digit = (-1 if value < 0 else 1), abs(value), 0
            while value:
                out.append((i, j, digit, sign * (value & ((1 << DIGITS) - 1))))
                value, digit = value >> DIGITS, digit + 1
        columns = list(zip(*out)) or [[], [], [], []]
        kinds = [pa.int32(), pa.int32(), pa.int32(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["i", "j", "digit", "value"])


def _added(rows: DataFrame) -> dict[tuple[int, int], int]:
    """Sums by name: some rows per pair of dimensions, whatever the number of rows added."""
    got = rows.groupBy("i", "j", "digit").agg(F.sum("value").alias("value")).toArrow().to_pydict()
    out: dict[tuple[int, int], int] = {}
    for i, j, digit, value in zip(*(got[c] for c in ("i", "j", "digit", "value"))):
        out[i, j] = out.get((i, j), 0) + (value << (DIGITS * digit))
    return out


def _pieces(batches: Batches, dims: int) -> Iterator[np.ndarray]:
    for batch in batches:
        rows = as_matrix(batch.column("x"), dims, np.int64)
        for start in range(0, len(rows), SLICE):
            yield rows[start : start + SLICE]


def _plain_sums(dims: int) -> Callable[[Batches], Batches]:
    def task(batches: Batches) -> Batches:
        total = Total(dims)
        for x in _pieces(batches, dims):
            total.add(_largest(x) * len(x), lambda kind, x=x: x.astype(kind).sum(axis=0))
        yield total.rows([(i, i) for i in range(dims)])

    return task


def _square_sums(dims: int, centre: list[int]) -> Callable[[Batches], Batches]:
    """Squares of each dimension (i, i) and of the sum of each pair (i, j)."""
    names = [(i, j) for i in range(dims) for j in range(i, dims)]

    def squares(y: np.ndarray, kind: type) -> np.ndarray:
        columns = np.ascontiguousarray(y.T.astype(kind))
        out = []
        for i in range(dims):
            values = columns[i:] + columns[i]
            values[0] = columns[i]  # the dimension by itself
            out.append((values * values).sum(axis=1))
        return np.concatenate(out)

    def task(batches: Batches) -> Batches:
        total = Total(len(names))
        for x in _pieces(batches, dims):
            y = centred(x, centre)
            total.add((2 * _largest(y)) ** 2 * len(y), lambda kind, y=y: squares(y, kind))
        yield total.rows(names)

    return task


def polarised_covariance(n: int, rest: list[int], squares: dict[tuple[int, int], int]) -> np.ndarray:
    """Covariance from the sums of squares; each entry is rounded once, at the end.

    ``n`` times a sum of squares less the square of what is left of the mean is n * n variances.
    """
    dims = len(rest)
    own = [n * squares.get((i, i), 0) - rest[i] ** 2 for i in range(dims)]
    out = np.empty((dims, dims))
    for i in range(dims):
        out[i, i] = own[i] / n**2
        for j in range(i + 1, dims):
            both = n * squares.get((i, j), 0) - (rest[i] + rest[j]) ** 2
            out[i, j] = out[j, i] = (both - own[i] - own[j]) / (2 * n**2)
    return out


def _projected(model: Whitening, x: np.ndarray) -> np.ndarray:
    """Whitened values, one column per component; NaN where the eigenvalue is zero."""
    away = centred(x, model.centre).astype(float) - np.array([r / model.n for r in model.rest])
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(model.full_rank(), away @ model.components.T / np.sqrt(model.eigenvalues), np.nan)


def _products(model: Whitening) -> Callable[[Batches], Batches]:
    """Sums (i, -1) of whitened values and (i, j) of their products; the mean is already taken off."""
    dims, kept = len(model.sums), np.nonzero(model.full_rank())[0]

    def task(batches: Batches) -> Batches:
        total, products = np.zeros(len(kept)), np.zeros((len(kept), len(kept)))
        for x in _pieces(batches, dims):
            w = _projected(model, x)[:, kept]
            total, products = total + w.sum(axis=0), products + w.T @ w
        found = [(i, -1, float(total[i])) for i in range(len(kept))] + [(i, j, float(products[i, j])) for i in range(len(kept)) for j in range(len(kept))]
        columns = list(zip(*found)) or [[], [], []]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.int32(), pa.int32(), pa.float64()))], ["i", "j", "value"])

    return task


def _identity_error(fit_list: DataFrame, model: Whitening) -> float | None:
    """Largest entry of the covariance of the whitened fit list less the identity."""
    rows = fit_list.mapInArrow(_products(model), "i int, j int, value double").groupBy("i", "j").agg(F.sum("value").alias("value"))
    got = {(r["i"], r["j"]): r["value"] / model.n for r in rows.collect()}  # components squared
    off = [abs(v - got[i, -1] * got[j, -1] - (i == j)) for (i, j), v in got.items() if j >= 0]
    return max(off) if off else None


def _whole(rows: DataFrame) -> DataFrame:
    return rows.select("id", F.transform("v", lambda e: F.floor(F.lit(float(SCALE)) * e.cast("double"))).alias("x"))


def fit_whitening(table: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = 4) -> Whitening | None:
    """Fitted on each distinct whole-number vector once; None where no vector is usable."""
    rows, dims = clean_vectors(table, id_col, vector_col)
    if not dims:
        return None
    fit_list = settle(_whole(rows).select("x").distinct(), "whitening-fit")
    n = fit_list.count()
    plain = _added(fit_list.mapInArrow(_plain_sums(dims), _SUMS))
    sums = [plain.get((i, i), 0) for i in range(dims)]
    start = Whitening(n, sums, np.zeros((0, 0)), np.zeros((0, dims)), np.zeros(0), 0.0)
    squares = _added(fit_list.mapInArrow(_square_sums(dims, start.centre), _SUMS))
    covariance = polarised_covariance(n, start.rest, squares)
    values, vectors = np.linalg.eigh(covariance)
    top = np.argsort(values)[::-1][:components]
    model = Whitening(n, sums, covariance, vectors[:, top].T.copy(), values[top], float(np.trace(covariance)))
    model.identity_error = _identity_error(fit_list, model)
    return model


def _whitened(model: Whitening) -> Callable[[Batches], Batches]:
    dims, count, n = len(model.sums), len(model.components), model.n
    rest = np.array(model.rest, dtype=object)
    explained = [float(max(e, 0.0) / model.trace) if model.trace > 0 else None for e in model.eigenvalues]

    def deviations(x: np.ndarray) -> list[int | None]:
        y = centred(x, model.centre)
        fits = dims * (n * _largest(y) + max(map(abs, model.rest))) ** 2 < 2**63
        z = n * y - rest.astype(np.int64) if fits else n * y.astype(object) - rest
        return [v if v < 2**63 else None for v in (z * z).sum(axis=1).tolist()]

    def task(batches: Batches) -> Batches:
        for whole in batches:
            for start in range(0, whole.num_rows, SLICE):
                batch = whole.slice(start, SLICE)
                x = as_matrix(batch.column("x"), dims, np.int64)
                size, w = len(x), _projected(model, x)
                per_row = np.repeat(np.arange(size), count)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("id").take(pa.array(per_row)),
                        pa.array(np.tile(np.arange(1, count + 1, dtype=np.int32), size)),
                        pa.array(np.full(size * count, n)),
                        pa.array(deviations(x), pa.int64()).take(pa.array(per_row)),
                        pa.array(w.ravel(), pa.float64(), mask=np.isnan(w.ravel())),
                        pa.array(explained * size, pa.float64()),
                        pa.array([model.identity_error] * (size * count), pa.float64()),
                    ],
                    ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
                )

    return task


def whiten(table: DataFrame, model: Whitening | None, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """One row per usable vector and component: ``vec_id``, ``component`` (from 1), ``n``,
    ``deviation``, ``whitened``, ``explained``, ``identity_error``.

    Rows with a null or empty vector, or one with null or non-finite entries, are left out, and so
    are vectors of another length than most (see ``clean_vectors``). A null id stays; repeated
    rows each give rows. Entries beyond the range of a long are read as its ends. ``deviation`` is null where it does not fit a
    long. A component without variance has a null ``whitened`` and no share in
    ``identity_error``, which is null if no component varies; ``explained`` is null where nothing
    varies. An empty table gives no rows. Other columns are not read.
    """
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    if model is None:
        return table.sparkSession.createDataFrame([], schema)
    rows, _ = clean_vectors(table, id_col, vector_col, dims=len(model.sums))
    return _whole(rows).mapInArrow(_whitened(model), schema)
