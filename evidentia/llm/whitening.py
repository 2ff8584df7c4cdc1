"""Whitening of embeddings by a compensated covariance.

1. Vectors go onto a grid: entry c becomes the integer x = floor(scale * c) + offset, so sums are exact.
2. The mean is kept as an integer, a fraction and the fraction's rest, and each entry is centred without
   error into a high and a low part. A task adds up outer products in double-double: the rows of a block
   are cut into slices of so few bits that the matrix products of slices are exact (an error-free
   transformation of the product), and these are added by error-free sums. The high and low parts of
   all tasks are merged in the same way, first among a few tasks and then in one.
3. The covariance is reduced to tridiagonal form and solved by divide and conquer (LAPACK's syevd).
4. Rows are projected; the covariance of what comes out is added up in the same way, as a check.

What is gathered is two matrices of the vectors' dimension for each task, whatever the number of rows.

Edge cases: a null vector, one with a null or non-finite entry, and one with an entry that has no exact place on
the grid (2^52 or more) are dropped; so are vectors of another length than the commonest (of two as
common, the longer). Components without variance (as of equal rows) are left out; with none left, or
an empty table, there are no rows. Repeated rows and ids count one by one, null ids stay. A deviation
that no long holds is null. Other columns are never read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidentia.llm.batches import in_arrow

#: Rows of one exact matrix product, and the bits of a slice: 2 * BITS + log2(ROWS) is at most 53.
ROWS, BITS = 256, 22
EXACT = 2.0**52
SPREAD = 32


@dataclass(frozen=True)
class Whitening:
    """n rows were fitted; the mean is base + high + low; ``axes`` has a column for each component."""

    n: int
    sums: tuple[int, ...]
    base: np.ndarray
    high: np.ndarray
    low: np.ndarray
    values: np.ndarray
    axes: np.ndarray
    trace: float


def _fits(entry: Column, scale: float) -> Column:
    return entry.isNotNull() & ~F.isnan(entry.cast("double")) & (F.abs(F.lit(float(scale)) * entry.cast("double")) < EXACT)


def usable(vector: Column, scale: float) -> Column:
    return F.coalesce(F.forall(vector, lambda c: _fits(c, scale)), F.lit(False))


def on_grid(vector: Column, scale: float, offset: int) -> Column:
    """Places of the entries; null for those that have none."""
    return F.transform(vector, lambda c: F.when(_fits(c, scale), F.floor(F.lit(float(scale)) * c.cast("double")) + F.lit(offset).cast("bigint")))


def two_sum(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """a + b and its rounding error."""
    s = a + b
    t = s - a
    return s, (a - (s - t)) + (b - t)


class Doubled:
    """A matrix in double-double."""

    def __init__(self, high: np.ndarray, low: np.ndarray | None = None):
        self.high, self.low = high, np.zeros_like(high) if low is None else low

    def add(self, high: np.ndarray, low: np.ndarray | float = 0.0) -> None:
        s, e = two_sum(self.high, high)
        self.high, self.low = two_sum(s, e + (self.low + low))


def outer(total: Doubled, high: np.ndarray, low: np.ndarray) -> None:
    """Adds the rows' outer products, of rows high + low, to ``total``."""
    for a in range(0, len(high), ROWS):
        top = high[a : a + ROWS]
        _, power = np.frexp(np.abs(top).max(axis=0))
        one = np.ldexp(1.0, power - BITS)
        first = np.rint(top / one) * one
        rest = top - first
        two = np.ldexp(one, -BITS)
        second = np.rint(rest / two) * two
        third = (rest - second) + low[a : a + ROWS]
        total.add(first.T @ first)
        mixed = first.T @ second
        total.add(mixed)
        total.add(mixed.T)
        total.add(second.T @ second)
        small = (first + second).T @ third
        total.add(small + small.T + third.T @ third)


def _rows_of(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def _batch(total: Doubled) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([total.high.ravel()]), pa.array([total.low.ravel()])], names=["high", "low"])


def _summed(parts: DataFrame, width: int) -> np.ndarray:
    """The merged matrix: parts of tasks meet in SPREAD tasks, and what these have in one."""

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, some = Doubled(np.zeros((width, width))), False
        for batch in batches:
            for high, low in zip(_rows_of(batch.column(0), width * width), _rows_of(batch.column(1), width * width), strict=True):
                total.add(high.reshape(width, width), low.reshape(width, width))
                some = True
        if some:
            yield _batch(total)

    found = parts
    for tasks in (SPREAD, 1):
        found = in_arrow(found.repartition(tasks), merged, "high array<double>, low array<double>")
    row = found.first()
    return Doubled(np.array(row.high).reshape(width, width), np.array(row.low).reshape(width, width))


def _outer_products(df: DataFrame, width: int, rows) -> DataFrame:
    """(high, low) of each task's sum of outer products; ``rows`` makes the two parts of a batch."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, some = Doubled(np.zeros((width, width))), False
        for batch in batches:
            if batch.num_rows:
                outer(total, *rows(batch.column(0)))
                some = True
        if some:
            yield _batch(total)

    return in_arrow(df, partial, "high array<double>, low array<double>")


def _centred(x: np.ndarray, model: Whitening) -> tuple[np.ndarray, np.ndarray]:
    high, error = two_sum((x - model.base).astype(np.float64), -model.high)
    return high, error - model.low


def _vectors(df: DataFrame, vec_col: str, scale: float, offset: int, width: int | None = None) -> DataFrame:
    own = df.where(usable(F.col(vec_col), scale)).withColumn(vec_col, on_grid(F.col(vec_col), scale, offset))
    return own if width is None else own.where(F.size(vec_col) == width)


def fit(df: DataFrame, vec_col: str = "embedding", scale: float = 64, offset: int = 1_000_000, most: int = 32) -> Whitening | None:
    """The mean and up to ``most`` components of all usable vectors; None if there is none with variance."""
    kept = _vectors(df.select(vec_col), vec_col, scale, offset)
    sizes = kept.groupBy(F.size(vec_col).alias("width")).count().orderBy(F.desc("count"), F.desc("width")).first()
    if sizes is None or not sizes["width"]:
        return None
    width, n = sizes["width"], sizes["count"]
    kept = kept.where(F.size(vec_col) == width)
    sums = {r.at: r.s for r in kept.select(F.posexplode(vec_col).alias("at", "x")).groupBy("at").agg(F.sum("x").alias("s")).collect()}
    sums = tuple(int(sums[i]) for i in range(width))
    parts = [Fraction(s % n, n) for s in sums]
    high = np.array([float(p) for p in parts])
    low = np.array([float(p - Fraction(h)) for p, h in zip(parts, high.tolist(), strict=True)])
    model = Whitening(n, sums, np.array([s // n for s in sums], np.int64), high, low, np.zeros(0), np.zeros((width, 0)), 0.0)
    total = _summed(_outer_products(kept, width, lambda column: _centred(_rows_of(column, width), model)), width)
    covariance = total.high / n + total.low / n
    values, axes = np.linalg.eigh((covariance + covariance.T) / 2)
    values, axes = values[::-1], axes[:, ::-1]
    trace = float(np.trace(covariance))
    some = int(np.sum(values[:most] > trace * width * 2.0**-50))
    return Whitening(n, sums, model.base, high, low, values[:some].copy(), axes[:, :some].copy(), trace) if some else None


def project(x: np.ndarray, model: Whitening) -> np.ndarray:
    high, low = _centred(x, model)
    return (high @ model.axes + low @ model.axes) / np.sqrt(model.values)


def deviations(x: np.ndarray, model: Whitening) -> list[int | None]:
    """Sum of (n * x - sums)^2 over the dimensions, exactly."""
    reach = max(int(np.abs(x - model.base).max(initial=0)) + 1, 1) * model.n
    if reach * reach * x.shape[1] < 1 << 63:
        return (((x - model.base) * model.n - np.array([s % model.n for s in model.sums])) ** 2).sum(axis=1).tolist()
    exact = [sum((model.n * v - s) ** 2 for v, s in zip(row, model.sums, strict=True)) for row in x.tolist()]
    return [d if d < 1 << 63 else None for d in exact]


def whiten(df: DataFrame, model: Whitening, id_col: str = "vec_id", vec_col: str = "embedding", scale: float = 64, offset: int = 1_000_000) -> DataFrame:
    """(id, deviation, whitened array<double>) of the usable vectors, by the grid that the model was fitted on."""
    width = len(model.sums)

    def projected(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _rows_of(batch.column(1), width)
            flat = project(x, model)
            ends = pa.array(np.arange(0, flat.size + 1, flat.shape[1]), pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(deviations(x, model), pa.int64()), pa.ListArray.from_arrays(ends, pa.array(flat.ravel()))], names=[id_col, "deviation", "whitened"])

    kept = _vectors(df.select(id_col, vec_col), vec_col, scale, offset, width)
    return in_arrow(kept, projected, f"`{id_col}` {kept.schema[id_col].dataType.simpleString()}, deviation bigint, whitened array<double>")


def identity_error(df: DataFrame, model: Whitening, vec_col: str = "embedding", scale: float = 64, offset: int = 1_000_000) -> float:
    """The largest absolute entry of the whitened vectors' covariance minus the identity, over all rows."""
    width, k = len(model.sums), len(model.values)

    def rows(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        white = np.column_stack([project(_rows_of(column, width), model), np.ones(len(column))])
        return white, np.zeros_like(white)

    total = _summed(_outer_products(_vectors(df.select(vec_col), vec_col, scale, offset, width), k + 1, rows), k + 1)
    products = (total.high + total.low) / model.n
    return float(np.abs(products[:k, :k] - np.outer(products[k, :k], products[k, :k]) - np.eye(k)).max())


def whitened_components(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", scale: float = 64, offset: int = 1_000_000, most: int = 32) -> DataFrame:
    """A row for each usable vector and component: id, component, n, deviation, whitened, explained, identity_error."""
    model = fit(df, vec_col, scale, offset, most)
    kind = df.schema[id_col].dataType.simpleString()
    if model is None:
        return df.sparkSession.createDataFrame([], f"`{id_col}` {kind}, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double")
    shares = F.array(*[F.lit(float(v / model.trace)) for v in model.values])
    error = identity_error(df, model, vec_col, scale, offset)
    own = whiten(df, model, id_col, vec_col, scale, offset).select(id_col, "deviation", F.posexplode("whitened").alias("__at", "whitened"))
    return own.select(
        id_col, (F.col("__at") + 1).alias("component"), F.lit(model.n).cast("bigint").alias("n"), "deviation", "whitened",
        F.get(shares, F.col("__at")).alias("explained"), F.lit(error).alias("identity_error"),
    )
