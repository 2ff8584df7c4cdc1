"""Helpers shared by the Arrow functions of this package."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute  # noqa: F401  (as pa.compute)
from pyspark.sql import DataFrame

BATCH_BYTES = "4m"


def texts_of(column: pa.Array | pa.ChunkedArray) -> list[str]:
    """Python strings of a text column; null is the empty text."""
    return [t if t is not None else "" for t in column.to_pylist()]


def by_bytes(sizes: list[int], limit: int) -> Iterator[tuple[int, int]]:
    """Consecutive index ranges whose sizes sum to ``limit`` at most (one item may exceed it alone)."""
    start = total = 0
    for i, n in enumerate(sizes):
        if i > start and total + n > limit:
            yield start, i
            start, total = i, 0
        total += n
    if start < len(sizes):
        yield start, len(sizes)


def slices(batches: Iterator[pa.RecordBatch], text: int, limit: int) -> Iterator[pa.RecordBatch]:
    """Re-cuts record batches so that column ``text`` holds about ``limit`` characters in each."""
    for batch in batches:
        lengths = pa.compute.binary_length(batch.column(text)).fill_null(0).to_pylist()
        for a, b in by_bytes(lengths, limit):
            yield batch.slice(a, b - a)


def in_arrow(df: DataFrame, function, schema) -> DataFrame:
    """mapInArrow with batches of up to BATCH_BYTES instead of 10,000 rows, however long these are, so
    that neither side of the pipe holds many long texts at once. All Arrow functions of this package go
    through here; the setting stays in the session, as a plan reads it when it runs."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    return df.mapInArrow(function, schema)
