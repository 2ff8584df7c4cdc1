"""Vectors as arrays of numbers; sums are in double."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(left: Column, right: Column) -> Column:
    """Over the shorter length; 0 if either is null or empty."""
    n = F.least(F.size(left), F.size(right))
    products = F.zip_with(F.slice(left, F.lit(1), n), F.slice(right, F.lit(1), n), lambda a, b: a.cast("double") * b.cast("double"))
    return F.when(left.isNull() | right.isNull() | (n <= 0), 0.0).otherwise(F.aggregate(products, F.lit(0.0), lambda s, x: s + x))


def normalised(vector: Column) -> Column:
    """Divided by its length; the zero vector stays."""
    norm = F.sqrt(F.aggregate(vector, F.lit(0.0), lambda s, x: s + x * x))
    return F.transform(vector, lambda x: F.when(norm > 0, x / norm).otherwise(0.0))


def vector_score(query: Column, row: Column) -> Column:
    """Similarity in 0..1; 0 where either vector is missing or empty."""
    there = (F.size(F.coalesce(query, F.array().cast("array<double>"))) > 0) & (F.size(F.coalesce(row.cast("array<double>"), F.array().cast("array<double>"))) > 0)
    return F.when(there, F.greatest(F.lit(0.0), F.least(F.lit(1.0), (dot(query, row) + 1) / 2))).otherwise(0.0)
