"""Arithmetic over fixed lists of feature columns, unrolled so that it stays in generated code."""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column
from pyspark.sql import functions as F


def total(terms: list[Column]) -> Column:
    return reduce(add, terms)


def dot(a: list[Column], b: list[Column]) -> Column:
    return total([x * y for x, y in zip(a, b, strict=True)])


def norm(a: list[Column]) -> Column:
    return F.sqrt(dot(a, a))


def euclidean(a: list[Column], b: list[Column]) -> Column:
    return F.sqrt(total([(x - y) * (x - y) for x, y in zip(a, b, strict=True)]))


def cosine(a: list[Column], b: list[Column], norm_a: Column, norm_b: Column) -> Column:
    """Cosine similarity; a zero vector is similar to nothing (0)."""
    size = norm_a * norm_b
    return F.when(size == 0, F.lit(0.0)).otherwise(dot(a, b) / size)


def zscore(c: Column, mean: float, std: float) -> Column:
    """Standardise with a population deviation; a constant column is only centred."""
    return (c.cast("double") - F.lit(mean)) / F.lit(std if std != 0 else 1.0)
