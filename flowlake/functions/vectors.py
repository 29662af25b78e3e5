"""Array arithmetic."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(left: Column, right: Column) -> Column:
    products = F.zip_with(left, right, lambda a, b: a.cast("double") * b.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x)


def norm(vector: Column) -> Column:
    return F.sqrt(dot(vector, vector))


def vector_sum(vector: Column, size: int) -> Column:
    """Element-wise sum over rows, as an aggregate that combines map-side."""
    return F.array(*[F.sum(vector[i].cast("double")) for i in range(size)])


def add_up(columns: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, columns)
