"""Distances between array columns; smaller is nearer under every metric.

These run on the JVM and suit a single literal query or pairs already joined.
Whole-corpus neighbour joins use :mod:`nearmark.operators.knn`.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from nearmark.schema import COSINE, DOTPRODUCT, EUCLIDEAN, check_metric


def _doubles(v: Column | str) -> Column:
    col = F.col(v) if isinstance(v, str) else v
    return col.cast("array<double>")


def _total(arr: Column) -> Column:
    return F.aggregate(arr, F.lit(0.0), lambda acc, x: acc + x)


def literal_vector(values: Sequence[float]) -> Column:
    return F.array(*[F.lit(float(x)) for x in values])


def dot(a: Column | str, b: Column | str) -> Column:
    return _total(F.zip_with(_doubles(a), _doubles(b), lambda x, y: x * y))


def norm(v: Column | str) -> Column:
    return F.sqrt(_total(F.transform(_doubles(v), lambda x: x * x)))


def euclidean(a: Column | str, b: Column | str) -> Column:
    return F.sqrt(
        _total(F.zip_with(_doubles(a), _doubles(b), lambda x, y: (x - y) * (x - y)))
    )


def negative_dot(a: Column | str, b: Column | str) -> Column:
    return -dot(a, b)


def cosine(a: Column | str, b: Column | str) -> Column:
    """``1 - cos``; NaN for a zero vector, which Spark sorts last."""
    similarity = F.try_divide(dot(a, b), norm(a) * norm(b))
    return F.coalesce(1 - similarity, F.lit(float("nan")))


_BY_NAME = {COSINE: cosine, EUCLIDEAN: euclidean, DOTPRODUCT: negative_dot}


def distance(metric: str, a: Column | str, b: Column | str) -> Column:
    return _BY_NAME[check_metric(metric)](a, b)
