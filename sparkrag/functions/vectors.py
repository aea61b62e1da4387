"""Similarities of float arrays, in double precision. For many queries against many vectors, see operators.vector_index."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Added to the product of norms, so that a zero vector has similarity zero.
EPSILON = 1e-8
METRICS = ("cosine", "dot", "euclidean")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (norm(a) * norm(b) + EPSILON)


def negative_distance(a: Column, b: Column) -> Column:
    squares = F.zip_with(a, b, lambda x, y: F.pow(x.cast("double") - y.cast("double"), F.lit(2.0)))
    return -F.sqrt(F.aggregate(squares, F.lit(0.0), lambda s, v: s + v))


def similarity(metric: str, a: Column, b: Column) -> Column:
    if metric not in METRICS:
        raise ValueError(f"unknown distance metric {metric!r}; known: {', '.join(METRICS)}")
    return {"cosine": cosine, "dot": dot, "euclidean": negative_distance}[metric](a, b)
