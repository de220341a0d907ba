"""Arithmetic on embeddings, in double precision on the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(doubles(a), doubles(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(doubles(v), F.lit(0.0), lambda s, x: s + x * x))


def cosine_distance(a: Column, b: Column, norm_a: Column | None = None, norm_b: Column | None = None) -> Column:
    """1 minus the cosine, between 0 and 2; 1 where a vector has no length. Norms may be given when known."""
    na, nb = norm(a) if norm_a is None else norm_a, norm(b) if norm_b is None else norm_b
    cosine = F.least(F.greatest(dot(a, b) / (na * nb), F.lit(-1.0)), F.lit(1.0))
    return F.when((na == 0) | (nb == 0), F.lit(1.0)).otherwise(1 - cosine)


def parse_vector(text: Column) -> Column:
    """A JSON array of numbers; null where it is none."""
    return F.from_json(text, "array<float>")
