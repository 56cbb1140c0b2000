"""Vector arithmetic on array columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Distances are compared after rounding to this many digits, so that equal vectors tie
# (and fall back to their id) whatever order their products were added up in.
DIGITS = 9


def dot(a: Column, b: Column) -> Column:
    """Inner product in double precision; null if the lengths differ."""
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda total, x: total + x)


def norm(a: Column) -> Column:
    return F.sqrt(
        F.aggregate(a, F.lit(0.0), lambda total, x: total + x.cast("double") * x.cast("double"))
    )


def literal(vector: Sequence[float]) -> Column:
    return F.array(*[F.lit(float(x)) for x in vector])


def cosine_distance(a: Column, vector: Sequence[float]) -> Column:
    """1 - cosine similarity to a fixed vector; null for zero or unfit vectors."""
    length = sum(float(x) ** 2 for x in vector) ** 0.5
    scale = F.nullif(norm(a) * F.lit(length), F.lit(0.0))
    return F.round(F.lit(1.0) - dot(a, literal(vector)) / scale, DIGITS)
