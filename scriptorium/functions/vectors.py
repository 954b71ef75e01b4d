"""Column functions over vectors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column | str, b: Column | str) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0).cast("double"), lambda total, x: total + x)


def cosine(a: Column | str, b: Column | str) -> Column:
    """Null for a zero vector, unequal lengths or missing numbers."""
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def is_usable(vector: Column | str, width: int = 64) -> Column:
    """Exactly ``width`` finite numbers, not all zero; false for null."""
    vector = F.col(vector) if isinstance(vector, str) else vector
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce((F.size(vector) == width) & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def vector_score(similarity: Column) -> Column:
    """Q02: 1 / (1 + cosine distance)."""
    return F.lit(1.0) / (F.lit(2.0) - similarity)
