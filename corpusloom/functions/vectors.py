"""Vector expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusloom.functions.columns import ColumnLike, col


def dot(a: ColumnLike, b: ColumnLike) -> Column:
    return F.aggregate(
        F.zip_with(col(a), col(b), lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x
    )


def cosine(a: ColumnLike, b: ColumnLike, on_mismatch: Column | None = None) -> Column:
    """Cosine similarity of one pair; 0 for empty vectors or zero norms, ``on_mismatch`` (0) for unequal lengths."""
    left, right = col(a), col(b)
    norm = F.sqrt(dot(left, left)) * F.sqrt(dot(right, right))
    mismatch = F.lit(0.0) if on_mismatch is None else on_mismatch
    return (
        F.when(F.size(left) != F.size(right), mismatch)
        .when((F.size(left) == 0) | (norm == 0), F.lit(0.0))
        .otherwise(dot(left, right) / norm)
    )
