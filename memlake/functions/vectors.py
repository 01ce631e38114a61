"""Vector expressions, JVM-side."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    """0 for unlike lengths or a zero vector; null for a null vector."""
    n = norm(a) * norm(b)
    return F.when((F.size(a) != F.size(b)) | (n == 0), 0.0).otherwise(dot(a, b) / n)


def cosine_normed(a: Column, na: Column, b: Column, nb: Column) -> Column:
    """Cosine with norms worked out once for each row."""
    n = na * nb
    return F.when((F.size(a) != F.size(b)) | (n == 0), 0.0).otherwise(dot(a, b) / n)


def relevance(similarity: Column) -> Column:
    """-1..1 to 0..1."""
    return F.round((similarity + 1) / 2, 4)
