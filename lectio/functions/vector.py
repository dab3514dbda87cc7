"""Vector column expressions (V1 in expression form).

Spark 4.1 has no vector-similarity built-in; these use higher-order functions and stay
JVM-side. They are the small-input form; the corpus-scale form is the block kernel in
``lectio.operators.knn``."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import col_


def _sum(arr: Column) -> Column:
    return F.aggregate(arr, F.lit(0.0), lambda acc, x: acc + x)


def as_double_array(v: str | Column) -> Column:
    return F.transform(col_(v), lambda x: x.cast("double"))


def dot(a: str | Column, b: str | Column) -> Column:
    return _sum(F.zip_with(as_double_array(a), as_double_array(b), lambda x, y: x * y))


def norm(a: str | Column) -> Column:
    return F.sqrt(_sum(F.transform(as_double_array(a), lambda x: x * x)))


def cosine(a: str | Column, b: str | Column, mismatch: str = "zero") -> Column:
    """V1: ``dot / (|a| |b|)``; a zero norm gives 0. Length mismatch gives 0
    (classifier rule) or null (``mismatch='null'``, the store raises instead)."""
    a, b = col_(a), col_(b)
    denom = norm(a) * norm(b)
    value = F.when(denom == 0, F.lit(0.0)).otherwise(dot(a, b) / denom)
    bad = F.lit(0.0) if mismatch == "zero" else F.lit(None).cast("double")
    return F.when(F.size(a) != F.size(b), bad).otherwise(value)


def unit(v: str | Column) -> Column:
    """Unit-length copy (doubles); the zero vector stays zero."""
    n = norm(v)
    return F.transform(as_double_array(v), lambda x: F.when(n == 0, F.lit(0.0)).otherwise(x / n))
