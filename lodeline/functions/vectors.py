"""Vector functions as columns: JVM-side, in double. A length mismatch gives null unless stated."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Norms up to this count as zero.
TINY = 1e-10


def as_double(v: Column) -> Column:
    return v.cast("array<double>")


def _sum(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda a, x: a + x)


def dot(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(as_double(a), as_double(b), lambda x, y: x * y))


def l2_norm(v: Column) -> Column:
    return F.sqrt(_sum(F.transform(as_double(v), lambda x: x * x)))


def cosine_score(a: Column, b: Column) -> Column:
    """(1 + cosine) / 2. Two zero vectors score 1, a zero and another 0.5; different lengths 0; null gives null."""
    na, nb = l2_norm(a), l2_norm(b)
    inside = F.when((na == 0) & (nb == 0), F.lit(1.0)).when((na == 0) | (nb == 0), F.lit(0.5)).otherwise((1 + F.try_divide(dot(a, b), na * nb)) / 2)
    return F.when(a.isNull() | b.isNull(), F.lit(None).cast("double")).when(F.size(a) != F.size(b), F.lit(0.0)).otherwise(inside)


def raw_cosine(a: Column, b: Column) -> Column:
    """The cosine; 0 where a norm is at most TINY."""
    na, nb = l2_norm(a), l2_norm(b)
    return F.when((na > TINY) & (nb > TINY), F.try_divide(dot(a, b), na * nb)).otherwise(F.lit(0.0))


def cosine_distance(a: Column, b: Column) -> Column:
    """1 - cosine; 1 where a norm is zero."""
    n = l2_norm(a) * l2_norm(b)
    return F.when(n > 0, 1 - F.try_divide(dot(a, b), n)).otherwise(F.lit(1.0))


def sq_l2(a: Column, b: Column) -> Column:
    """Squared Euclidean distance; different lengths give 0."""
    d = _sum(F.zip_with(as_double(a), as_double(b), lambda x, y: (x - y) * (x - y)))
    return F.when(F.size(a) == F.size(b), d).otherwise(F.lit(0.0))


def l2(a: Column, b: Column) -> Column:
    return F.sqrt(sq_l2(a, b))


def l2_normalize(v: Column) -> Column:
    """Of norm 1; unchanged where the norm is at most TINY."""
    n = l2_norm(v)
    return F.when(n > TINY, F.transform(as_double(v), lambda x: F.try_divide(x, n))).otherwise(as_double(v))


def subvector(v: Column, m: int, width: int) -> Column:
    return F.slice(v, m * width + 1, width)


def to_distance(similarity: Column) -> Column:
    return 1 - similarity
