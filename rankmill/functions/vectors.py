"""Vector arithmetic on array columns, and feature hashing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    """Inner product over the shorter length, in double."""
    n = F.least(F.size(a), F.size(b))
    pairs = F.zip_with(F.slice(a, 1, n), F.slice(b, 1, n), lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(pairs, F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def l2_normalize(a: Column) -> Column:
    """Unit vector in double; the zero vector stays."""
    n = norm(a)
    return F.transform(a, lambda x: F.when(n > 0, x.cast("double") / n).otherwise(x.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    n = norm(a) * norm(b)
    return F.when(n > 0, dot(a, b) / n).otherwise(F.lit(0.0))


def is_finite(a: Column) -> Column:
    return ~F.exists(a, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))


def feature_index(feature: Column, dim: int) -> Column:
    """First 16 bits of the feature's SHA-1, modulo dim."""
    return (F.conv(F.substring(F.sha1(feature), 1, 4), 16, 10).cast("int") % dim).cast("int")


def feature_sign(feature: Column) -> Column:
    """1 or -1 by the parity of the third byte of the SHA-1."""
    return F.when(F.conv(F.substring(F.sha1(feature), 6, 1), 16, 10).cast("int") % 2 == 0, 1.0).otherwise(-1.0)


def trigrams(terms: Column) -> Column:
    """Three-letter pieces of the terms joined by spaces between ^ and $."""
    s = F.concat(F.lit("^"), F.array_join(terms, " "), F.lit("$"))
    return F.when(F.length(s) >= 3, F.transform(F.sequence(F.lit(1), F.length(s) - 2), lambda i: F.substring(s, i, F.lit(3)))).otherwise(F.array().cast("array<string>"))
