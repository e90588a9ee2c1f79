"""Vectors as Spark columns: symmetric 8-bit quantisation and cosine similarity."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _doubles(v: Column) -> Column:
    return F.transform(v, lambda x: x.cast("double"))


def scale_of(v: Column) -> Column:
    """The largest absolute value over 127; 0 for a zero or empty vector."""
    return F.coalesce(F.array_max(F.transform(_doubles(v), F.abs)), F.lit(0.0)) / F.lit(127.0)


def quantize(v: Column) -> Column:
    """struct<scale, q>: each value in steps of the scale, half to even, within -127..127."""
    s = scale_of(v)
    q = F.transform(_doubles(v), lambda x: F.when(s > 0, F.greatest(F.lit(-127.0), F.least(F.lit(127.0), F.bround(x / s)))).otherwise(F.lit(0.0)).cast("tinyint"))
    return F.when(v.isNotNull(), F.struct(s.alias("scale"), q.alias("q")))


def dequantize(p: Column) -> Column:
    return F.transform(p["q"], lambda x: x.cast("double") * p["scale"])


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity in double precision; null where a vector is null or zero."""
    n = norm(a) * norm(b)
    return F.when(n > 0, dot(a, b) / n)
