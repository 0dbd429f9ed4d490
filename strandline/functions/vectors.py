"""Vector expressions. Sums run in double precision, left to right; no vector, a zero vector or another length gives null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """[JOIN-5, TOP-1] Cosine similarity."""
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(F.size(a) == F.size(b), F.try_divide(dot(a, b), norms))


def unit(a: Column) -> Column:
    """The vector at length 1, so that a dot product is the cosine; null for a zero vector."""
    norm = F.sqrt(dot(a, a))
    return F.when(norm > 0, F.transform(a, lambda x: x.cast("double") / norm))


def round_half_even(x: Column, digits: int = 4) -> Column:
    """[SCL-14] The double nearest to the value of x, as it is in binary, rounded to ``digits`` decimals; ties, which only values that are exact
    have, go to the even one. Spark's own functions round the shortest decimal of x instead. For |x| < 2^52 / 10^digits; null, NaN
    and what is larger stay as they are."""
    power = float(10**digits)
    # x = high + low with at most 26 bits each, so both products are exact and error is what the product of x has lost
    wide = x * 134217729.0
    high = wide - (wide - x)
    product = x * power
    error = (high * power - product) + (x - high) * power
    near = F.rint(product)
    off = product - near
    step = F.when((off == 0.5) & (error > 0), 1.0).when((off == -0.5) & (error < 0), -1.0).otherwise(0.0)
    # rint has taken the even one where the product, not x, is a tie
    return F.when(F.abs(product) < 2.0**52, (near + step) / power).otherwise(x)
