"""Vector columns: validation, rounding, distance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def rounded(v: Column | str, digits: int = 6) -> Column:
    """Components as doubles rounded to so many decimals; null stays null."""
    return F.transform(v, lambda x: F.round(x.cast("double"), digits))


def validated(df: DataFrame, column: str, dim: int) -> DataFrame:
    """The column rounded; a vector of another width fails the query, a null one passes."""
    fits = F.col(column).isNull() | (F.size(column) == dim)
    checked = F.when(F.assert_true(fits, F.concat(F.lit(f"{column}: expected {dim} components, got "), F.size(column).cast("string"))).isNull(), rounded(column))
    return df.withColumn(column, checked)


def dot(a: Column | str, b: Column | str) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda s, x: s + x)


def norm(a: Column | str) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine_distance(a: Column | str, b: Column | str, norm_a: Column | None = None, norm_b: Column | None = None) -> Column:
    """1 - cosine; null if either is a zero vector."""
    size = (norm_a if norm_a is not None else norm(a)) * (norm_b if norm_b is not None else norm(b))
    return 1 - dot(a, b) / F.nullif(size, F.lit(0.0))
