"""Vector kernels as Column expressions, in double precision."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _c(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def dot(a: str | Column, b: str | Column) -> Column:
    """Inner product; null if either is null."""
    return F.aggregate(F.zip_with(_c(a), _c(b), lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def norm(a: str | Column) -> Column:
    return F.sqrt(F.aggregate(_c(a), F.lit(0.0), lambda s, v: s + v.cast("double") * v.cast("double")))


def cosine(a: str | Column, b: str | Column, eps: str = "guard") -> Column:
    """Cosine. ``guard``: 0 if a norm is 0; ``prod``: 1e-10 added to the product of the norms; ``each``: to each norm."""
    na, nb = norm(a), norm(b)
    if eps == "guard":
        return F.when((na == 0) | (nb == 0), F.lit(0.0)).otherwise(dot(a, b) / (na * nb))
    if eps == "prod":
        return dot(a, b) / (na * nb + 1e-10)
    return dot(a, b) / ((na + 1e-10) * (nb + 1e-10))


def unit(a: str | Column) -> Column:
    """Divided by its norm (plus 1e-10)."""
    n = norm(a) + 1e-10
    return F.transform(_c(a), lambda x: x.cast("double") / n)


def minus(a: str | Column, b: str | Column) -> Column:
    return F.zip_with(_c(a), _c(b), lambda x, y: x.cast("double") - y.cast("double"))


def centroids(df: DataFrame, keys: list[str], vector: str, name: str = "centroid") -> DataFrame:
    """Normalised mean of normalised vectors per group; partial sums by dimension, never a whole group in one task."""
    parts = df.select(*keys, F.posexplode(unit(vector)).alias("dim", "x")).groupBy(*keys, "dim").agg(F.avg("x").alias("x"))
    whole = parts.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("dim", "x"))).alias("c"))  # one entry a dimension
    return whole.select(*keys, unit(F.transform("c", lambda e: e["x"])).alias(name))
