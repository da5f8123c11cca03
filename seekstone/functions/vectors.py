"""Vectors as Spark expressions, accumulated in double precision."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

#: Norms up to this count as zero.
EPS = 1e-12


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def l2_normalize(v: Column) -> Column:
    """Unit length; a vector of zeros stays as it is."""
    n = norm(v)
    return F.when(n > EPS, F.transform(v, lambda x: (x / n).cast("float"))).otherwise(v.cast("array<float>"))


def cosine(a: Column, b: Column) -> Column:
    """0 where either vector is zero."""
    na, nb = norm(a), norm(b)
    return dot(a, b) / (F.when(na > EPS, na).otherwise(1.0) * F.when(nb > EPS, nb).otherwise(1.0))


def l2_score(a: Column, b: Column) -> Column:
    """``1 / (1 + squared distance)``."""
    squares = F.zip_with(a, b, lambda x, y: F.pow(x.cast("double") - y.cast("double"), F.lit(2.0)))
    return 1.0 / (1.0 + F.aggregate(squares, F.lit(0.0), lambda s, x: s + x))


#: Higher is better for each.
SCORES = {"cosine": cosine, "inner_product": dot, "l2": l2_score}


def distance_to_score(metric: str, distance: Column) -> Column:
    """The score that a native distance stands for: 1 - cosine, the negated product, the squared Euclidean distance."""
    if metric == "cosine":
        return 1.0 - distance
    if metric == "inner_product":
        return -distance
    if metric == "l2":
        return 1.0 / (1.0 + distance)
    raise ValueError(f"Unknown metric {metric!r}; known: {list(SCORES)}")
