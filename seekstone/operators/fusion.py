"""Normalizing scores and merging rankings, per query.

A ranking is a table ``(query_id, chunk_id, score[, rank])``; ties that a merge leaves are broken by chunk id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from seekstone.operators.lexical import top
from seekstone.schema import FusionStrategy, coerce

EPS = 1e-12
RRF_K = 60


def minmax(df: DataFrame, column: str = "score", by: str = "query_id") -> DataFrame:
    """``column`` scaled to 0..1 within each query; 1 everywhere where all are equal."""
    bounds = df.groupBy(by).agg(F.min(column).alias("_lo"), F.max(column).alias("_hi"))
    spread = F.col("_hi") - F.col("_lo")
    scaled = F.when(spread < EPS, F.lit(1.0)).otherwise((F.col(column) - F.col("_lo")) / spread)
    return df.join(bounds, by).withColumn(column, scaled).drop("_lo", "_hi")


def zscore(df: DataFrame, column: str = "score", by: str = "query_id") -> DataFrame:
    """``column`` with mean 0 and (population) deviation 1 within each query; 0 everywhere where all are equal."""
    bounds = df.groupBy(by).agg(F.avg(column).alias("_mean"), F.stddev_pop(column).alias("_sd"))
    scaled = F.when(F.col("_sd") < EPS, F.lit(0.0)).otherwise((F.col(column) - F.col("_mean")) / F.col("_sd"))
    return df.join(bounds, by).withColumn(column, scaled).drop("_mean", "_sd")


def _scaled(ranking: DataFrame) -> DataFrame:
    """:func:`minmax` for rankings cut to some k: a window over a query's few rows, which lie together already."""
    own = Window.partitionBy("query_id")
    lo, hi = F.min("score").over(own), F.max("score").over(own)
    return ranking.withColumn(
        "score", F.when(hi - lo < EPS, F.lit(1.0)).otherwise((F.col("score") - lo) / (hi - lo))
    )


def _sum(parts: list[DataFrame], carry: tuple[str, ...]) -> DataFrame:
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.unionByName(p)
    return whole.groupBy("query_id", "chunk_id").agg(F.sum("score").alias("score"), *[F.max(c).alias(c) for c in carry])


def rrf(
    rankings: list[DataFrame], k: int = RRF_K, weights: list[float] | None = None, carry: tuple[str, ...] = ()
) -> DataFrame:
    """Reciprocal rank fusion: the sum of ``weight / (k + rank)``; a missing weight is 1, a missing entry adds nothing.
    Columns named by ``carry`` are kept: of each pair the value that isn't null."""
    if k <= 0:
        raise ValueError(f"k must be above 0, not {k!r}.")
    given = list(weights or [])
    parts = []
    for n, ranking in enumerate(rankings):
        weight = float(given[n]) if n < len(given) else 1.0
        parts.append(ranking.select("query_id", "chunk_id", (F.lit(weight) / (k + F.col("rank"))).alias("score"), *carry))
    return _sum(parts, carry)


def linear(rankings: list[DataFrame], alphas: list[float | Column], carry: tuple[str, ...] = ()) -> DataFrame:
    """The sum of ``alpha * score``, each ranking (cut to some k) scaled to 0..1 first; ``carry`` as in :func:`rrf`."""
    if len(rankings) != len(alphas):
        raise ValueError(f"There are {len(rankings)} rankings but {len(alphas)} weights.")
    parts = []
    for ranking, alpha in zip(rankings, alphas):
        weight = alpha if isinstance(alpha, Column) else F.lit(float(alpha))
        parts.append(_scaled(ranking).select("query_id", "chunk_id", (weight * F.col("score")).alias("score"), *carry))
    return _sum(parts, carry)


def fuse(
    rankings: list[DataFrame],
    strategy: FusionStrategy | str = FusionStrategy.RRF,
    alpha: float = 0.5,
    rrf_k: int = RRF_K,
    weights: list[float] | None = None,
    carry: tuple[str, ...] = (),
) -> DataFrame:
    """One ranking of several, with ranks: by score, then by chunk id.  ``alpha``: the weight of the first (linear only)."""
    if coerce(FusionStrategy, strategy) is FusionStrategy.RRF:
        fused = rrf(rankings, rrf_k, weights, carry)
    else:
        if not 0 <= alpha <= 1:
            raise ValueError(f"alpha must be from 0 to 1, not {alpha!r}.")
        fused = linear(rankings, [alpha, 1 - alpha], carry)
    return top(fused, [F.round("score", 12).desc(), F.col("chunk_id")], 1 << 30)
