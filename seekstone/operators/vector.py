"""Exact and approximate search in a table of vectors ``(chunk_id, embedding, seq)``.

A single query is an expression over the table and a top-k that Spark keeps per task.  A batch of queries is a matrix product
per Arrow batch, a tile of scores at a time: the queries travel to the tasks in blocks of checked size, each task keeps its own
k best, and only these are shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from seekstone.errors import VectorStoreError
from seekstone.functions.vectors import EPS, SCORES
from seekstone.operators.best import BLOCK_HITS, Best, gathered
from seekstone.operators.lexical import top

#: Numbers in a block of queries that travels to every task (32 MB in double precision).
BLOCK_NUMBERS = 4_000_000
#: Scores, or distances to centres, that are held at once.
TILE = 1_000_000
#: What a task gives, with the type of chunk ids.
FOUND = "query_id bigint, chunk_id {}, score double, seq bigint, k int"


def check_dimension(dim: int) -> None:
    if isinstance(dim, bool) or not isinstance(dim, int) or dim <= 0:
        raise VectorStoreError(f"The dimension must be a whole number above 0, not {dim!r}.")


def as_matrix(vectors, dim: int) -> np.ndarray:
    """A matrix of ``dim`` columns; a single vector is one row."""
    m = np.ascontiguousarray(vectors, dtype=np.float32)
    if m.ndim == 1:
        m = m.reshape(1, -1)
    if m.ndim != 2:
        raise VectorStoreError(f"Vectors must be one or a matrix of them, not of shape {m.shape}.")
    if m.shape[1] != dim:
        raise VectorStoreError(f"Vectors must have {dim} numbers, not {m.shape[1]}.")
    return m


def knn(vectors: DataFrame, query: list[float], metric: str, k: int) -> DataFrame:
    """``(chunk_id, score, seq)`` of the k best for one query; of equal scores the first indexed.  k of 0 or less: none."""
    score = SCORES[metric](F.col("embedding"), F.array(*[F.lit(float(x)) for x in query]))
    ranked = vectors.select("chunk_id", score.alias("score"), "seq")
    return ranked.orderBy(F.round("score", 9).desc(), "seq").limit(max(k, 0))


def _scores(metric: str, q: np.ndarray, x: np.ndarray) -> np.ndarray:
    if metric == "inner_product":
        return q @ x.T
    if metric == "cosine":
        nq, nx = np.linalg.norm(q, axis=1), np.linalg.norm(x, axis=1)
        return (q @ x.T) / (np.where(nq > EPS, nq, 1.0)[:, None] * np.where(nx > EPS, nx, 1.0)[None, :])
    squares = (q * q).sum(1)[:, None] + (x * x).sum(1)[None, :] - 2.0 * (q @ x.T)
    return 1.0 / (1.0 + np.maximum(squares, 0.0))


def _add(best: Best, metric: str, q: np.ndarray, asks: np.ndarray, batch: pa.RecordBatch) -> None:
    """Score the vectors of a batch ``(chunk_id, embedding, seq)`` for the queries at ``asks``, as many scores at once as a tile
    holds.  ``q`` is :func:`_ready`."""
    x = _ready(metric, batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(batch), -1))
    seq, base = batch.column(2).to_numpy(), best.rows(batch.column(0))
    for b in range(0, len(x), TILE):
        part = x[b : b + TILE]
        step = max(1, TILE // len(part))
        for a in range(0, len(asks), step):
            some = asks[a : a + step]
            s = _scores("inner_product" if metric == "cosine" else metric, q[some], part)
            least, most = best.bound[some], int(best.ks[some].max())
            if len(part) > most and np.isneginf(least).any():
                # everything not below the k-th best, so that ties are left to the final order
                least = np.maximum(least, np.partition(s, len(part) - most, axis=1)[:, len(part) - most] - 1e-9)
            row, col = np.nonzero(s >= least[:, None])
            best.add(some[row], s[row, col], seq[b + col], base + b + col)


def _near(batches: Iterator[pa.RecordBatch], names: np.ndarray, q: np.ndarray, ks: np.ndarray, metric: str) -> Iterator[pa.RecordBatch]:
    """Vectors ``(chunk_id, embedding, seq)`` -> of each query the ``ks`` best of these."""
    best, everyone = Best(ks), np.arange(len(names))
    for batch in batches:
        if len(batch):
            _add(best, metric, q, everyone, batch)
    yield from best.batches(names)


def _blocks(queries: DataFrame, k: int | str, each: int = 1) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Ids, vectors and k of the queries that ask for something, a block at a time, never all; those of another length go into
    another block.  ``each``: numbers that come to each query besides its vector."""
    wanted = queries.select("query_id", "qvec", (F.col(k) if isinstance(k, str) else F.lit(k)).cast("int").alias("k"))
    ids, held, ks, hits = [], [], [], 0
    for row in wanted.filter("qvec IS NOT NULL AND k > 0").sort(F.size("qvec"), "k").toLocalIterator():
        vector = np.array(row["qvec"], np.float64)
        if held and (
            len(vector) != len(held[0]) or len(held) * max(len(vector), each) >= BLOCK_NUMBERS or hits + row["k"] > BLOCK_HITS
        ):
            yield np.array(ids, np.int64), np.stack(held), np.array(ks, np.int64)
            ids, held, ks, hits = [], [], [], 0
        ids.append(row["query_id"])
        held.append(vector)
        ks.append(row["k"])
        hits += row["k"]
    if held:
        yield np.array(ids, np.int64), np.stack(held), np.array(ks, np.int64)


def _ranked(vectors: DataFrame, parts: list[DataFrame]) -> DataFrame:
    """``(query_id, chunk_id, score, seq, rank)`` of what the tasks found."""
    if not parts:
        kind = dict(vectors.dtypes)["chunk_id"]
        return vectors.sparkSession.createDataFrame(
            [], f"query_id bigint, chunk_id {kind}, score double, seq bigint, rank int"
        )
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return top(out, [F.round("score", 9).desc(), F.col("seq")], F.col("k")).drop("k")


def knn_batch(vectors: DataFrame, queries: DataFrame, metric: str, k: int | str) -> DataFrame:
    """``(query_id, chunk_id, score, seq, rank)``: the k best vectors of each query (``query_id``, ``qvec``), exactly.  ``k``: a
    number, or a column of ``queries``.

    Vectors without the query's number of numbers, or null, take no part.  k of 0 or less gives no row."""
    kind, parts = dict(vectors.dtypes)["chunk_id"], []
    for names, q, ks in _blocks(queries, k):
        shared = vectors.sparkSession.sparkContext.broadcast((names, _ready(metric, q), ks))
        usable = gathered(vectors.filter(F.size("embedding") == q.shape[1]).select("chunk_id", "embedding", "seq"), int(ks.sum()))
        parts.append(
            usable.mapInArrow(
                lambda batches, shared=shared: _near(batches, *shared.value, metric), FOUND.format(kind)
            )
        )
    return _ranked(vectors, parts)


@dataclass
class CellModel:
    """Centres of cells, fitted on a bounded sample, and in how many of them a query is looked for."""

    centres: np.ndarray
    probes: int

    def route(self, x: np.ndarray, most: int) -> np.ndarray:
        """The nearest cells of each row, the nearest first; as many distances at once as a tile holds."""
        own, step = (self.centres * self.centres).sum(1)[None, :], max(1, TILE // len(self.centres))
        out = np.empty((len(x), min(most, len(self.centres))), np.int32)
        for a in range(0, len(x), step):
            distance = own - 2.0 * (x[a : a + step] @ self.centres.T)
            if most == 1:
                out[a : a + step, 0] = distance.argmin(axis=1)
            else:
                out[a : a + step] = np.argsort(distance, axis=1, kind="stable")[:, :most]
        return out


def _ready(metric: str, x: np.ndarray) -> np.ndarray:
    """What cells are made of: for cosine, unit vectors."""
    if metric != "cosine":
        return x
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.where(norm > EPS, norm, 1.0)


def fit_cells(vectors: DataFrame, metric: str, sample: int = 20_000, cover: float = 0.995, rounds: int = 8, seed: int = 7) -> CellModel:
    """About sqrt(n) cells; one for a few thousand vectors, which are searched exactly then.

    ``sample``: the most vectors that are looked at on the driver; ``cover``: the share of the sample's own ten nearest that
    the cells looked into hold."""
    n = vectors.count()
    cells = int(min(n**0.5, sample / 16)) if n >= 4_000 else 1
    if cells < 2:
        return CellModel(np.zeros((1, 1)), 1)
    lot = F.pmod(F.xxhash64("chunk_id"), F.lit(1 << 30)) < int(min(1.0, sample / n) * (1 << 30))
    rows = vectors.filter(lot).select("chunk_id", "embedding").toPandas().sort_values("chunk_id")  # about ``sample``
    x = _ready(metric, np.stack(rows["embedding"]).astype(np.float64))
    centres = x[np.random.default_rng(seed).choice(len(x), min(cells, len(x)), replace=False)]
    for _ in range(rounds):
        nearest = CellModel(centres, 1).route(x, 1)[:, 0]
        size = np.bincount(nearest, minlength=len(centres))
        sums = np.stack([np.bincount(nearest, column, minlength=len(centres)) for column in x.T], axis=1)
        centres = np.where(size[:, None] > 0, sums / np.maximum(size, 1)[:, None], centres)
    model = CellModel(centres, 1)
    nearest, asked = model.route(x, 1)[:, 0], x[:: max(1, len(x) // 256)]
    true = np.concatenate([np.argsort(-_scores(metric, some, x), axis=1)[:, :10] for some in np.array_split(asked, 8)])
    rank = (model.route(asked, len(centres))[:, None, :] == nearest[true][:, :, None]).argmax(axis=2)
    reached = np.cumsum(np.bincount(rank.ravel(), minlength=len(centres))) >= cover * rank.size
    model.probes = int(np.argmax(reached)) + 1
    return model


def in_cells(vectors: DataFrame, model: CellModel, metric: str) -> DataFrame:
    """``(chunk_id, embedding, seq, cell)``, in order of cells, so that a few cells prune the scan."""
    kind = dict(vectors.dtypes)["chunk_id"]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if len(b):
                x = b.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(b), -1)
                cell = model.route(_ready(metric, x), 1)[:, 0] if len(model.centres) > 1 else np.zeros(len(b), np.int64)
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cell, pa.int32())], ["chunk_id", "embedding", "seq", "cell"])

    placed = vectors.select("chunk_id", "embedding", "seq").mapInArrow(
        place, f"chunk_id {kind}, embedding array<float>, seq bigint, cell int"
    )
    return placed.repartitionByRange("cell", "seq").sortWithinPartitions("cell", "seq")


def _near_in_cells(batches: Iterator[pa.RecordBatch], names: np.ndarray, q: np.ndarray, ks: np.ndarray, asks: np.ndarray, cuts: np.ndarray, metric: str) -> Iterator[pa.RecordBatch]:
    """Vectors ``(chunk_id, embedding, seq, cell)`` -> of each query the ``ks`` best of these in the cells it is looked for in;
    ``asks[cuts[c] : cuts[c + 1]]``: the queries of a cell."""
    best = Best(ks)
    for batch in batches:
        cell = batch.column(3).to_numpy()
        for one in np.unique(cell):
            mine = asks[cuts[one] : cuts[one + 1]]
            if len(mine):
                _add(best, metric, q, mine, batch.take(pa.array(np.flatnonzero(cell == one))))
    yield from best.batches(names)


def approximate_batch(placed: DataFrame, model: CellModel, queries: DataFrame, metric: str, k: int | str) -> DataFrame:
    """``(query_id, chunk_id, score, seq, rank)``: about the k best of each query, from the cells it is looked for in.  Scores are
    exact.  ``k``: a number, or a column of ``queries``.  With one cell it is :func:`knn_batch`."""
    vectors = placed.select("chunk_id", "embedding", "seq", "cell")
    if len(model.centres) < 2:
        return knn_batch(vectors, queries, metric, k)
    kind, dim = dict(placed.dtypes)["chunk_id"], model.centres.shape[1]
    parts = []
    for names, q, ks in _blocks(queries.filter(F.size("qvec") == dim), k, model.probes):
        q = _ready(metric, q)
        routes = model.route(q, model.probes)
        flat = routes.ravel()
        order = np.argsort(flat, kind="stable")
        cuts = np.searchsorted(flat[order], np.arange(len(model.centres) + 1))
        asks = (order // routes.shape[1]).astype(np.int32)
        shared = placed.sparkSession.sparkContext.broadcast((names, q, ks, asks, cuts))
        wanted = np.unique(flat)
        rows = vectors.filter(F.col("cell").isin(wanted.tolist())) if len(wanted) < len(model.centres) // 2 else vectors
        parts.append(
            gathered(rows, int(ks.sum())).mapInArrow(
                lambda batches, shared=shared: _near_in_cells(batches, *shared.value, metric), FOUND.format(kind)
            )
        )
    return _ranked(placed, parts)
