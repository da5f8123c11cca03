"""Problem 2: the most similar vectors of every vector.

Learned partitions, in two levels, so that what one vector costs doesn't grow with the collection:

1. a sample's neighbour graph is partitioned in balance into *cells*, and a small classifier learns in which cells a vector's
   neighbours lie.  Cells grow in number with the collection.  A vector lives in its most probable cell and is looked for in the
   several most probable ones, to which it travels in full precision;
2. in the task that holds a cell, the same again: the graph of some of its vectors, *parts* of it, a classifier to parts.
   Parts have a fixed size, so their number grows with the cell.

How many cells, and how many parts of a cell, are looked into is measured, not set: some vectors are compared with all others, and the
least number is taken that covers the share ``COVER`` of what was found.  So data whose neighbours are easy to tell cost
little, and those whose neighbours are noise cost more instead of losing them.  Candidates are reranked where both vectors
are, in double precision.  Vectors that are equal count once: of each, the first k + 1 ids, as no others can be among anybody's
k first.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from seekstone.llm.partitions import Router, balanced_partition, fit_router, neighbour_graph
from seekstone.operators.vector import knn_batch
from seekstone.session import materialize, parallelism

#: Neighbours in the graphs.
GRAPH_K = 10
#: Vectors of a cell.
CELL_ROWS = 49_152
#: Vectors on which the cells' classifier is fitted: so many a cell, between these bounds.
CELL_SAMPLE, LEAST_SAMPLE, SAMPLE = 64, 4_096, 65_536
#: A cell of more vectors is cut into blocks, each with a task of its own.
BLOCK_ROWS = 131_072
#: Vectors of a cell on which its parts' classifier is fitted, at most; vectors of a part.
LOCAL_SAMPLE = 4_096
PART_ROWS = 512
#: Vectors that one task looks for, about.
TASK_QUERIES = 131_072
#: Vectors that are compared with all others to measure the number of cells, and with a whole cell for that of its parts.
MEASURED, LOCAL_MEASURED = 1_000, 256
#: Share of the neighbours that the cells looked into must cover, and the parts of these.
COVER = 0.97
#: The same where only close pairs are asked for; a pair is found from either side.  As few close pairs are measured, one cell more,
#: and at least a quarter of the parts, are looked into.
COVER_CLOSE = 0.995
#: Candidates beside the k best that are reranked; float32 products are this exact.
MARGIN, SLACK = 4, 2e-6
#: Scores held at once.
TILE = 8_000_000
BROADCAST_ROWS = 100_000
#: The same for vectors with a list of keys.
BROADCAST_COPIES = 10_000
_ODD = np.uint64(0x9E3779B97F4A7C15)


def _unit(column: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors, and which rows have one: ``dim`` numbers, all finite, not all zero."""
    sizes = column.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False)
    good = sizes == dim
    x = np.zeros((len(column), dim), dtype=np.float64)
    if good.any():
        x[good] = column.filter(pa.array(good)).flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
    norm = np.sqrt(np.einsum("ij,ij->i", x, x))
    good &= np.isfinite(norm) & (norm > 0)
    return (x / np.where(good, norm, 1.0)[:, None]).astype(np.float32), good


def _hash(x: np.ndarray) -> np.ndarray:
    h = np.zeros(len(x), np.uint64)
    for c in np.ascontiguousarray(x).view(np.uint32).T:
        h = (h ^ c) * _ODD
        h ^= h >> np.uint64(29)
    return h.view(np.int64)


def _mixed(rid: np.ndarray) -> np.ndarray:
    """Even bits of ids, for dealing."""
    return ((rid.astype(np.uint64) * _ODD) >> np.uint64(33)).astype(np.int64)


def _binary(rows: np.ndarray) -> pa.Array:
    """The rows of a matrix as binary values, without a copy a row."""
    rows = np.ascontiguousarray(rows)
    width = rows.itemsize * rows.shape[1]
    offsets = pa.py_buffer((np.arange(len(rows) + 1, dtype=np.int64) * width).astype(np.int32))
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, offsets, pa.py_buffer(rows)])


def _vectors(column: pa.Array | pa.ChunkedArray, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.float32).reshape(-1, dim)


_DISTINCT = "h bigint, vec binary, ids array<string>"


def _collapse(h: np.ndarray, vec: pa.Array, ids: pa.Array, most: int) -> Iterator[pa.RecordBatch]:
    """Equal vectors as one row with their least ids.  Rows whose hash nobody else has pass as they are."""
    _, inverse, times = np.unique(h, return_inverse=True, return_counts=True)
    alone = times[inverse.ravel()] == 1
    names = ["h", "vec", "ids"]
    at = pa.array(np.flatnonzero(alone))
    yield pa.RecordBatch.from_arrays([pa.array(h[alone]), vec.take(at), ids.take(at)], names)
    held: dict[bytes, list] = {}
    rest = np.flatnonzero(~alone)
    for i, v, more in zip(rest.tolist(), vec.take(pa.array(rest)).to_pylist(), ids.take(pa.array(rest)).to_pylist()):
        if v in held:
            held[v][1] = sorted({*held[v][1], *more})[:most]
        else:
            held[v] = [int(h[i]), more]
    if held:
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([v[0] for v in held.values()], pa.int64()),
                pa.array(list(held), pa.binary()),
                pa.array([v[1] for v in held.values()], pa.list_(pa.string())),
            ],
            names,
        )


def distinct_vectors(df: DataFrame, key: str, vector: str, dim: int, most: int) -> DataFrame:
    """``(rid, vec, ids)``: every different unit vector with the ``most`` least keys that have it, as a table."""

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, good = _unit(b.column(1), dim)
            at = np.flatnonzero(good)
            x, ids = x[at], b.column(0).take(pa.array(at)).cast(pa.string())
            one = pa.ListArray.from_arrays(pa.array(np.arange(len(at) + 1), pa.int32()), ids)
            yield from _collapse(_hash(x), _binary(x), one, most)

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if len(b)]  # a partition of the shuffle
        if held:
            t = pa.Table.from_batches(held).combine_chunks().to_batches()
            for b in t:
                for whole in _collapse(b.column(0).to_numpy(), b.column(1), b.column(2), most):
                    for a in range(0, len(whole), 10_000):
                        yield whole.slice(a, 10_000)

    rows = df.select(F.col(key).cast("string").alias("key"), F.col(vector).alias("vec")).filter(
        F.col("key").isNotNull() & (F.size("vec") == dim)
    )
    merged = rows.mapInArrow(first, _DISTINCT).repartition(parallelism(df.sparkSession), "h").mapInArrow(again, _DISTINCT)
    return materialize(merged.select(F.monotonically_increasing_id().alias("rid"), "vec", "ids"), "vectors")


# the first level: cells


@dataclass
class Index:
    """What tasks need: the classifier to cells and where their rows go.  Its size depends on the number of cells only."""

    dim: int
    cells: int = 1
    router: Router | None = None
    probes: int = 1
    salts: int = 1
    first: np.ndarray = field(default_factory=lambda: np.zeros(1, np.int64))
    blocks: np.ndarray = field(default_factory=lambda: np.ones(1, np.int64))

    @property
    def slots(self) -> int:
        return int(self.blocks.sum()) * self.salts

    def names(self) -> np.ndarray:
        """A number for each slot, such that a shuffle by it puts every slot into a partition of its own."""
        names, value = np.full(self.slots, -1, np.int64), 0
        while (names < 0).any():
            some = np.arange(value, value + 4 * self.slots, dtype=np.int64)
            at = _spark_hash(some) % self.slots
            first = np.unique(at, return_index=True)[1]
            first = first[names[at[first]] < 0]
            names[at[first]] = some[first]
            value += len(some)
        return names

    def route(self, x: np.ndarray, most: int) -> np.ndarray:
        """The most probable cells of each row, the best first."""
        if self.router is None:
            return np.zeros((len(x), 1), np.int64)
        return _top(self.router.logits(x), most)

    def own(self, x: np.ndarray) -> np.ndarray:
        return self.route(x, 1)[:, 0]


def _spark_hash(values: np.ndarray) -> np.ndarray:
    """Spark's hash of 32-bit integers (Murmur3 with the fixed seed 42)."""
    low = np.uint64(0xFFFFFFFF)

    def turned(x: np.ndarray, bits: int) -> np.ndarray:
        return ((x << np.uint64(bits)) | (x >> np.uint64(32 - bits))) & low

    k = (values.astype(np.uint64) * np.uint64(0xCC9E2D51)) & low
    k = (turned(k, 15) * np.uint64(0x1B873593)) & low
    h = (turned(np.uint64(42) ^ k, 13) * np.uint64(5) + np.uint64(0xE6546B64)) & low
    h ^= np.uint64(4)
    h = ((h ^ (h >> np.uint64(16))) * np.uint64(0x85EBCA6B)) & low
    h = ((h ^ (h >> np.uint64(13))) * np.uint64(0xC2B2AE35)) & low
    return (h ^ (h >> np.uint64(16))).astype(np.uint32).view(np.int32).astype(np.int64)


def _top(logits: np.ndarray, most: int) -> np.ndarray:
    """The columns of the ``most`` highest numbers of each row, the highest first; of equal ones the first."""
    most = min(most, logits.shape[1])
    if most == 1:
        return logits.argmax(axis=1)[:, None]
    if most < logits.shape[1]:
        top = np.sort(np.argpartition(-logits, most - 1, axis=1)[:, :most], axis=1)
        order = np.argsort(-np.take_along_axis(logits, top, 1), axis=1, kind="stable")
        return np.take_along_axis(top, order, 1)
    return np.argsort(-logits, axis=1, kind="stable")


def _enough(ranks: np.ndarray, cover: float, most: int) -> int:
    """The least number of first places that hold the share ``cover`` of ``ranks``."""
    if not len(ranks):
        return 1
    reached = np.cumsum(np.bincount(ranks, minlength=most)) >= cover * len(ranks) - 1e-9
    return int(np.argmax(reached)) + 1


def fit_index(vectors: DataFrame, dim: int, k: int, floor: float | None = None) -> Index:
    """Cells and the number of them to look into.  ``floor``: only pairs of at least this cosine are asked for."""
    spark = vectors.sparkSession
    n, index = vectors.count(), Index(dim)
    if n > 1.5 * CELL_ROWS:
        levels = max(1, int(np.round(np.log2(n / CELL_ROWS))))
        levels = min(levels, int(np.log2(SAMPLE / 16)))
        index.cells = 1 << levels
        rows = min(n, max(LEAST_SAMPLE, min(SAMPLE, CELL_SAMPLE * index.cells)))
        x = _drawn(vectors, rows / n, 0)[1]
        graph = neighbour_graph(x, GRAPH_K)
        part = balanced_partition(x, graph, levels)
        index.router = fit_router(x, graph, part, index.cells)
        index.first, index.blocks = np.arange(index.cells), np.ones(index.cells, np.int64)
        _measure(vectors, index, n, k, floor)
    travels = 1 + index.probes * n / index.cells / TASK_QUERIES
    index.salts = max(1, int(travels), -(-spark.sparkContext.defaultParallelism // int(index.blocks.sum())))
    return index


def _drawn(vectors: DataFrame, share: float, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """About this share of the vectors, by a hash of their ids; callers bound the number."""
    lot = F.pmod(F.xxhash64("rid", F.lit(seed)), F.lit(1 << 30))
    rows = vectors.filter(lot < int(share * (1 << 30))).select("rid", "vec").toPandas().sort_values("rid")
    width = len(rows["vec"].iloc[0]) // 4 if len(rows) else 1
    return rows["rid"].to_numpy(np.int64), np.frombuffer(b"".join(rows["vec"]), np.float32).reshape(-1, width)


def _measure(vectors: DataFrame, index: Index, n: int, k: int, floor: float | None) -> None:
    """Some vectors against all: in how many cells their neighbours lie.  The same pass counts the cells' rows."""
    ids, q = _drawn(vectors, MEASURED / n, 1)
    shared = vectors.sparkSession.sparkContext.broadcast((index, ids, q))
    least = -np.inf if floor is None else floor

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ix, ids, q = shared.value
        sizes = np.zeros(ix.cells, np.int64)
        found: list[tuple] = []
        bound = np.full(len(q), least, np.float32)
        for b in batches:
            y, rid = _vectors(b.column(1), ix.dim), b.column(0).to_numpy()
            cell = ix.own(y)
            sizes += np.bincount(cell, minlength=ix.cells)
            i, j, s = _above(q, y, bound, k + 1)
            other = ids[i] != rid[j]
            found.append((i[other], cell[j[other]], s[other]))
            if floor is None:
                found = [_shrink(found, k, bound)]
        some = np.flatnonzero(sizes)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.full(len(some), -1)), pa.array(some), pa.array(sizes[some].astype(np.float64))], ["q", "cell", "score"]
        )
        if found:
            i, cell, s = (np.concatenate(f) for f in zip(*found, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(cell), pa.array(s.astype(np.float64))], ["q", "cell", "score"])

    rows = vectors.select("rid", "vec").mapInArrow(run, "q bigint, cell bigint, score double")
    place = F.row_number().over(Window.partitionBy("q").orderBy(F.col("score").desc()))
    kept = rows.filter("q >= 0").withColumn("p", place).filter(F.col("p") <= k).select("q", "cell", "score")
    counted = rows.filter("q < 0").groupBy("q", "cell").agg(F.sum("score").alias("score"))
    got = kept.unionByName(counted).toPandas()  # k rows for each of about MEASURED, and one a cell
    sizes = np.zeros(index.cells, np.int64)
    own = got[got["q"] < 0]
    sizes[own["cell"]] = own["score"]
    index.blocks = np.maximum(1, -(-sizes // BLOCK_ROWS))
    index.first = np.cumsum(index.blocks) - index.blocks
    near = got[got["q"] >= 0]
    routes = index.route(q, index.cells)
    ranks = (routes[near["q"].to_numpy()] == near["cell"].to_numpy()[:, None]).argmax(axis=1)
    if floor is None:
        index.probes = _enough(ranks, COVER, index.cells)
    else:
        index.probes = min(index.cells, max(3, _enough(ranks, COVER_CLOSE, index.cells) + 1))


# looking for vectors among others


def _best(query: np.ndarray, ids: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
    """Of each query the k best, sorted: indices into the arrays, grouped by query."""
    order = np.lexsort((ids, -score, query))
    q = query[order]
    start = np.flatnonzero(np.r_[True, q[1:] != q[:-1]]) if len(q) else np.zeros(0, np.int64)
    rank = np.arange(len(q)) - np.repeat(start, np.diff(np.r_[start, len(q)]))
    return order[rank < k]


def _above(q: np.ndarray, y: np.ndarray, least: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(row of q, row of y, product)`` of the products above ``least``, and not below the k-th of the row."""
    rows, cols, scores = [], [], []
    step = max(1, TILE // max(1, len(y)))
    for a in range(0, len(q), step):
        s = q[a : a + step] @ y.T
        bound = least[a : a + step].copy()
        open_ = np.flatnonzero(np.isneginf(bound))
        if len(open_) and len(y) > k:  # nothing known yet: the k-th best bounds
            kth = np.partition(s[open_], len(y) - k, axis=1)[:, len(y) - k]
            bound[open_] = np.nextafter(kth, np.float32(-np.inf))
        i, j = np.nonzero(s > bound[:, None])
        rows.append(i + a)
        cols.append(j)
        scores.append(s[i, j])
    if not rows:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.float32)
    return np.concatenate(rows), np.concatenate(cols), np.concatenate(scores)


def _shrink(found: list[tuple], k: int, least: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best of each row; ``least`` rises to the last of those that have k."""
    row, ids, score = (np.concatenate(f) for f in zip(*found, strict=True))
    keep = _best(row, ids, score, k)
    row, ids, score = row[keep], ids[keep], score[keep]
    last = np.flatnonzero(np.r_[row[1:] != row[:-1], True]) if len(row) else np.zeros(0, np.int64)
    full = np.bincount(row, minlength=len(least))[row[last]] >= k if len(row) else np.zeros(0, bool)
    at = row[last[full]]
    least[at] = np.maximum(least[at], np.nextafter(score[last[full]], np.float32(-np.inf)))
    return row, ids, score


def _by_column(routes: np.ndarray) -> list[tuple[int, np.ndarray]]:
    """The rows of each part, parts in order."""
    rows = np.repeat(np.arange(len(routes)), routes.shape[1])
    order = np.argsort(routes.ravel(), kind="stable")
    values, start = np.unique(routes.ravel()[order], return_index=True)
    return list(zip(values.tolist(), np.split(rows[order], start[1:]), strict=True))


class Cell:
    """The vectors of a cell, in parts, and the classifier to them: the second level.  All of it is made in one task."""

    def __init__(self, x: np.ndarray, rid: np.ndarray, k: int, floor: float | None):
        self.k, self.floor = k, floor
        levels = int(np.floor(np.log2(max(1, len(x) / PART_ROWS))))
        self.parts = 1 << levels if levels > 1 else 1
        self.probes, self.measured = self.parts, False
        part = np.zeros(len(x), np.int64)
        if self.parts > 1:
            lot = np.argsort(_mixed(rid), kind="stable")[:LOCAL_SAMPLE]
            sample = x[lot]
            graph = neighbour_graph(sample, GRAPH_K)
            self.router = fit_router(sample, graph, balanced_partition(sample, graph, levels), self.parts, epochs=6)
            part = np.concatenate([self.router.logits(x[a : a + 8192]).argmax(axis=1) for a in range(0, len(x), 8192)])
        order = np.argsort(part, kind="stable")
        self.x, self.rid = x[order], rid[order]
        self.cuts = np.searchsorted(part[order], np.arange(self.parts + 1))
        self.part = part[order]

    def _measure(self, q: np.ndarray, qid: np.ndarray, least: np.ndarray) -> None:
        """The first vectors that are looked for are compared with the whole cell."""
        self.measured = True
        i, j, s = _above(q, self.x, least.copy(), self.k + 1)
        other = self.rid[j] != qid[i]
        i, j, s = i[other], j[other], s[other]
        keep = _best(i, j, s, self.k)
        routes = _top(self.router.logits(q), self.parts)
        ranks = (routes[i[keep]] == self.part[j[keep]][:, None]).argmax(axis=1)
        cover, few = (COVER, 4) if self.floor is None else (COVER_CLOSE, max(6, self.parts // 4))
        self.probes = min(self.parts, max(few, _enough(ranks, cover, self.parts)))

    def look(self, q: np.ndarray, qid: np.ndarray, least: np.ndarray):
        """``(row, id, score)``: what is above ``least``, at most k a row (all of it with a floor), in double precision."""
        bound = np.where(np.isfinite(least), least - SLACK, -np.inf).astype(np.float32)
        if self.parts > 1 and not self.measured and len(q):
            self._measure(q[:LOCAL_MEASURED], qid[:LOCAL_MEASURED], bound[:LOCAL_MEASURED])
        keep = self.k + MARGIN
        routes = _top(self.router.logits(q), self.probes) if self.parts > 1 else np.zeros((len(q), 1), np.int64)
        found: list[tuple] = []
        # the most probable part first, so that the least score is good early
        for some in (routes[:, :1], routes[:, 1:]) if self.floor is None and routes.shape[1] > 1 else (routes,):
            for part, rows in _by_column(some):
                a, b = self.cuts[part], self.cuts[part + 1]
                if a == b:
                    continue
                i, j, s = _above(q[rows], self.x[a:b], bound[rows], keep + 1)
                found.append((rows[i], a + j, s))
                if self.floor is None and sum(len(f[0]) for f in found) > 40 * keep * max(len(q), 1):
                    found = [self._others(found, qid)]
                    found = [_shrink(found, keep, bound)]
            if self.floor is None and found:
                found = [_shrink([self._others(found, qid)], keep, bound)]
        if not found:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        row, at, _ = self._others(found, qid)
        exact = np.empty(len(row))
        for a in range(0, len(row), 200_000):
            x, y = q[row[a : a + 200_000]].astype(float), self.x[at[a : a + 200_000]].astype(float)
            norms = np.einsum("ij,ij->i", x, x) * np.einsum("ij,ij->i", y, y)
            exact[a : a + 200_000] = np.einsum("ij,ij->i", x, y) / np.sqrt(norms)
        ids = self.rid[at]
        good = np.flatnonzero(exact >= least[row])
        best = good if self.floor is not None else good[_best(row[good], ids[good], exact[good], self.k)]
        return row[best], ids[best], exact[best]

    def _others(self, found: list[tuple], qid: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        row, at, s = (np.concatenate(f) for f in zip(*found, strict=True))
        other = self.rid[at] != qid[row]
        return row[other], at[other], s[other]


#: role: 0 a vector of the cell, 1 one that is looked for too, 2 one of another cell that is looked for here
_ROW = pa.schema([("slot", pa.int32()), ("role", pa.int8()), ("rid", pa.int64()), ("vec", pa.binary()), ("least", pa.float64())])
_ROW_SQL = "slot int, role tinyint, rid bigint, vec binary, least double"
_FOUND_SQL = "rid bigint, ids binary, scores binary"


def _placed(names, slot, role, rid, vec: pa.Array, at, least) -> Iterator[pa.RecordBatch]:
    for a in range(0, len(at), 20_000):
        cut = slice(a, a + 20_000)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(names[slot[cut]].astype(np.int32)),
                pa.array(np.broadcast_to(role, len(at))[cut].astype(np.int8)),
                pa.array(rid[at[cut]]),
                vec.take(pa.array(at[cut])),
                pa.array(least[at[cut]]),
            ],
            schema=_ROW,
        )


def _homes(batches: Iterator[pa.RecordBatch], index: Index, asks: bool) -> Iterator[pa.RecordBatch]:
    """(rid, vec) -> each vector in its cell, once for each salt; with ``asks`` it is looked for in one of them."""
    names = index.names()
    for b in batches:
        rid, x = b.column(0).to_numpy(), _vectors(b.column(1), index.dim)
        cell = index.own(x)
        block = index.first[cell] + _mixed(rid) % index.blocks[cell]
        at = np.repeat(np.arange(len(x)), index.salts)
        salt = np.tile(np.arange(index.salts), len(x))
        mine = (_mixed(rid + 1) % index.salts)[at] == salt
        yield from _placed(names, block[at] * index.salts + salt, mine & asks, rid, b.column(1), at, np.full(len(x), np.nan))


def _travels(batches: Iterator[pa.RecordBatch], index: Index) -> Iterator[pa.RecordBatch]:
    """(rid, vec, least) -> each vector to the other blocks of the cells to look into."""
    names = index.names()
    for b in batches:
        rid, x = b.column(0).to_numpy(), _vectors(b.column(1), index.dim)
        least = b.column(2).to_numpy(zero_copy_only=False)
        routes = index.route(x, index.probes)
        own = index.first[routes[:, 0]] + _mixed(rid) % index.blocks[routes[:, 0]]
        at = np.repeat(np.arange(len(x)), routes.shape[1])
        times = index.blocks[routes.ravel()]
        nth = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
        at, block = np.repeat(at, times), np.repeat(index.first[routes.ravel()], times) + nth
        away = block != own[at]
        at, block = at[away], block[away]
        slot = block * index.salts + (_mixed(rid + 1) % index.salts)[at]
        yield from _placed(names, slot, np.int8(2), rid, b.column(1), at, least)


def _look(batches: Iterator[pa.RecordBatch], dim: int, k: int, floor: float | None) -> Iterator[tuple]:
    """Rows sorted by slot and role -> (ids, vectors, row, id, score) for blocks of vectors looked for."""
    slot, cell, base, waiting = None, None, [], []

    def built() -> Cell:
        nonlocal cell, base
        if cell is None:
            t = pa.Table.from_batches(base)
            base = []
            x, rid = _vectors(t.column("vec"), dim), t.column("rid").to_numpy()
            asks = t.column("role").to_numpy() == 1
            order = np.argsort(rid)  # whatever order the shuffle brought
            cell = Cell(x[order], rid[order], k, floor)
            cell.asking = x[asks], rid[asks]
        return cell

    def own() -> Iterator[tuple]:
        if base:
            x, rid = built().asking
            for a in range(0, len(x), 8192):
                q, qid = x[a : a + 8192], rid[a : a + 8192]
                yield qid, q, *cell.look(q, qid, np.full(len(q), -np.inf if floor is None else floor))

    def others() -> Iterator[tuple]:
        nonlocal waiting
        if waiting and cell is not None:
            t = pa.Table.from_batches(waiting)
            q, qid, least = _vectors(t.column("vec"), dim), t.column("rid").to_numpy(), t.column("least").to_numpy()
            yield qid, q, *cell.look(q, qid, np.where(np.isnan(least), -np.inf if floor is None else floor, least))
        waiting = []

    for batch in batches:
        if not len(batch):
            continue
        slots, away = batch.column(0).to_numpy(), batch.column(1).to_numpy() == 2
        key = slots.astype(np.int64) * 2 + away
        a = 0
        for b in [*(np.flatnonzero(key[1:] != key[:-1]) + 1).tolist(), len(key)]:
            if slots[a] != slot:
                yield from own()
                yield from others()
                slot, cell, base = slots[a], None, []
            if away[a]:
                yield from own()
                waiting.append(batch.slice(a, b - a))
                if sum(map(len, waiting)) >= 8192:
                    yield from others()
            else:
                base.append(batch.slice(a, b - a))
            a = b
    yield from own()
    yield from others()


def _lists(rid: np.ndarray, row: np.ndarray, ids: np.ndarray, score: np.ndarray) -> tuple[pa.Array, pa.Array]:
    """Ids and scores of each row as binary; rows are grouped."""
    cuts = np.searchsorted(row, np.arange(len(rid) + 1)).astype(np.int32)
    offsets = pa.py_buffer(cuts * 8)

    def packed(values: np.ndarray) -> pa.Array:
        return pa.Array.from_buffers(pa.binary(), len(rid), [None, offsets, pa.py_buffer(np.ascontiguousarray(values))])

    return packed(ids.astype(np.int64)), packed(score.astype(np.float64))


def _found(batches: Iterator[pa.RecordBatch], dim: int, k: int, floor: float | None) -> Iterator[pa.RecordBatch]:
    for rid, _, row, ids, score in _look(batches, dim, k, floor):
        order = np.argsort(row, kind="stable")
        row, ids, score = row[order], ids[order], score[order]
        some = np.unique(row)
        lists = _lists(some, np.searchsorted(some, row), ids, score)
        yield pa.RecordBatch.from_arrays([pa.array(rid[some]), *lists], ["rid", "ids", "scores"])


def _found_at_home(batches: Iterator[pa.RecordBatch], dim: int, k: int) -> Iterator[pa.RecordBatch]:
    """The same with the vector, and the least score that still counts elsewhere."""
    for rid, q, row, ids, score in _look(batches, dim, k, None):
        order = np.argsort(row, kind="stable")
        row, ids, score = row[order], ids[order], score[order]
        least = np.full(len(rid), -np.inf)
        last = np.flatnonzero(np.r_[row[1:] != row[:-1], True]) if len(row) else np.zeros(0, np.int64)
        full = np.bincount(row, minlength=len(rid))[row[last]] >= k if len(row) else np.zeros(0, bool)
        least[row[last[full]]] = score[last[full]]
        for a in range(0, len(rid), 4096):
            b = min(a + 4096, len(rid))
            cut = slice(*np.searchsorted(row, [a, b]))
            lists = _lists(rid[a:b], row[cut] - a, ids[cut], score[cut])
            yield pa.RecordBatch.from_arrays(
                [pa.array(rid[a:b]), _binary(q[a:b]), pa.array(least[a:b]), *lists], ["rid", "vec", "least", "ids", "scores"]
            )


def _merge(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """Found neighbours, sorted by vector -> the k best of each."""
    for table in _whole_vectors(batches):
        rid = table.column("rid").to_numpy()
        lists = [np.frombuffer(x, np.int64) for x in table.column("ids").to_pylist()]
        scores = [np.frombuffer(x, np.float64) for x in table.column("scores").to_pylist()]
        owner = np.repeat(rid, [len(x) for x in lists])
        ids, score = np.concatenate(lists), np.concatenate(scores)
        keep = _best(owner, ids, score, k)
        yield from pa.table({"a": owner[keep], "b": ids[keep], "score": score[keep]}).to_batches(max_chunksize=50_000)


def _whole_vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    held = None
    for batch in batches:
        table = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
        rid = table.column("rid").to_numpy()
        changes = np.flatnonzero(rid[1:] != rid[:-1])
        if not len(changes) or len(rid) < 20_000:
            held = table
            continue
        cut = int(changes[-1]) + 1
        yield table.slice(0, cut)
        held = table.slice(cut)
    if held is not None and len(held):
        yield held


def _unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        lists = [np.frombuffer(x, np.int64) for x in b.column(1).to_pylist()]
        owner = np.repeat(b.column(0).to_numpy(), [len(x) for x in lists])
        other = np.concatenate([*lists, np.zeros(0, np.int64)])
        score = np.frombuffer(b"".join(b.column(2).to_pylist()), np.float64)
        low, high = np.minimum(owner, other), np.maximum(owner, other)
        yield pa.RecordBatch.from_arrays([pa.array(low), pa.array(high), pa.array(score)], ["a", "b", "score"])


def _in_slots(rows: DataFrame, index: Index) -> DataFrame:
    return rows.repartition(max(index.slots, 1), "slot").sortWithinPartitions("slot", "role", "rid")


def nearest(vectors: DataFrame, dim: int, k: int, index: Index | None = None) -> DataFrame:
    """``(a, b, score)``: for every distinct vector (column rid) its k most similar others, by cosine.

    Each is first looked for in its own cell; then, with the least score that still counts, in the others, from where little
    comes back."""
    spark = vectors.sparkSession
    index = index or fit_index(vectors, dim, k)
    shared = spark.sparkContext.broadcast(index)
    rows = vectors.select("rid", "vec")
    home = _in_slots(rows.mapInArrow(lambda b: _homes(b, shared.value, True), _ROW_SQL), index).mapInArrow(
        lambda b: _found_at_home(b, dim, k), "rid bigint, vec binary, least double, ids binary, scores binary"
    )
    found = home = materialize(home, "home")
    if index.probes > 1 or index.blocks.max() > 1:
        base = rows.mapInArrow(lambda b: _homes(b, shared.value, False), _ROW_SQL)
        away = home.select("rid", "vec", "least").mapInArrow(lambda b: _travels(b, shared.value), _ROW_SQL)
        more = _in_slots(base.unionByName(away), index).mapInArrow(lambda b: _found(b, dim, k, None), _FOUND_SQL)
        found = home.select("rid", "ids", "scores").unionByName(more)
    found = found.select("rid", "ids", "scores").repartition(parallelism(spark), "rid").sortWithinPartitions("rid")
    return found.mapInArrow(lambda b: _merge(b, k), "a bigint, b bigint, score double")


def close_pairs(vectors: DataFrame, dim: int, k: int, floor: float, index: Index | None = None) -> DataFrame:
    """``(a, b, score)``, a < b: pairs of distinct vectors with a cosine of at least ``floor``.

    The same index, looked into once: the least score that counts is known from the start, so nothing else comes back."""
    index = index or fit_index(vectors, dim, k, floor)
    shared = vectors.sparkSession.sparkContext.broadcast(index)
    rows = vectors.select("rid", "vec")
    placed = rows.mapInArrow(lambda b: _homes(b, shared.value, True), _ROW_SQL)
    if index.probes > 1 or index.blocks.max() > 1:
        free = rows.withColumn("least", F.lit(float("nan")))
        placed = placed.unionByName(free.mapInArrow(lambda b: _travels(b, shared.value), _ROW_SQL))
    found = _in_slots(placed, index).mapInArrow(lambda b: _found(b, dim, k, floor), _FOUND_SQL)
    pairs = found.mapInArrow(_unpacked, "a bigint, b bigint, score double")
    return pairs.groupBy("a", "b").agg(F.max("score").alias("score"))  # found from either side


def similar_vectors(df: DataFrame, key: str, vector: str, dim: int = 64, k: int = 10) -> DataFrame:
    """``(key, neighbour, score, place)``: for every row the k rows with the most similar vectors, by cosine.

    Vectors that are null, not of ``dim`` numbers, all zero, or hold a null, NaN or infinite number take no part; nor do
    rows without a key.  A key counts once.  Scores are exact, in double precision, of the unit vectors in single precision.  Of
    equal scores in a list the smaller key comes first; where different vectors tie for the last place, one of them is
    taken.  Approximate: neighbours in parts that aren't looked into are missed.  An empty table gives no row; other
    columns are ignored.
    """
    vectors = distinct_vectors(df, key, vector, dim, k + 1)
    near = materialize(nearest(vectors, dim, k), "near")
    rows = _rows_of(near, vectors, k, key)
    often = vectors.filter(F.size("ids") > k)  # all ids that there are, or more than are kept
    return rows if often.isEmpty() else rows.unionByName(_further_copies(df, key, vector, dim, k, often))


def _further_copies(df: DataFrame, key: str, vector: str, dim: int, k: int, often: DataFrame) -> DataFrame:
    """Rows whose vector k + 1 smaller keys have too: their neighbours are the first k of these."""

    def units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, good = _unit(b.column(1), dim)
            at = np.flatnonzero(good)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at)), _binary(x[at])], ["key", "vec"])

    rows = df.select(F.col(key).cast("string").alias("key"), F.col(vector).alias("vec")).filter(
        F.col("key").isNotNull() & (F.size("vec") == dim)
    )
    few = often.limit(BROADCAST_COPIES + 1).count() <= BROADCAST_COPIES
    often = often.select("vec", "ids")
    copies = rows.mapInArrow(units, "key string, vec binary").join(F.broadcast(often) if few else often, "vec")
    copies = copies.filter(~F.array_contains("ids", F.col("key"))).select("key", "ids").dropDuplicates(["key"])
    each = copies.select(F.col("key").alias(key), F.posexplode(F.slice("ids", 1, k)))
    return each.select(key, F.col("col").alias("neighbour"), F.lit(1.0).alias("score"), (F.col("pos") + 1).alias("place"))


def _rows_of(near: DataFrame, vectors: DataFrame, k: int, key: str) -> DataFrame:
    """Neighbours of distinct vectors -> neighbours of the rows that have them (of each vector its first k + 1 keys)."""
    ids = vectors.select(F.col("rid").alias("b"), F.col("ids").alias("theirs"))
    others = near.join(ids, "b").select("a", F.explode("theirs").alias("neighbour"), "score")
    own = vectors.filter(F.size("ids") > 1).select(
        F.col("rid").alias("a"), F.explode("ids").alias("neighbour"), F.lit(1.0).alias("score")
    )
    asked = vectors.select(F.col("rid").alias("a"), F.explode("ids").alias("key"))
    rows = asked.join(others.unionByName(own), "a").filter(F.col("key") != F.col("neighbour"))
    best = Window.partitionBy("key").orderBy(F.col("score").desc(), "neighbour")
    ranked = rows.withColumn("place", F.row_number().over(best)).filter(F.col("place") <= k)
    return ranked.select(F.col("key").alias(key), "neighbour", "score", "place")


def mutual_pairs(df: DataFrame, key: str, vector: str, least: float, dim: int = 64, k: int = 10) -> DataFrame:
    """``(a, b)``, the smaller key first: rows that are each among the other's k most similar, with a cosine of at
    least ``least``.  Cases as in :func:`similar_vectors`; of more than k + 1 rows with an equal vector only the first
    k + 1 can be in anybody's list."""
    vectors = distinct_vectors(df, key, vector, dim, k + 1)
    # all that rank before a close one are closer still, so lists of close ones are enough
    close = materialize(close_pairs(vectors, dim, k, least), "close")
    both = close.unionByName(close.select(F.col("b").alias("a"), F.col("a").alias("b"), "score"))
    # only vectors with a close one, or with copies, matter from here on
    some = both.select(F.col("a").alias("rid")).distinct()
    few = close.count() <= BROADCAST_ROWS
    paired = vectors.join(F.broadcast(some) if few else some, "rid", "left_semi").select("rid", "ids")
    copied = vectors.filter(F.size("ids") > 1).select("rid", "ids")
    held = materialize(paired.unionByName(copied).dropDuplicates(["rid"]), "held")
    rows = _rows_of(both, held, k, "key")
    pairs = rows.select(F.least("key", "neighbour").alias("a"), F.greatest("key", "neighbour").alias("b"))
    return pairs.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n")).filter("n = 2").select("a", "b")


def recall(df: DataFrame, key: str, vector: str, number: str, every: int, dim: int = 64, k: int = 10) -> DataFrame:
    """``(key, found, asked)`` for the rows whose ``number`` is divisible by ``every``: their k most similar rows are looked
    for in all rows by brute force; ``found`` of the ``asked`` places of :func:`similar_vectors` hold a row as similar."""
    one = df.filter(F.col(key).isNotNull() & (F.size(vector) == dim)).groupBy(F.col(key).cast("string").alias("chunk_id"))
    held = one.agg(F.first(vector).alias("embedding"), F.min(number).alias("seq"))
    norm = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    unit = F.transform("embedding", lambda x: (x.cast("double") / F.col("n")).cast("float"))
    usable = held.withColumn("n", norm).filter((F.col("n") > 0) & (F.col("n") < float("inf"))).withColumn("embedding", unit)
    usable = materialize(usable.drop("n"), "usable")
    asked = usable.filter(F.col("seq") % every == 0).select(F.col("seq").alias("query_id"), "chunk_id", F.col("embedding").alias("qvec"))
    near = knn_batch(usable, asked, "cosine", k + 1).select("query_id", F.col("chunk_id").alias("neighbour"), "score")
    near = near.join(asked.select("query_id", "chunk_id"), "query_id").filter("chunk_id <> neighbour")
    place = F.row_number().over(Window.partitionBy("chunk_id").orderBy(F.col("score").desc()))
    true = near.withColumn("p", place).filter(F.col("p") <= k).groupBy("chunk_id").agg(F.min("score").alias("last"), F.count(F.lit(1)).alias("asked"))
    listed = similar_vectors(df.select(key, vector), key, vector, dim, k).select(F.col(key).alias("chunk_id"), "score")
    hits = true.join(listed, "chunk_id", "left").groupBy("chunk_id", "asked").agg(
        F.count(F.when(F.col("score") >= F.col("last") - 1e-6, 1)).alias("found")
    )
    return hits.select(F.col("chunk_id").alias(key), F.least("found", "asked").alias("found"), "asked")
