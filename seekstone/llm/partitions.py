"""Learned partitions of vectors: a balanced partition of a neighbour graph and a small classifier that predicts it.

Both are fitted on the driver on a sample of bounded size.  Only numpy.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


def neighbour_graph(x: np.ndarray, k: int, block: int = 1024) -> np.ndarray:
    """The k nearest rows by inner product of every row, itself apart.  Rows x k (fewer where there are fewer rows)."""
    n = len(x)
    k = min(k, n - 1)
    out = np.zeros((n, max(k, 0)), dtype=np.int64)
    for a in range(0, n if k > 0 else 0, block):
        s = x[a : a + block] @ x.T
        s[np.arange(len(s)), np.arange(a, a + len(s))] = -np.inf
        out[a : a + block] = np.argpartition(s, n - k, axis=1)[:, n - k :]
    return out


def _by_part(values: np.ndarray, part: np.ndarray, parts: int) -> np.ndarray:
    if values.ndim == 1:
        return np.bincount(part, values, minlength=parts)
    return np.stack([np.bincount(part, c, minlength=parts) for c in values.T], axis=1)


def _rank_in_part(order: np.ndarray, part: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Place of each row within its part; ``order`` sorts by part."""
    rank = np.empty(len(part), dtype=np.int64)
    rank[order] = np.arange(len(part)) - (np.cumsum(sizes) - sizes)[part[order]]
    return rank


def balanced_partition(x: np.ndarray, graph: np.ndarray, levels: int, smoothings: int = 20, swaps: int = 8, seed: int = 0) -> np.ndarray:
    """2**levels parts of equal size (to one) that cut few edges: all parts of a level are halved at once.

    A half is chosen by smoothing a principal direction over the part's own edges and cutting at its median; then
    the rows whose neighbours lie on the other side are swapped in pairs.  Neighbouring numbers are alike parts."""
    n, rng = len(x), np.random.default_rng(seed)
    part = np.zeros(n, dtype=np.int64)
    src, dst = np.repeat(np.arange(n), graph.shape[1]), graph.ravel()
    for level in range(levels):
        parts = 1 << level
        sizes = np.bincount(part, minlength=parts)
        mean = _by_part(x, part, parts) / np.maximum(sizes, 1)[:, None]
        centred = x - mean[part].astype(x.dtype)
        v = centred @ rng.normal(size=x.shape[1]).astype(x.dtype)
        for _ in range(4):
            direction = _by_part(centred * v[:, None], part, parts)
            direction /= np.maximum(np.linalg.norm(direction, axis=1, keepdims=True), 1e-12)
            v = np.einsum("ij,ij->i", centred, direction[part].astype(x.dtype))
        inside = part[src] == part[dst]
        s, d = src[inside], dst[inside]
        degree = np.maximum(np.bincount(s, minlength=n) + np.bincount(d, minlength=n), 1)
        v = v.astype(float)
        for _ in range(smoothings):
            around = np.bincount(s, v[d], minlength=n) + np.bincount(d, v[s], minlength=n)
            v = 0.5 * v + 0.5 * around / degree
            v -= (_by_part(v, part, parts) / np.maximum(sizes, 1))[part]
            v /= np.sqrt(np.maximum(_by_part(v * v, part, parts) / np.maximum(sizes, 1), 1e-30))[part]
        rank = _rank_in_part(np.lexsort((v, part)), part, sizes)
        side = (rank >= ((sizes + 1) // 2)[part]).astype(np.int64)
        for _ in range(swaps):
            cross = np.where(side[s] != side[d], 1.0, -1.0)
            gain = np.bincount(s, cross, minlength=n) + np.bincount(d, cross, minlength=n)
            cell = part * 2 + side
            counts = np.bincount(cell, minlength=2 * parts)
            order = np.lexsort((-gain, cell))
            rank = _rank_in_part(order, cell, counts)
            start = np.cumsum(counts) - counts
            zero = np.flatnonzero((side == 0) & (rank < np.minimum(counts[0::2], counts[1::2])[part]))
            other = order[start[part[zero] * 2 + 1] + rank[zero]]  # the row of the same place on the other side
            better = (gain[zero] + gain[other] > 2) & (rank[zero] < np.maximum(sizes[part[zero]] // 8, 1))
            if not better.any():
                break
            side[zero[better]], side[other[better]] = 1, 0
        part = part * 2 + side
    return part


@dataclass
class Router:
    """Probabilities of the parts: one hidden layer beside a linear one."""

    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    w3: np.ndarray
    b2: np.ndarray

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.maximum(x @ self.w1 + self.b1, 0) @ self.w2 + x @ self.w3 + self.b2


def fit_router(
    x: np.ndarray, graph: np.ndarray, part: np.ndarray, parts: int, hidden: int = 64, epochs: int = 10, batch: int = 512, seed: int = 0
) -> Router:
    """Learn where a row and its neighbours lie: cross entropy to the parts of both, by Adam."""
    rng = np.random.default_rng(seed)
    n, dim = x.shape
    around = np.c_[part, part[graph]] if graph.shape[1] else part[:, None]
    centre = _by_part(x, part, parts) / np.maximum(np.bincount(part, minlength=parts), 1)[:, None]
    centre /= np.maximum(np.linalg.norm(centre, axis=1, keepdims=True), 1e-12)
    p = [
        rng.normal(0, 1 / np.sqrt(dim), (dim, hidden)),
        np.zeros(hidden),
        np.zeros((hidden, parts)),
        10.0 * centre.T,
        np.zeros(parts),
    ]
    p = [a.astype(np.float32) for a in p]
    m, v, t = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p], 0
    for epoch in range(epochs):
        rate = 3e-3 * 0.5 ** (3 * epoch / max(epochs, 1))
        order = rng.permutation(n)
        for a in range(0, n, batch):
            rows = order[a : a + batch]
            xb = x[rows]
            target = np.zeros((len(rows), parts), np.float32)
            np.add.at(target, (np.arange(len(rows))[:, None], around[rows]), 1.0 / around.shape[1])
            h = np.maximum(xb @ p[0] + p[1], 0)
            z = h @ p[2] + xb @ p[3] + p[4]
            z -= z.max(axis=1, keepdims=True)
            e = np.exp(z)
            g = (e / e.sum(axis=1, keepdims=True) - target) / len(rows)
            back = (g @ p[2].T) * (h > 0)
            grads = [xb.T @ back, back.sum(0), h.T @ g, xb.T @ g, g.sum(0)]
            t += 1
            for k, grad in enumerate(grads):
                m[k] = 0.9 * m[k] + 0.1 * grad
                v[k] = 0.999 * v[k] + 0.001 * grad * grad
                p[k] -= (rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)).astype(np.float32)
    return Router(*p)
