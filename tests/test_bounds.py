"""What a task or the driver holds at once doesn't grow with searches times vectors or chunks."""

import tracemalloc

import numpy as np
import pyarrow as pa

from seekstone.operators import vector


def peak_mb(f):
    tracemalloc.start()
    try:
        return f(), tracemalloc.get_traced_memory()[1] / 1e6
    finally:
        tracemalloc.stop()


def vectors(n, dim=8, seed=1):
    x = np.random.default_rng(seed).normal(size=(n, dim)).astype(np.float32)
    x[1::50] = x[::50]  # ties
    flat = pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * dim, pa.int32()), pa.array(x.ravel()))
    batch = pa.RecordBatch.from_arrays([pa.array([f"v{i}" for i in range(n)]), flat, pa.array(np.arange(n))], ["chunk_id", "embedding", "seq"])
    return x.astype(np.float64), batch


def brute(x, q, ks, metric):
    s = vector._scores(metric, q, x)
    return {n: [f"v{j}" for j in np.lexsort((np.arange(len(x)), -np.round(s[n], 9)))[: ks[n]]] for n in range(len(q))}


def found(batches):
    rows = [r for b in batches for r in b.to_pylist()]
    out = {}
    for r in sorted(rows, key=lambda r: (r["query_id"], -round(r["score"], 9), r["seq"])):
        out.setdefault(r["query_id"], []).append(r["chunk_id"])
    return out


def test_a_batch_for_many_queries_is_scored_in_tiles():
    """10,000 vectors for 3,000 queries: 240 MB of scores at once before, and several of these."""
    x, batch = vectors(10_000)
    q, ks = x[::3][:3_000] + 0.1, np.arange(3_000) % 4 + 1
    for metric in ("cosine", "inner_product", "l2"):
        parts = [batch.slice(0, 7_000), batch.slice(7_000)]
        got, mb = peak_mb(lambda: list(vector._near(iter(parts), np.arange(len(q)), vector._ready(metric, q), ks, metric)))
        assert mb < 100 and found(got) == brute(x, q, ks, metric)


def test_cells_are_fitted_in_tiles():
    x, _ = vectors(20_000)
    nearest, mb = peak_mb(lambda: vector.CellModel(x[:900], 1).route(x, 1))
    assert mb < 60 and (nearest[:900, 0] == np.where(np.arange(900) % 50 == 1, np.arange(900) - 1, np.arange(900))).all()


def test_hits_are_let_go(monkeypatch):
    """Few of many rows are held, also in the order of worst first; ids of rows that no hit names go."""
    from seekstone.operators.best import Best

    best = Best(np.array([3, 0, 2]))
    best.limit, best.most = 40, 20
    for n in range(100):
        base = best.rows(pa.array([f"r{n}_{i}" for i in range(10)]))
        for search in range(3):
            best.add(np.full(10, search), np.arange(10.0) + n, np.arange(10) + 10 * n, base + np.arange(10))
        best.limit = 40
        assert best.known <= 60 and best.count <= 30
    got = found(best.batches(np.array([7, 8, 9])))
    assert got == {7: ["r99_9", "r98_9", "r99_8"], 9: ["r99_9", "r98_9"]}  # equal scores by seq


def test_chunks_are_scored_in_tiles_of_searches_and_shares():
    """1,200 chunks with one word of all 5,000 searches: 6 million scores and shares, 4 million at once before."""
    from types import SimpleNamespace

    from seekstone.operators import lexical

    n, m = 1_200, 5_000
    rng = np.random.default_rng(2)
    weight = np.round(rng.random((2, n)), 1) + 0.1  # ties
    t, c = np.tile([0, 1], n), np.repeat(np.arange(n), 2)
    table = pa.table({"t": pa.array(t, pa.int32()), "chunk_id": [f"c{i}" for i in c], "seq": c, "w": weight[t, c]})
    ks = np.arange(m) % 3
    idfs = np.array([1.0, 2.0])
    searches, cuts = np.r_[np.arange(m), np.arange(0, m, 2)], np.array([0, m, m + m // 2])  # all ask for word 0, half for word 1
    shared = SimpleNamespace(value=(np.arange(m) + 7, ks, searches, cuts, idfs))
    got, mb = peak_mb(lambda: list(lexical._score_chunks(iter(table.to_batches(max_chunksize=500)), shared)))
    want = {}
    for both in (0, 1):
        s = weight[0] + (2.0 * weight[1] if both else 0)
        best = [f"c{j}" for j in np.lexsort((np.arange(n), -np.round(s, 9)))]
        want |= {q + 7: best[: ks[q]] for q in range(m) if (q % 2 == 0) == bool(both) and ks[q]}
    assert found(got) == want and mb < 100


def test_cells_for_many_queries_are_scored_in_tiles():
    """One cell of 8,000 vectors that 3,000 queries look into, and one that a third of them do: 190 MB of scores at once before."""
    x, batch = vectors(10_000)
    cell = (np.arange(10_000) >= 8_000).astype(np.int32)
    batch = pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell)], ["chunk_id", "embedding", "seq", "cell"])
    q, ks = x[::3][:3_000] + 0.1, np.arange(3_000) % 4 + 1
    asks, cuts = np.r_[np.arange(3_000), np.arange(0, 3_000, 3)].astype(np.int32), np.array([0, 3_000, 4_000])
    got, mb = peak_mb(lambda: list(vector._near_in_cells(iter([batch]), np.arange(3_000), q, ks, asks, cuts, "l2")))
    all_of, first = brute(x, q, ks, "l2"), brute(x[:8_000], q, ks, "l2")
    assert mb < 100 and found(got) == {n: (all_of if n % 3 == 0 else first)[n] for n in range(3_000)}
