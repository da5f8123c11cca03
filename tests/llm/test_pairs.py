import random
import re

import numpy as np
import pytest

from seekstone.llm import neardup, similar
from seekstone.llm.neardup import class_pairs, components, near_duplicates
from seekstone.llm.partitions import balanced_partition, fit_router, neighbour_graph
from seekstone.llm.similar import distinct_vectors, mutual_pairs, similar_vectors


# near duplicates


def shingles(text, width):
    w = [x.casefold() for x in re.findall(r"\w+", text or "")]
    return {tuple(w[k : k + width]) for k in range(len(w) - width + 1)}, len(w)


def brute(rows, threshold, width, least):
    sets = {}
    for kind, key, text in rows:
        s, n = shingles(text, width)
        if kind and key and n >= max(least, width):
            sets[(kind, key)] = s
    root = {k: k for k in sets}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    keys = sorted(sets)
    for a in keys:
        for b in keys:
            both = len(sets[a] & sets[b])
            if a < b and a[0] == b[0] and both >= threshold * len(sets[a] | sets[b]) - 1e-9:
                root[find(b)] = find(a)
    pairs = {(a[0], a[1], b[1]) for a in keys for b in keys if a[0] == b[0] and a[1] < b[1] and find(a) == find(b)}
    return pairs


def corpus(seed, n=60):
    rng = random.Random(seed)
    pool = [f"w{k}" for k in range(40)]
    rows = []
    for k in range(n):
        text = rng.choices(pool, k=rng.randint(5, 60))
        if rows and rng.random() < 0.6:
            text = rng.choice(rows)[2].split()
            for _ in range(rng.randint(0, 4)):
                text[rng.randrange(len(text))] = rng.choice(pool)
            if rng.random() < 0.3:
                text = text[len(text) // 3 :] + text[: len(text) // 3]
        rows.append((rng.choice(["document", "chunk"]), f"k{k:03}", " ".join(text)))
    return rows


SCHEMA = "kind string, key string, text string"


@pytest.mark.parametrize("seed,threshold,width,least", [(1, 0.6, 3, 30), (2, 0.6, 3, 1), (3, 0.8, 5, 1), (4, 0.3, 2, 5)])
def test_classes_equal_brute_force(spark, seed, threshold, width, least):
    rows = corpus(seed)
    rows += [("chunk", "null", None), ("chunk", "empty", ""), ("chunk", "long", "same words again " * 400), (None, "x", "a b c"), ("chunk", None, "a b c")]
    rows += [("chunk", "long2", "same words again " * 400), rows[0], rows[1]]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    classes = near_duplicates(df, "kind", "key", "text", threshold, width, least)
    got = {tuple(r) for r in class_pairs(classes, "kind", "key").collect()}
    assert got == brute(rows, threshold, width, least)
    held = classes.collect()
    keys = {(k, i) for k, i, _ in rows if k and i}
    assert len(held) == len(keys) and {(r["kind"], r["key"]) for r in held} == keys
    for r in held:
        assert r["class"] <= r["key"]


@pytest.mark.parametrize("worth", [2, 32])
def test_large_classes_open_few_groups(spark, monkeypatch, worth):
    """Variants of one template: what is opened doesn't grow with their number, whether or not small classes are linked first."""
    monkeypatch.setattr(neardup, "WORTH", worth)
    stored, real = {}, neardup.materialize

    def spy(df, name):
        stored[name] = real(df, name)
        return stored[name]

    monkeypatch.setattr(neardup, "materialize", spy)
    opened = []
    for n in (500, 6000):
        rng, rows = random.Random(4), []
        for k in range(n):
            text = [f"t{j}" for j in range(120)]
            text[rng.randrange(120)] = f"e{rng.randrange(3000)}"
            rows.append(("chunk", f"k{k:05}", " ".join(text)))
        rows.append(("chunk", "other", " ".join(f"t{j}" if j < 60 else f"o{j}" for j in range(120))))
        rows.append(("chunk", "another", " ".join(f"t{j}" if j < 60 else f"a{j}" for j in range(120))))
        classes = near_duplicates(spark.createDataFrame(rows, SCHEMA).repartition(4), "kind", "key", "text", 0.6, 3, 30)
        sizes = sorted(r["count"] for r in classes.groupBy("class").count().collect())
        assert sizes == [1, 1, n]
        opened.append(stored["opened"].count() / n)
    assert max(opened) < 0.5


def test_common_shingles_go_by_group(spark, monkeypatch):
    """Long posting lists take another way with the same result."""
    monkeypatch.setattr(neardup, "SHORT_LIST", 3)
    monkeypatch.setattr(neardup, "BLOCK", 4)
    rng = random.Random(8)
    base = [f"b{k}" for k in range(40)]
    rows = []
    for n in range(50):
        text = list(base)
        for _ in range(rng.randint(1, 6)):
            text[rng.randrange(40)] = f"e{rng.randint(0, 5)}"
        rows.append(("chunk", f"k{n:03}", " ".join(text)))
    df = spark.createDataFrame(rows, SCHEMA)
    import pyarrow as pa

    texts = [(n, r[0], r[2]) for n, r in enumerate(rows)]
    batch = pa.RecordBatch.from_pydict({"rid": [t[0] for t in texts], "kind": [t[1] for t in texts], "text": [t[2] for t in texts]})
    kept = list(neardup._keep(list(neardup._count(list(neardup._deal([batch], 4, 3)))), 4, 0.6))
    known = pa.array([[{"doc": 1, "label": 1, "n": 2}, {"doc": 3, "label": 1, "n": 2}]], pa.list_(pa.struct([("doc", pa.int32()), ("label", pa.int64()), ("n", pa.int64())])))
    matrix = pa.Table.from_batches(kept).drop(["keys"]).append_column("known", known).combine_chunks().to_batches()
    part = list(neardup._spread(matrix, 4))
    by_group = {tuple(r.values()) for b in neardup._open(neardup._bound(part, 4, 0.6)) for r in b.to_pylist()}
    monkeypatch.setattr(neardup, "SHORT_LIST", 10_000)
    by_pair = {tuple(r.values()) for b in neardup._open(neardup._bound(part, 4, 0.6)) for r in b.to_pylist()}
    assert by_pair and by_pair <= by_group  # the group way may open more, never less
    got = {tuple(r) for r in class_pairs(near_duplicates(df, "kind", "key", "text", 0.6, 3, 30), "kind", "key").collect()}
    assert got == brute(rows, 0.6, 3, 30)


def test_no_rows(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert near_duplicates(df, "kind", "key", "text").count() == 0


def test_components(spark):
    links = [(n, n + 1) for n in range(20)] + [(100, 101), (101, 102), (100, 102), (7, 7)]
    got = {r["node"]: r["label"] for r in components(spark.createDataFrame(links, "u bigint, v bigint")).collect()}
    assert got == {n: 0 for n in range(21)} | {100: 100, 101: 100, 102: 100}


def test_components_of_long_chains(spark, monkeypatch):
    """A chain is one component however long it is and however its ids lie; what isn't settled is never given out."""
    ids = list(range(1000))
    random.Random(5).shuffle(ids)
    links = list(zip(ids[:-1], ids[1:])) + [(2000, 2001)]
    df = spark.createDataFrame(links, "u bigint, v bigint")
    got = {r["node"]: r["label"] for r in components(df).collect()}
    assert got == dict.fromkeys(range(1000), 0) | {2000: 2000, 2001: 2000}
    monkeypatch.setattr(neardup, "SMALL_LINKS", 0)  # by rounds of tables
    got = {r["node"]: r["label"] for r in components(df).collect()}
    assert got == dict.fromkeys(range(1000), 0) | {2000: 2000, 2001: 2000}
    monkeypatch.setattr(neardup, "MAX_ROUNDS", 3)
    with pytest.raises(RuntimeError):
        components(df)


# similar vectors


def vectors(n, dim=8, seed=1, centres=6):
    rng = np.random.default_rng(seed)
    c = rng.normal(size=(centres, dim))
    return c[rng.integers(0, centres, n)] + rng.normal(scale=0.4, size=(n, dim))


VEC = "id string, v array<float>, score double"


def table(spark, x, extra=()):
    rows = [(f"i{n:05}", [float(a) for a in r], 0.5) for n, r in enumerate(x)] + list(extra)
    return spark.createDataFrame(rows, VEC)


def truth(x, k):
    u = x.astype(np.float32).astype(float)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    s = u @ u.T
    np.fill_diagonal(s, -9)
    return s, np.argsort(-s, axis=1, kind="stable")[:, :k]


def small_cells(monkeypatch):
    for name, value in (("CELL_ROWS", 300), ("PART_ROWS", 20), ("LEAST_SAMPLE", 1000), ("BLOCK_ROWS", 400), ("TASK_QUERIES", 500)):
        monkeypatch.setattr(similar, name, value)


def test_recall_of_the_index(spark, monkeypatch):
    """Several cells, some in blocks, and several tasks a cell; neighbours by brute force."""
    small_cells(monkeypatch)
    x = vectors(2500)
    held = distinct_vectors(table(spark, x), "id", "v", 8, 6)
    index = similar.fit_index(held, 8, 5)
    assert index.cells == 8 and index.probes > 1
    index.salts = 2  # two tasks share what is looked for in a cell
    index.blocks[2] = 2  # a cell of two tasks of its own
    index.first = np.cumsum(index.blocks) - index.blocks
    rows = similar.nearest(held, 8, 5, index).collect()
    ids = {r["rid"]: int(r["ids"][0][1:]) for r in held.collect()}
    s, want = truth(x, 5)
    got = {}
    for r in rows:
        got.setdefault(ids[r["a"]], set()).add(ids[r["b"]])
        assert abs(r["score"] - s[ids[r["a"]], ids[r["b"]]]) < 1e-7  # of vectors in single precision, wherever it was found
    assert all(len(v) == 5 for v in got.values()) and len(got) == len(x)
    assert sum(len(got[n] & set(want[n])) for n in range(len(x))) / want.size >= 0.9


def test_close_pairs(spark, monkeypatch):
    small_cells(monkeypatch)
    x = vectors(1500)
    x = np.r_[x, x[:300] + np.random.default_rng(2).normal(scale=0.03, size=(300, 8))]
    held = distinct_vectors(table(spark, x), "id", "v", 8, 6)
    ids = {r["rid"]: int(r["ids"][0][1:]) for r in held.collect()}
    found = {tuple(sorted((ids[r["a"]], ids[r["b"]]))): r["score"] for r in similar.close_pairs(held, 8, 5, 0.98).collect()}
    s, _ = truth(x, 5)
    want = {(i, j) for i, j in zip(*np.nonzero(s >= 0.98)) if i < j}
    assert set(found) <= want and len(found) >= 0.97 * len(want) > 250
    assert max(abs(s[p] - score) for p, score in found.items()) < 1e-7


def test_slots_have_partitions_of_their_own(spark):
    index = similar.Index(8, 3, salts=5, first=np.arange(3), blocks=np.ones(3, np.int64))
    names = index.names().tolist()
    df = spark.createDataFrame([(n,) for n in names], "slot int").repartition(15, "slot")
    from pyspark.sql import functions as F

    assert df.select(F.spark_partition_id()).distinct().count() == 15


def test_recall_by_brute_force(spark):
    x = vectors(200)
    rows = [(f"i{n:03}", [float(a) for a in r], n) for n, r in enumerate(x)] + [("bad", None, 0), ("zero", [0.0] * 8, 10)]
    df = spark.createDataFrame(rows, "id string, v array<float>, seq bigint")
    got = similar.recall(df, "id", "v", "seq", 10, dim=8, k=4).collect()
    assert len(got) == 20 and all(r["found"] == r["asked"] == 4 for r in got)


def test_small_tables_are_exact(spark):
    x = vectors(120)
    s, want = truth(x, 4)
    rows = similar_vectors(table(spark, x), "id", "v", dim=8, k=4).collect()
    got = {(int(r["id"][1:]), r["place"]): (int(r["neighbour"][1:]), r["score"]) for r in rows}
    assert len(got) == 480
    for n in range(120):
        for p in range(4):
            assert got[(n, p + 1)][0] == want[n, p] and abs(got[(n, p + 1)][1] - s[n, want[n, p]]) < 1e-3


def test_copies_odd_vectors_and_ties(spark):
    nan = float("nan")
    copies = [(f"c{n:02}", [1.0, 2.0, 0.0], 0.0) for n in range(9)] + [("c03", [1.0, 2.0, 0.0], 0.0)]
    odd = [("n1", None, 0.0), ("n2", [0.0] * 3, 0.0), ("n3", [1.0], 0.0), ("n4", [nan, 1.0, 1.0], 0.0), (None, [1.0, 1.0, 1.0], 0.0), ("n5", [None, 1.0, 1.0], 0.0)]
    other = [("d", [2.0, 4.0, 0.1], 0.0), ("e", [-5.0, 1.0, 3.0], 0.0)]
    df = spark.createDataFrame(copies + odd + other, VEC).repartition(3)
    rows = similar_vectors(df, "id", "v", dim=3, k=2).collect()
    got = {}
    for r in sorted(rows, key=lambda r: r["place"]):
        got.setdefault(r["id"], []).append(r["neighbour"])
    assert got["c00"] == ["c01", "c02"] and got["c02"] == ["c00", "c01"] and got["d"] == ["c00", "c01"]
    assert all(got[f"c{n:02}"] == ["c00", "c01"] for n in range(2, 9)) and len(got) == 11
    assert not set(got) & {"n1", "n2", "n3", "n4", "n5"}
    pairs = {tuple(r) for r in mutual_pairs(df, "id", "v", 0.9, dim=3, k=2).collect()}
    assert pairs == {("c00", "c01"), ("c00", "c02"), ("c01", "c02")}
    assert similar_vectors(df.limit(0), "id", "v", dim=3).count() == 0 and mutual_pairs(df.limit(0), "id", "v", 0.9, dim=3).count() == 0


def test_partition_is_balanced_and_router_finds_it():
    x = vectors(600, dim=6, seed=3)
    x = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
    graph = neighbour_graph(x, 8)
    part = balanced_partition(x, graph, 3)
    assert np.ptp(np.bincount(part, minlength=8)) <= 1
    assert (part[graph] != part[:, None]).mean() < 0.6
    router = fit_router(x, graph, part, 8)
    top = np.argsort(-router.logits(x), axis=1)[:, :3]
    assert np.mean([p in t for p, t in zip(part, top)]) > 0.9
    assert neighbour_graph(x[:1], 5).shape == (1, 0)
