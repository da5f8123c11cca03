import json
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from seekstone import Document, Engine, EmbedderRegistry, HashEmbedder, VectorStoreRegistry
from seekstone.embedders import TorchEmbedder, normalized, pool
from seekstone.errors import EmbeddingError, IncompatibleBackendError, SeekstoneError, SerializationError, VectorStoreError
from seekstone.functions.vectors import distance_to_score
from seekstone.metadata import canonical, decode, encode
from seekstone.sources import files
from seekstone.streaming.ingest import ingest_stream

DOCS = [
    Document("moon", "Apollo astronauts walked on the Moon in 1969.", {"region": "space", "n": 1}),
    Document("snake", "Python is a programming language for many purposes.", {"region": "code"}),
    Document("nlp", "Attention changed natural language processing."),
]


@pytest.fixture(scope="module")
def engine(spark):
    e = Engine(spark)
    assert e.add_documents(DOCS) == ["moon", "snake", "nlp"]
    return e


@pytest.mark.parametrize("mode", ["bm25", "VECTOR ", "hybrid"])
def test_modes(engine, mode):
    hits = engine.search("astronauts on the moon", 3, mode)
    assert hits[0].document_id == "moon" and [h.rank for h in hits] == list(range(1, len(hits) + 1))
    assert (hits[0].lexical_score is None) == (mode == "VECTOR ")


def test_nothing_to_find(engine):
    assert engine.search("", 3) == engine.search("  　", 3) == engine.search("moon", 0) == engine.search("moon", -1) == []
    with pytest.raises(SeekstoneError):
        engine.search("moon", mode="fuzzy")
    with pytest.raises(ValueError):
        engine.search("moon", fusion_strategy="linear", alpha=2.0)


def test_filters(engine):
    one = engine.search("language moon", 5, filter_metadata={"region": "code"})
    assert [h.document_id for h in one] == ["snake"]
    assert engine.search("moon", 5, filter_metadata={"n": True})[0].metadata["n"] == 1
    assert engine.search("moon", 5, filter_metadata={"n": "1"}) == engine.search("moon", 5, filter_metadata={"x": None}) == []
    assert len(engine.search("moon", 5, "bm25", filter_metadata={})) == 1
    assert [h.document_id for h in engine.search("moon language", 5, filter_metadata={"region": "code"}, prefilter=True)] == ["snake"]


def test_upsert_blank_and_clear(spark):
    e = Engine(spark)
    e.add_documents([Document("a", "old text about cats"), Document("b", "dogs")])
    assert e.add_documents([Document("a", "new text about birds"), Document("b", "   ")]) == ["a"]
    assert len(e) == 2 and e.search("cats", 5, "bm25") == []
    assert {h.content for h in e.search("birds dogs", 5, "bm25")} == {"dogs", "new text about birds"}
    assert e.documents.count() == 2 and e.lengths.count() == e.store.vectors.count() == 2
    assert e.add_documents([Document("c", "x1"), Document("c", "x2")]) == ["c"] and e.search("x2", 1, "bm25")
    with pytest.raises(SeekstoneError):
        e.add_texts(["x"], [{}, {}])
    assert e.add_documents([]) == [] and len(e.add_texts(["some text"])) == 1
    e.clear()
    assert len(e) == 0 and e.search("birds") == []


@pytest.mark.parametrize("mode", ["bm25", "vector", "hybrid"])
def test_round_trip(spark, engine, tmp_path, mode):
    engine.save(str(tmp_path / "i"))
    back = Engine.load(str(tmp_path / "i"), spark=spark)
    assert back.search("language of the moon", 3, mode) == engine.search("language of the moon", 3, mode)


def test_load_errors(spark, engine, tmp_path):
    with pytest.raises(FileNotFoundError):
        Engine.load(str(tmp_path / "none"))
    path = str(tmp_path / "i")
    engine.save(path)
    engine.save(path)  # a second save leaves one valid index
    original = files.read_json(f"{path}/manifest.json")

    def changed(section, key, value):
        raw = json.loads(json.dumps(original))
        (raw[section] if section else raw)[key] = value
        files.write_json(f"{path}/manifest.json", raw)

    for version in ("2.0.0", "x"):
        changed(None, "schema_version", version)
        with pytest.raises(SerializationError):
            Engine.load(path, spark=spark)
    changed("stats", "total_chunks", 99)
    with pytest.raises(SerializationError, match="chunks"):
        Engine.load(path, spark=spark)
    changed("embedding_config", "backend", "sentence-transformers")
    if not EmbedderRegistry.is_available("sentence-transformers"):
        with pytest.raises(IncompatibleBackendError, match="override_embedder"):
            Engine.load(path, spark=spark)
        assert len(Engine.load(path, HashEmbedder(64), spark)) == 3
    with pytest.raises(IncompatibleBackendError, match="dimension"):
        Engine.load(path, HashEmbedder(32), spark)
    changed("vector_store_config", "metric", "odd")
    with pytest.raises(SerializationError):
        Engine.load(path, spark=spark)


def test_tool(engine):
    tool = engine.to_tool(top_k=1)
    assert tool("moon").startswith("[1] (Score: 0.") and "Doc ID: moon)\n" in tool("moon")
    schema = tool.to_json_schema()["function"]
    assert schema["name"] == "knowledge_retriever" and schema["parameters"]["required"] == ["query"]
    assert tool("   ") == "No relevant context found in knowledge base." and callable(tool.to_hf_tool())


@pytest.mark.parametrize("backend", ["numpy", "usearch", "chroma", "lsh"])
@pytest.mark.parametrize("metric", ["cosine", "inner_product", "l2"])
def test_stores(spark, tmp_path, backend, metric):
    rng = np.random.default_rng(3)
    x = normalized(rng.normal(size=(50, 16)))
    store = VectorStoreRegistry.create(f" {backend.upper()}", 16, metric, spark)
    store.add([f"v{n}" for n in range(50)], x)
    assert sum(store.search(x[n], 1)[0][0] == f"v{n}" for n in (0, 7, 23)) == 3
    store.add(["v7"], -x[7])
    store.delete(["v0", "unknown"])
    assert len(store) == 49 and store.search(-x[7], 1)[0][0] == "v7" and store.search(x[0], 0) == []
    store.save(str(tmp_path / "s"))
    again = VectorStoreRegistry.create(backend, 16, metric, spark)
    again.load(str(tmp_path / "s"), spark)
    assert again.search(x[5], 3) == store.search(x[5], 3)


def test_store_errors(spark, tmp_path):
    with pytest.raises(ValueError):
        VectorStoreRegistry.create("other", 4, spark=spark)
    for dim in (0, -1, 1.5):
        with pytest.raises(VectorStoreError):
            VectorStoreRegistry.create("exact", dim, spark=spark)
    store = VectorStoreRegistry.create("exact", 4, spark=spark)
    for ids, vectors in ((["a"], [[1, 2, 3]]), (["a", "b"], [[1, 2, 3, 4]]), (["a", "a"], [[1, 2, 3, 4]] * 2), (["a"], np.zeros((1, 1, 4)))):
        with pytest.raises(VectorStoreError):
            store.add(ids, vectors)
    store.add([], np.zeros((0, 4)))
    with pytest.raises(VectorStoreError):
        store.search([1.0], 1)
    with pytest.raises(FileNotFoundError):
        store.load(str(tmp_path / "none"), spark)
    assert store.search([0, 0, 0, 0], 3) == []


def test_hash_embedder(spark):
    import hashlib

    e = HashEmbedder(16)
    v = e.embed_documents(["Straße", "strasse", ""])
    assert np.allclose(v[0], v[1]) and abs(np.linalg.norm(v[0]) - 1) < 1e-6
    out = np.zeros(16)
    for g in ("  ",):  # an empty text is two blanks
        d = hashlib.md5(g.encode()).digest()
        out[int.from_bytes(d[:4], "big") % 16] += 1 if d[4] % 2 == 0 else -1
    assert np.allclose(v[2], out)
    assert e.embed_documents([]).shape == (0, 16)


def test_embedders_and_registry():
    with pytest.raises(ValueError):
        EmbedderRegistry.create("unknown")
    with pytest.raises(ValueError):
        EmbedderRegistry.is_available("unknown")
    assert EmbedderRegistry.create("hash", dimension=8).dimension == 8
    for wrong in ({}, {"model_name": "m", "pooling": "max"}, {"model_name": "m", "projection_dim": 0}):
        with pytest.raises(EmbeddingError):
            TorchEmbedder(**wrong)
    hidden, mask = np.arange(12, dtype=float).reshape(1, 3, 4), np.array([[1, 1, 0]])
    assert pool(hidden, mask, "cls").tolist() == [[0, 1, 2, 3]] and pool(hidden, mask, "mean").tolist() == [[2, 3, 4, 5]]


def test_python_embedder_in_engine(spark):
    class Lengths:
        dimension, model_name, backend = 2, "lengths", "own"

        def embed_documents(self, texts, batch_size=32):
            return np.array([[len(t), 1.0] for t in texts], np.float32).reshape(-1, 2)

        def embed_query(self, text):
            return np.array([len(text), 1.0], np.float32)

    e = Engine(spark, embedder_instance=Lengths(), distance_metric="l2")
    e.add_documents([Document("s", "ab"), Document("l", "abcdefgh")])
    assert e.search("xx", 1, "vector")[0].document_id == "s"


def test_metadata_texts():
    assert canonical(True) == canonical(1) == canonical(1.0) == "1" and canonical("1") == '"1"'
    assert decode(encode({"a": None, "b": "x", "c": 1.5})) == {"a": None, "b": "x", "c": 1.5}


def test_files(spark, tmp_path):
    docs = spark.createDataFrame([("d", "t", {"k": "1"}, 0)], "doc_id string, content string, metadata map<string,string>, seq bigint")
    chunks = spark.createDataFrame(
        [("d_chunk_0", "d", "t", {"k": "1"}, 0, 1, 0)],
        "chunk_id string, document_id string, content string, metadata map<string,string>, chunk_index int, total_chunks int, seq bigint",
    )
    path = str(tmp_path / "corpus")
    files.write_corpus(docs, chunks, path)
    d, c = files.read_corpus(spark, path)
    assert d.collect() == docs.collect() and c.collect() == chunks.collect()
    docs.select(F.lit("odd").alias("record"), F.col("doc_id").alias("id")).write.mode("overwrite").json(path)
    with pytest.raises(SerializationError):
        files.read_corpus(spark, path)
    with pytest.raises(FileNotFoundError):
        files.read_corpus(spark, str(tmp_path / "none"))
    target = str(tmp_path / "x" / "a.json")
    files.write_json(target, {"ä": 1})
    assert open(target, encoding="utf-8").read() == '{\n  "ä": 1\n}\n' and os.listdir(os.path.dirname(target)) == ["a.json"]
    with pytest.raises(TypeError):
        files.write_json(target, object())
    assert files.read_json(target) == {"ä": 1}


def test_distances(spark):
    for metric, distance, score in (("cosine", 0.25, 0.75), ("inner_product", -2.0, 2.0), ("l2", 1.0, 0.5)):
        assert spark.range(1).select(distance_to_score(metric, F.lit(distance)).alias("s")).head()["s"] == score
    with pytest.raises(ValueError):
        distance_to_score("odd", F.lit(1.0))


def test_stream(spark, tmp_path):
    source = str(tmp_path / "in")
    spark.createDataFrame([("a", "streamed cats"), ("b", "streamed dogs")], "doc_id string, content string").write.json(source)
    e = Engine(spark)
    stream = spark.readStream.schema("doc_id string, content string").json(source)
    query = ingest_stream(e, stream, str(tmp_path / "cp"))
    query.awaitTermination()
    assert len(e) == 2 and e.search("cats", 1, "bm25")[0].document_id == "a"


def test_shared_folder_is_never_one_machine_s(spark):
    from types import SimpleNamespace

    from seekstone import session

    def cluster(master, named=None):
        return SimpleNamespace(
            conf=SimpleNamespace(get=lambda *a: named), sparkContext=SimpleNamespace(master=master, applicationId="x", getCheckpointDir=lambda: None)
        )

    for master in ("spark://host:7077", "yarn", "local-cluster[2,1,1024]"):
        with pytest.raises(SeekstoneError, match="spark.checkpoint.dir"):
            session.shared_dir(cluster(master))
        assert session.shared_dir(cluster(master, "hdfs://x/y/")) == "hdfs://x/y"


def test_round_trip_by_uri(spark, engine, tmp_path):
    path = (tmp_path / "deep" / "i").as_uri()
    engine.save(path)
    assert len(Engine.load(path + "/", spark=spark)) == len(engine) and files.exists(f"{path}/manifest.json")


def test_parts_that_do_not_belong_together(spark, engine, tmp_path):
    path = str(tmp_path / "i")
    engine.save(path)
    data = files.read_json(f"{path}/manifest.json")["data"]
    held = spark.createDataFrame(engine.postings.collect(), engine.postings.schema)
    held.limit(1).write.mode("overwrite").parquet(f"{path}/{data}/postings")
    with pytest.raises(SerializationError, match="postings"):
        Engine.load(path, spark=spark)


def test_many_changes_are_written_whole(spark, monkeypatch):
    """Appended changes, and those that replace, give what one build gives; superseded tables go at once."""
    import seekstone.engine as module
    from seekstone import session

    monkeypatch.setattr(module, "COMPACT_AFTER", 3)
    engine, whole, old = Engine(spark), Engine(spark), []
    texts = {f"d{n}": f"moon number{n} " + "dust " * n for n in range(5)}
    for name, text in texts.items():
        engine.add_documents([Document(name, "old text about the sun", {})])
        engine.add_documents([Document(name, text, {})])
        old = old or [df.inputFiles()[0].rsplit("/", 2)[1] for df in engine._stored if df.inputFiles()]
    stored = {path for _, path in session._WRITTEN}
    assert len(engine._stored) < 30 and not {p for p in old if any(p in x for x in stored)}
    whole.add_documents([Document(n, t, {}) for n, t in texts.items()])
    for query in ("moon", "dust number3", "sun"):
        got, want = (e.search(query, 5, "bm25") for e in (engine, whole))
        assert [(h.chunk_id, round(h.score, 9)) for h in got] == [(h.chunk_id, round(h.score, 9)) for h in want]
    assert len(engine) == len(whole) == len(engine.store) == 5


def test_prefilter_keeps_the_frequencies_of_the_index(spark):
    engine = Engine(spark)
    engine.add_texts(["cat one", "cat two", "cat three", "dog four"], [{"k": "a"}, {"k": "b"}, {"k": "b"}, {"k": "b"}])
    plain = {h.content: h.score for h in engine.search("cat dog", 10, "bm25")}
    first = engine.search("cat dog", 10, "bm25", filter_metadata={"k": "b"}, prefilter=True)
    assert {h.content: h.score for h in first} == {t: s for t, s in plain.items() if t != "cat one"}


def test_model_embedders_are_built_in_the_task(spark):
    from seekstone.embedders import _BUILT, _in_task, _ModelEmbedder, embed_table

    class Lengths(_ModelEmbedder):
        backend, query_prefix = "hash", "query: "

        def __init__(self):
            super().__init__("hash-8", 8, {"dimension": 8})

        def _encode(self, texts, batch_size):
            return np.array([[len(t)] * 8 for t in texts], np.float32)

        def __reduce__(self):
            raise TypeError("models don't travel")

    one = Lengths()
    assert one.embed_queries(["ab"])[0][0] == 9 and one.embed_query("ab")[0] == 9 and one.embed_documents(["ab"])[0][0] == 2
    assert _in_task(one.recipe()) is _in_task(one.recipe()) and repr(one.recipe()) in _BUILT
    embed_table(one, spark.createDataFrame([(1, "x")], "id int, t string"), "id", "t")  # planned without pickling the model


@pytest.mark.parametrize("metric", ["cosine", "inner_product", "l2"])
def test_cells_find_nearly_all(spark, tmp_path, metric):
    from seekstone.operators.vector import knn_batch

    rng = np.random.default_rng(1)
    x = normalized(rng.normal(size=(40, 8))[rng.integers(0, 40, 5000)] + 0.3 * rng.normal(size=(5000, 8)))
    rows = [(f"v{n}", [float(a) for a in v], n) for n, v in enumerate(x)]
    held = spark.createDataFrame(rows, "chunk_id string, embedding array<float>, seq bigint")
    store = VectorStoreRegistry.create("cells", 8, metric, spark)
    store.add_table(held)
    assert len(store.fitted()[0].centres) > 20 and store.fitted() is not None and store.fitted()[1] is store.fitted()[1]
    asked = held.filter("seq % 50 = 0").selectExpr("seq AS query_id", "embedding AS qvec", "IF(seq % 100 = 0, 10, 3) AS k")
    got = {(r["query_id"], r["chunk_id"]) for r in store.search_batch(asked, "k").collect()}
    want = {(r["query_id"], r["chunk_id"]) for r in knn_batch(held, asked, metric, "k").collect()}
    assert len(got & want) >= 0.97 * len(want) and all((n, f"v{n}") in got for n in range(0, 5000, 50))
    store.save(str(tmp_path / "s"))
    again = VectorStoreRegistry.create("cells", 8, metric, spark)
    again.load(str(tmp_path / "s"), spark)
    assert again.fitted()[0].probes == store.fitted()[0].probes and again.search(x[5], 3) == store.search(x[5], 3)


def test_requests_of_all_kinds(spark):
    """Nothing asked, an empty index, and searches with nulls, blanks, filters and modes in any case."""
    schema = "query_id bigint, query string, search_mode string, top_k int, fusion string, alpha double, metadata_filter map<string,string>"
    engine = Engine(spark)
    asked = [
        (1, "moon", None, 3, None, None, None),
        (2, " ", "bm25", 3, None, None, None),
        (3, "moon", "vector", None, None, None, None),
        (4, "Moon dust", "BM25", 2, None, None, {"k": '"a"'}),
        (5, None, "hybrid", 3, "linear", 0.2, {}),
        (6, "moon", "hybrid", 3, "linear", 0.2, {"k": '"c"'}),
    ]
    requests = spark.createDataFrame(asked, schema)
    assert engine.search_requests(requests).count() == 0
    engine.add_texts(["moon dust", "sun"], [{"k": "a"}, {"k": "b"}])
    assert engine.search_requests(requests.limit(0)).count() == 0
    got = sorted((r["query_id"], r["content"], r["rank"]) for r in engine.search_requests(requests).collect())
    assert got == [(1, "moon dust", 1), (1, "sun", 2), (4, "moon dust", 1)]
    odd = spark.createDataFrame([(1, "moon", "other", 3, None, None, None)], schema)
    with pytest.raises(Exception, match="SearchMode"):
        engine.search_requests(odd).count()


class _Counted:
    """A chunker that notes each text it is given in a folder."""

    def __init__(self, folder):
        self.folder = str(folder)

    def split_text(self, text):
        import uuid

        with open(f"{self.folder}/{uuid.uuid4().hex}", "w") as f:
            f.write(text)
        return [text]


def test_a_document_is_cut_once(spark, tmp_path):
    """Ranges of chunks were found by cutting all documents once more."""
    e = Engine(spark, custom_chunker=_Counted(tmp_path))
    rows = spark.createDataFrame([(f"d{i % 40:02}", f"word{i} same", {}, 100 - i) for i in range(60)], "doc_id string, content string, metadata map<string,string>, seq bigint")
    e.add_table(rows.repartition(6))
    given = [f.read_text() for f in tmp_path.iterdir()]
    assert sorted(given) == sorted({f"word{i} same" for i in range(40)})
    got = e.chunks.orderBy("seq").select("seq", "document_id").collect()
    assert [tuple(r) for r in got] == [(n, f"d{39 - n:02}") for n in range(40)]  # of an id's rows the last one, in order


def test_words_are_counted_once_and_another_store_indexes_nothing(spark, monkeypatch):
    """What the ranges of postings are found by is a stored table; searches by another store are those of an engine filled with it."""
    from seekstone import engine as module

    read = []
    monkeypatch.setattr(module, "in_order", lambda p, real=module.in_order: (read.append(p.inputFiles()), real(p))[1])
    e = Engine(spark)
    e.add_documents(DOCS)
    assert all(files and "counted-" in files[0] for files in read) and read
    filled = Engine(spark, vector_backend="cells")
    filled.add_documents(DOCS)
    tables = e.chunks, e.postings, e.store.vectors
    e.use_store("cells")
    assert e.store.backend == "cells" and (e.chunks, e.postings, e.store.vectors) == tables
    for mode in ("bm25", "vector", "hybrid"):
        assert e.search("language of the moon", 3, mode) == filled.search("language of the moon", 3, mode)
