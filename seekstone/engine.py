"""The engine: five tables behind a small facade.

A change writes what is new, and which old chunks are gone, to the shared folder; the tables are what was there, without those, and
the new.  After some changes they are written whole, so plans stay short and an index survives the loss of executors.
Everything that can fail is done before the tables are replaced.
"""

from __future__ import annotations

import uuid
from typing import Any

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from seekstone import metadata as M
from seekstone.embedders import EmbedderRegistry, embed_table
from seekstone.errors import IncompatibleBackendError, SeekstoneError, SerializationError
from seekstone.functions.text import is_blank
from seekstone.operators.chunking import RecursiveCharacterChunker, chunk_documents
from seekstone.operators.lexical import build_index, corpus_stats, in_order
from seekstone.operators.search import IndexTables, search_rankings, search_requests, with_content
from seekstone.schema import (
    CHUNKS,
    DOCUMENTS,
    LENGTHS,
    POSTINGS,
    VECTORS,
    DistanceMetric,
    Document,
    FusionStrategy,
    LexicalParams,
    QueryResult,
    SearchMode,
    coerce,
)
from seekstone.session import discard, materialize, parallelism, ship
from seekstone.sources import files
from seekstone.stores import VectorStoreRegistry
from seekstone.tool import SearchTool

_HINTS = {
    "fastembed": "pip install fastembed",
    "sentence-transformers": "pip install sentence-transformers",
    "torch": "pip install torch",
}


#: Chunks that a change replaces up to which their ids are broadcast.
BROADCAST_GONE = 200_000
#: Changes after which the tables are written whole.
COMPACT_AFTER = 8


class Engine:
    """Retrieval over chunks: BM25, vectors, or both."""

    def __init__(
        self,
        spark: SparkSession | None = None,
        vector_backend: str = "exact",
        embedding_backend: str = "hash",
        embedding_model: str | None = None,
        distance_metric: DistanceMetric | str = DistanceMetric.COSINE,
        embedder_instance: Any = None,
        custom_chunker: Any = None,
        bm25_k1: float = 1.5,
        bm25_b: float = 0.75,
        bm25_lowercase: bool = True,
        bm25_stopwords: list[str] | None = None,
        embedding_kwargs: dict[str, Any] | None = None,
        vector_store_kwargs: dict[str, Any] | None = None,
    ):
        self.spark = spark or SparkSession.getActiveSession() or SparkSession.builder.getOrCreate()
        ship(self.spark)
        self.embedder = embedder_instance or EmbedderRegistry.create(
            embedding_backend, model_name=embedding_model, **(embedding_kwargs or {})
        )
        self.metric = coerce(DistanceMetric, distance_metric)
        self.store_kwargs = dict(vector_store_kwargs or {})
        self.store = VectorStoreRegistry.create(
            vector_backend, self.embedder.dimension, self.metric, self.spark, **self.store_kwargs
        )
        self.chunker = custom_chunker
        self.params = LexicalParams(bm25_k1, bm25_b, bm25_lowercase, tuple(bm25_stopwords or ()))
        self._empty()

    def _empty(self) -> None:
        make = self.spark.createDataFrame
        self.documents, self.chunks = make([], DOCUMENTS), make([], CHUNKS)
        self.postings, self.lengths = make([], POSTINGS), make([], LENGTHS)
        self.store.vectors = make([], VECTORS)
        self._changes, self._stored, self._counted = 0, [], None

    @property
    def tables(self) -> IndexTables:
        """The index; what its scores need of the whole collection is counted at the first search after a change."""
        if self._counted is None:
            counted = self.postings.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
            counted = materialize(counted.repartitionByRange("term").sortWithinPartitions("term"), "terms")
            n, mean = corpus_stats(self.lengths).first()
            self._stored.append(counted)
            self._counted = counted, (n, mean or 0.0)
        return IndexTables(
            self.documents, self.chunks, self.store.vectors, self.postings, self.lengths, *self._counted, self.store.search_batch
        )

    # ingestion

    def add_texts(
        self, texts: list[str], metadatas: list[dict[str, Any]] | None = None, chunk_size: int = 500, chunk_overlap: int = 50
    ) -> list[str]:
        """Index plain texts under generated ids; returns the ids of the documents (not of the chunks)."""
        metadatas = [{} for _ in texts] if metadatas is None else list(metadatas)
        if len(metadatas) != len(texts):
            raise SeekstoneError(f"There are {len(texts)} texts but {len(metadatas)} metadata records.")
        docs = [Document(f"doc_{uuid.uuid4().hex}", t, dict(m)) for t, m in zip(texts, metadatas)]
        return self.add_documents(docs, chunk_size, chunk_overlap)

    def add_documents(self, documents: list[Document], chunk_size: int = 500, chunk_overlap: int = 50) -> list[str]:
        """Index documents; one with a known id replaces the old one.  Returns the ids that gave chunks, in order."""
        documents = list(documents)
        if not documents:
            return []
        rows = [(d.id, d.content, M.encode(d.metadata), n) for n, d in enumerate(documents)]
        added = self.add_table(self.spark.createDataFrame(rows, DOCUMENTS), chunk_size, chunk_overlap)
        first = {d.id: n for n, d in reversed(list(enumerate(documents)))}
        return sorted((r["doc_id"] for r in added.collect()), key=first.__getitem__)

    def add_table(self, documents: DataFrame, chunk_size: int = 500, chunk_overlap: int = 50) -> DataFrame:
        """The same for a table ``(doc_id, content, metadata, seq)`` of any size; ``seq`` orders its rows, and of rows with the
        same id the last one counts.  Metadata values are canonical JSON texts.  Returns ``(doc_id)`` of what was indexed.

        Documents without a chunk change nothing: an older version under their id stays."""
        chunker = self.chunker or RecursiveCharacterChunker(chunk_size, chunk_overlap)
        last = documents.groupBy("doc_id").agg(F.max("seq").alias("seq"))
        documents = documents.filter(F.col("doc_id").isNotNull()).join(last, ["doc_id", "seq"], "left_semi")
        documents = documents.dropDuplicates(["doc_id"])
        # order: documents as given, then chunks within; numbered without bringing all rows together
        numbered, ranged = self._numbered(documents, chunker)
        cut = materialize(numbered, "chunks")
        discard([ranged])
        ids = materialize(cut.select(F.col("document_id").alias("doc_id")).distinct(), "ids")
        if ids.isEmpty():
            return ids
        vectors = embed_table(self.embedder, cut, "chunk_id", "content").join(cut.select("chunk_id", "seq"), "chunk_id")
        vectors = materialize(vectors.select("chunk_id", "embedding", "seq"), "vectors")
        postings, lengths = build_index(cut, self.params)
        kept = documents.join(ids, "doc_id", "left_semi").select("doc_id", "content", "metadata", "seq")
        counted = materialize(postings, "counted")  # ranges are found by a look at all rows: words are counted once
        postings = materialize(in_order(counted), "postings")
        discard([counted])
        lengths, kept = materialize(lengths, "lengths"), materialize(kept, "documents")
        gone = self.chunks.join(ids, self.chunks["document_id"] == ids["doc_id"], "left_semi").select("chunk_id")
        gone = materialize(gone, "gone")
        shift, replaces = self._next_document(), not gone.isEmpty()

        def grown(old: DataFrame, new: DataFrame, without: DataFrame, column: str = "chunk_id") -> DataFrame:
            if replaces:
                few = without.count() <= BROADCAST_GONE
                old = old.join(F.broadcast(without) if few else without, column, "left_anti").select(*new.columns)
            return old.unionByName(new)

        written = [cut, vectors, postings, lengths, kept, gone, ids]
        new = IndexTables(
            documents=grown(self.documents, kept.withColumn("seq", F.col("seq") + shift), ids, "doc_id"),
            chunks=grown(self.chunks, cut, gone),
            vectors=grown(self.store.vectors, vectors, gone),
            postings=grown(self.postings, postings, gone),
            lengths=grown(self.lengths, lengths, gone),
        )
        changes = self._changes + 1
        if changes >= COMPACT_AFTER:
            new = IndexTables(*(materialize(t, "whole") for t in (new.documents, new.chunks, new.vectors)), materialize(in_order(new.postings), "whole"), materialize(new.lengths, "whole"))
            old, written = self._stored + written[:-1], [new.documents, new.chunks, new.vectors, new.postings, new.lengths]
            self._set(new, written)
            discard(old)  # nothing reads them any more
        else:
            self._set(new, self._stored + written)
            self._changes = changes
        return ids

    def _set(self, new: IndexTables, stored: list[DataFrame]) -> None:
        self.documents, self.chunks, self.postings, self.lengths = new.documents, new.chunks, new.postings, new.lengths
        self.store.vectors = new.vectors
        self._changes, self._stored, self._counted = 0, stored, None

    def _next_document(self) -> int:
        return self.documents.agg(F.coalesce(F.max("seq") + 1, F.lit(0)).alias("n")).head()["n"]

    def _numbered(self, documents: DataFrame, chunker: Any) -> tuple[DataFrame, DataFrame]:
        """(chunks numbered, a stored table that they read): ``seq`` after all that are there.  Documents are dealt by ranges, so that
        the look for these cuts no text, and cut there; chunks are numbered within a range, shifted by the ranges before it."""
        order = ["seq", "document_id", "chunk_index"]
        start = self.chunks.agg(F.coalesce(F.max("seq") + 1, F.lit(0)).alias("n")).head()["n"]
        dealt = documents.repartitionByRange(parallelism(self.spark), "seq", "doc_id")
        ranged = materialize(chunk_documents(dealt, chunker).withColumn("_range", F.spark_partition_id()), "ranged")
        sizes = ranged.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))  # a row per range
        before = F.coalesce(F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        sizes = sizes.select("_range", before.alias("_before"))
        within = F.row_number().over(Window.partitionBy("_range").orderBy(*order))
        numbered = ranged.withColumn("_k", within).join(F.broadcast(sizes), "_range")
        numbered = numbered.withColumn("seq", (F.col("_before") + F.col("_k") - 1 + start).cast("bigint"))
        return numbered.drop("_range", "_k", "_before"), ranged

    # retrieval

    def use_store(self, vector_backend: str, **kwargs: Any) -> None:
        """Search the same vectors by another store from now on; nothing is indexed anew."""
        store = VectorStoreRegistry.create(vector_backend, self.embedder.dimension, self.metric, self.spark, **kwargs)
        store.vectors = self.store.vectors
        self.store, self.store_kwargs = store, dict(kwargs)

    def search(
        self,
        query: str,
        top_k: int = 5,
        mode: SearchMode | str = SearchMode.HYBRID,
        alpha: float = 0.5,
        fusion_strategy: FusionStrategy | str = FusionStrategy.RRF,
        filter_metadata: dict[str, Any] | None = None,
        prefilter: bool = False,
    ) -> list[QueryResult]:
        coerce(SearchMode, mode), coerce(FusionStrategy, fusion_strategy)
        if top_k <= 0 or not query or not query.strip():
            return []
        one = self.spark.createDataFrame([(0, query)], "query_id bigint, query string")
        found = self.search_table(one, top_k, mode, alpha, fusion_strategy, filter_metadata, prefilter)
        return [
            QueryResult(
                r["chunk_id"],
                r["document_id"],
                r["content"],
                r["score"],
                M.decode(r["metadata"]),
                r["vector_score"],
                r["lexical_score"],
                r["rank"],
            )
            for r in found.orderBy("rank").collect()
        ]

    def search_table(
        self,
        queries: DataFrame,
        top_k: int = 5,
        mode: SearchMode | str = SearchMode.HYBRID,
        alpha: float = 0.5,
        fusion_strategy: FusionStrategy | str = FusionStrategy.RRF,
        filter_metadata: dict[str, Any] | None = None,
        prefilter: bool = False,
    ) -> DataFrame:
        """A batch: ``(query_id, query)`` to result rows."""
        if coerce(SearchMode, mode) is not SearchMode.BM25:
            queries = self._embedded(queries)
        rankings = search_rankings(
            self.tables,
            queries,
            top_k,
            mode,
            alpha,
            fusion_strategy,
            M.encode(filter_metadata) or None,
            self.params,
            self.metric,
            prefilter,
        )
        return with_content(rankings, self.chunks)

    def search_requests(self, requests: DataFrame) -> DataFrame:
        """Many searches, each in its own way, to result rows: ``(query_id, query, search_mode, top_k, fusion, alpha,
        metadata_filter)`` as in :func:`seekstone.operators.search.search_requests`; values of filters are canonical texts."""
        rankings = search_requests(self.tables, self._embedded(requests), self.params, self.metric)
        return with_content(rankings, self.chunks)

    def _embedded(self, queries: DataFrame) -> DataFrame:
        """With the vectors of those that aren't blank, which alone are kept."""
        usable = queries.filter(~is_blank(F.col("query")))
        vectors = embed_table(self.embedder, usable, "query_id", "query", queries=True)
        return usable.join(vectors.withColumnRenamed("embedding", "qvec"), "query_id")

    # persistence

    def save(self, path: str) -> None:
        """Write the tables to a new folder below ``path``, then the manifest, which alone makes them valid."""
        path, data = path.rstrip("/"), f"data-{uuid.uuid4().hex[:12]}"
        tables = self.tables
        for name, table in (
            ("documents", self.documents),
            ("chunks", self.chunks),
            ("vectors", self.store.vectors),
            ("postings", self.postings),
            ("lengths", self.lengths),
            ("terms", tables.frequencies),
        ):
            (in_order(table) if name == "postings" else table).write.parquet(f"{path}/{data}/{name}")
        self.store.save_model(f"{path}/{data}")
        manifest = files.Manifest(
            created_at_utc=files.utc_now(),
            embedding_config=files.EmbeddingConfig(
                self.embedder.backend, self.embedder.model_name, self.embedder.dimension, dict(getattr(self.embedder, "init_kwargs", {}))
            ),
            vector_store_config=files.VectorStoreConfig(
                self.store.backend, self.embedder.dimension, self.metric.value, self.store_kwargs
            ),
            lexical_config=files.LexicalConfig(
                "bm25", self.params.k1, self.params.b, self.params.lowercase, list(self.params.stopwords)
            ),
            stats=files.IndexStats(self.documents.count(), len(self)),
            data=data,
        )
        files.write_json(f"{path}/manifest.json", manifest.to_dict())

    @classmethod
    def load(cls, path: str, override_embedder: Any = None, spark: SparkSession | None = None) -> Engine:
        """Read an index back, checking version, embedder, and counts."""
        ship(spark or SparkSession.getActiveSession() or SparkSession.builder.getOrCreate())
        path = path.rstrip("/")
        file = f"{path}/manifest.json"
        if not files.exists(file):
            raise FileNotFoundError(f"There is no manifest.json in {path!r}.")
        raw = files.read_json(file)
        files.check_version(raw.get("schema_version", ""))
        manifest = files.Manifest.from_dict(raw)
        wanted, embedder = manifest.embedding_config, override_embedder
        if embedder is None:
            try:
                embedder = EmbedderRegistry.create(wanted.backend, model_name=wanted.model_name, **wanted.kwargs)
            except ImportError as err:
                hint = _HINTS.get(wanted.backend, f"install the package behind {wanted.backend!r}")
                raise IncompatibleBackendError(
                    f"The embedder {wanted.backend!r} isn't available ({err}). Install it ({hint}), or pass an "
                    f"override_embedder of dimension {wanted.dimension} (the index was built with {wanted.model_name!r})."
                ) from err
        if embedder.dimension != wanted.dimension:
            raise IncompatibleBackendError(
                f"The embedder's dimension is {embedder.dimension}, the index's dimension {wanted.dimension} "
                f"({wanted.backend}/{wanted.model_name}). Pass an override_embedder that fits, or index anew."
            )
        store, lexical = manifest.vector_store_config, manifest.lexical_config
        engine = cls(
            spark,
            vector_backend=store.backend,
            embedder_instance=embedder,
            distance_metric=store.metric,
            bm25_k1=lexical.k1,
            bm25_b=lexical.b,
            bm25_lowercase=lexical.lowercase,
            bm25_stopwords=lexical.stopwords,
            vector_store_kwargs=store.kwargs,
        )

        def read(name: str, schema: str) -> DataFrame:
            return engine.spark.read.schema(schema).parquet(f"{path}/{manifest.data}/{name}")

        engine._set(
            IndexTables(
                read("documents", DOCUMENTS), read("chunks", CHUNKS), read("vectors", VECTORS), read("postings", POSTINGS), read("lengths", LENGTHS)
            ),
            [],
        )
        engine.store.load_model(f"{path}/{manifest.data}")
        n, mean = corpus_stats(engine.lengths).first()
        engine._counted = read("terms", "term string, df bigint"), (n, mean or 0.0)
        chunks = len(engine)
        for what, count in (
            ("The manifest", manifest.stats.total_chunks),
            ("The vector table", engine.store.vectors.count()),
            ("The lexical index", engine.lengths.count()),
        ):
            if count != chunks:
                raise SerializationError(f"{what} tells of {count} chunks, but there are {chunks} chunks.")
        # a lexical index whose parts don't belong together gives wrong scores silently
        words = engine.postings.agg(
            F.sum("tf").alias("tf"), F.count(F.lit(1)).alias("n"), F.count(F.when((F.col("tf") > 0) & (F.col("dl") >= F.col("tf")), 1)).alias("good")
        ).first()
        if words["n"] != words["good"] or (words["tf"] or 0) != (engine.lengths.agg(F.sum("dl")).first()[0] or 0):
            raise SerializationError("The postings don't fit the lengths of the chunks.")
        if (engine._counted[0].agg(F.sum("df")).first()[0] or 0) != words["n"]:
            raise SerializationError("The frequencies of the terms don't fit the postings.")
        return engine

    # the rest

    def to_tool(
        self, name: str = "knowledge_retriever", description: str | None = None, top_k: int = 5, mode: SearchMode | str = SearchMode.HYBRID
    ) -> SearchTool:
        return SearchTool(self, name, description, top_k, coerce(SearchMode, mode))

    def clear(self) -> None:
        self._empty()

    def __len__(self) -> int:
        return self.chunks.count()
