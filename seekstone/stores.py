"""Vector stores: a table of vectors with upsert, delete, search, save and load; and their registry."""

from __future__ import annotations

from typing import Any

import numpy as np
from pyspark.sql import DataFrame, SparkSession, functions as F

from seekstone.errors import VectorStoreError
from seekstone.functions.vectors import SCORES
from seekstone.operators import vector as V
from seekstone.operators.lexical import remove
from seekstone.schema import VECTORS, DistanceMetric, coerce
from seekstone.session import materialize
from seekstone.sources.files import exists, read_json, write_json


class ExactVectorStore:
    """Searches every vector."""

    backend = "exact"

    def __init__(self) -> None:
        self.dimension: int | None = None
        self.metric = DistanceMetric.COSINE
        self.vectors: DataFrame | None = None

    def initialize(self, dimension: int, metric: DistanceMetric | str = DistanceMetric.COSINE, spark: SparkSession | None = None) -> None:
        V.check_dimension(dimension)
        self.dimension, self.metric = dimension, coerce(DistanceMetric, metric)
        self.spark = spark or SparkSession.getActiveSession()
        self.vectors = self.spark.createDataFrame([], VECTORS)

    def _ready(self) -> DataFrame:
        if self.vectors is None:
            raise VectorStoreError("The store isn't initialized.")
        return self.vectors

    def __len__(self) -> int:
        return self._ready().count()

    def add(self, chunk_ids: list[str], vectors: Any) -> None:
        """Insert or replace; a replaced vector moves to the end.  An id may not come twice in one call."""
        self._ready()
        matrix = V.as_matrix(vectors, self.dimension)
        ids = list(chunk_ids)
        if len(ids) != len(matrix):
            raise VectorStoreError(f"There are {len(ids)} ids but {len(matrix)} vectors.")
        if len(set(ids)) != len(ids):
            raise VectorStoreError("An id comes twice.")
        if ids:
            rows = [(i, [float(x) for x in v], n) for n, (i, v) in enumerate(zip(ids, matrix))]
            self.add_table(self.spark.createDataFrame(rows, VECTORS))

    def add_table(self, new: DataFrame) -> None:
        """The same for a table ``(chunk_id, embedding, seq)``, of any size; ``seq`` orders the new rows."""
        held = self._ready()
        last = held.agg(F.coalesce(F.max("seq"), F.lit(-1)).alias("s")).head()["s"]
        fresh = new.select("chunk_id", "embedding", (F.col("seq") + (last + 1)).alias("seq"))
        self.vectors = materialize(remove(held, fresh).select("chunk_id", "embedding", "seq").unionByName(fresh), "vectors")

    def delete(self, chunk_ids: list[str]) -> None:
        """Unknown ids are ignored."""
        if chunk_ids:
            gone = self.spark.createDataFrame([(i,) for i in chunk_ids], "chunk_id string")
            self.vectors = materialize(remove(self._ready(), gone).select("chunk_id", "embedding", "seq"), "vectors")

    def search(self, query_vector: Any, top_k: int = 10) -> list[tuple[str, float]]:
        held = self._ready()
        if top_k <= 0:
            return []
        query = V.as_matrix(query_vector, self.dimension)[0]
        return [(r["chunk_id"], r["score"]) for r in self._search(held, query, top_k).collect()]

    def search_batch(self, queries: DataFrame, top_k: int | str) -> DataFrame:
        """``(query_id, chunk_id, score, seq, rank)`` for ``(query_id, qvec)``; ``top_k``: a number or a column."""
        return V.knn_batch(self._ready(), queries, self.metric.value, top_k)

    def save_model(self, directory: str) -> None:
        """What a search needs beside the vectors: nothing here."""

    def load_model(self, directory: str) -> None:
        pass

    def _search(self, held: DataFrame, query: Any, top_k: int) -> DataFrame:
        return V.knn(held, query.tolist(), self.metric.value, top_k)

    def save(self, directory: str) -> None:
        self._ready().write.mode("overwrite").parquet(f"{directory}/vectors")
        write_json(
            f"{directory}/store_config.json",
            {"backend": self.backend, "dimension": self.dimension, "metric": self.metric.value, "count": len(self)},
        )

    def load(self, directory: str, spark: SparkSession | None = None) -> None:
        path = f"{directory}/store_config.json"
        if not exists(path):
            raise FileNotFoundError(f"There is no store_config.json in {directory!r}.")
        config = read_json(path)
        try:
            self.initialize(int(config["dimension"]), config["metric"], spark)
            count = int(config["count"])
        except (KeyError, TypeError, ValueError) as err:
            raise VectorStoreError(f"{path!r} is malformed: {err}") from err
        self.vectors = self.spark.read.schema(VECTORS).parquet(f"{directory}/vectors")
        if len(self) != count:
            raise VectorStoreError(f"{directory!r} holds {len(self)} vectors, but its configuration says {count}.")


class CellVectorStore(ExactVectorStore):
    """Approximate: vectors lie in cells, and a query is looked for in the nearest of them.

    The cells are fitted once, at the first search after a change, and stored with the vectors.  A few thousand vectors are one
    cell, so they are searched exactly."""

    backend = "cells"

    def __init__(self, sample: int = 20_000, cover: float = 0.995) -> None:
        super().__init__()
        self.sample, self.cover = sample, cover
        self._fitted: tuple[DataFrame, V.CellModel, DataFrame] | None = None

    def fitted(self) -> tuple[V.CellModel, DataFrame]:
        held = self._ready()
        if self._fitted is None or self._fitted[0] is not held:
            model = V.fit_cells(held, self.metric.value, self.sample, self.cover)
            self._fitted = (held, model, materialize(V.in_cells(held, model, self.metric.value), "cells"))
        return self._fitted[1:]

    def search_batch(self, queries: DataFrame, top_k: int | str) -> DataFrame:
        model, placed = self.fitted()
        return V.approximate_batch(placed, model, queries, self.metric.value, top_k)

    def _search(self, held: DataFrame, query: Any, top_k: int) -> DataFrame:
        one = self.spark.createDataFrame([(0, query.tolist())], "query_id bigint, qvec array<float>")
        return self.search_batch(one, top_k).orderBy("rank").select("chunk_id", "score")

    def save(self, directory: str) -> None:
        super().save(directory)
        self.save_model(directory)

    def save_model(self, directory: str) -> None:
        model, _ = self.fitted()
        write_json(f"{directory}/cells.json", {"centres": model.centres.tolist(), "probes": model.probes})

    def load(self, directory: str, spark: SparkSession | None = None) -> None:
        super().load(directory, spark)
        self.load_model(directory)

    def load_model(self, directory: str) -> None:
        """The stored cells; where there are none they are fitted anew."""
        if exists(f"{directory}/cells.json"):
            raw = read_json(f"{directory}/cells.json")
            model = V.CellModel(np.array(raw["centres"], float), int(raw["probes"]))
            placed = materialize(V.in_cells(self.vectors, model, self.metric.value), "cells")
            self._fitted = (self.vectors, model, placed)


#: Names under which indexes were saved elsewhere lead to the store that does the same: exact, or by an index.
ALIASES = {"exact": "exact", "numpy": "exact", "np": "exact", "chroma": "exact", "chromadb": "exact", "usearch": "cells", "cells": "cells", "lsh": "cells"}
METRICS = {m: SCORES[m.value] for m in DistanceMetric}


class VectorStoreRegistry:
    @staticmethod
    def create(backend: str, dimension: int, metric: DistanceMetric | str = DistanceMetric.COSINE, spark: SparkSession | None = None, **kwargs: Any):
        name = ALIASES.get(backend.strip().lower())
        if name is None:
            raise ValueError(f"Unknown vector store {backend!r}; known: {sorted(ALIASES)}")
        store = CellVectorStore(**kwargs) if name == "cells" else ExactVectorStore(**kwargs)
        store.initialize(dimension, metric, spark)
        return store
