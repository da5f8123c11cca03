"""Embedders: text to vectors.

The hash embedder is made of Spark expressions.  Others are Python objects with ``embed_documents`` and ``embed_query``; they
run as iterator Arrow functions, so a model is loaded once per task.  Packages are imported only when one is built.
"""

from __future__ import annotations

import importlib.util
from collections.abc import Callable, Iterator
from typing import Any, Protocol, runtime_checkable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from seekstone.errors import EmbeddingError
from seekstone.functions.hashing import hash_embed

#: Fixed value: the instruction that models of this family expect before queries, not before passages.
BGE_QUERY_PREFIX = "Represent this sentence for searching relevant passages: "
DEFAULT_ONNX_MODEL = "BAAI/bge-small-en-v1.5"
DEFAULT_SENTENCE_MODEL = "sentence-transformers/all-MiniLM-L6-v2"


@runtime_checkable
class Embedder(Protocol):
    dimension: int
    model_name: str
    backend: str

    def embed_documents(self, texts: list[str], batch_size: int = 32) -> np.ndarray: ...

    def embed_query(self, text: str) -> np.ndarray: ...


def normalized(matrix: np.ndarray) -> np.ndarray:
    """Rows of unit length; rows of zeros stay."""
    m = np.asarray(matrix, dtype=np.float32)
    n = np.linalg.norm(m, axis=-1, keepdims=True)
    return m / np.where(n > 1e-12, n, 1.0)


class HashEmbedder:
    """The deterministic n-gram embedder; needs no model."""

    backend = "hash"

    def __init__(self, dimension: int = 64, model_name: str | None = None):
        self.dimension = int(dimension)
        self.model_name = model_name or f"hash-{dimension}"

    @property
    def init_kwargs(self) -> dict[str, Any]:
        return {"dimension": self.dimension}

    def embed_table(self, df: DataFrame, key: str, text: str) -> DataFrame:
        return hash_embed(df, key, text, self.dimension)

    def embed_documents(self, texts: list[str], batch_size: int = 32) -> np.ndarray:
        from pyspark.sql import SparkSession

        if not texts:
            return np.zeros((0, self.dimension), np.float32)
        spark = SparkSession.getActiveSession()
        df = spark.createDataFrame(list(enumerate(texts)), "n bigint, t string")
        rows = {r["n"]: r["embedding"] for r in self.embed_table(df, "n", "t").collect()}
        return np.array([rows[n] for n in range(len(texts))], np.float32)

    def embed_query(self, text: str) -> np.ndarray:
        return self.embed_documents([text])[0]


class _ModelEmbedder:
    """What the model-backed embedders share."""

    backend = ""
    #: What the model expects before a query.
    query_prefix = ""

    def recipe(self) -> tuple[str, str, dict[str, Any]] | None:
        """What :class:`EmbedderRegistry` needs to build this embedder again in another process; None if it can't."""
        return self.backend, self.model_name, self.init_kwargs

    def __init__(self, model_name: str, dimension: int, kwargs: dict[str, Any]):
        self.model_name, self.dimension, self._kwargs = model_name, dimension, kwargs

    @property
    def init_kwargs(self) -> dict[str, Any]:
        return {k: v for k, v in self._kwargs.items() if v is not None}

    def _encode(self, texts: list[str], batch_size: int) -> np.ndarray:
        raise NotImplementedError

    def embed_documents(self, texts: list[str], batch_size: int = 32) -> np.ndarray:
        texts = list(texts)
        if not texts:
            return np.zeros((0, self.dimension), np.float32)
        try:
            return self._encode(texts, batch_size)
        except Exception as err:
            raise EmbeddingError(f"{self.backend} failed: {err}") from err

    def embed_queries(self, texts: list[str], batch_size: int = 32) -> np.ndarray:
        """All queries in one call of the model."""
        return self.embed_documents([self.query_prefix + t for t in texts], batch_size)

    def embed_query(self, text: str) -> np.ndarray:
        return self.embed_queries([text])[0]


class OnnxEmbedder(_ModelEmbedder):
    """fastembed's ONNX models; queries of asymmetric models get their instruction."""

    backend = "fastembed"

    def __init__(self, model_name: str | None = None, threads: int | None = None, cache_dir: str | None = None, **kwargs: Any):
        try:
            from fastembed import TextEmbedding
        except ImportError as err:
            raise EmbeddingError("fastembed isn't installed: pip install fastembed") from err
        name = model_name or DEFAULT_ONNX_MODEL
        try:
            self._model = TextEmbedding(model_name=name, threads=threads, cache_dir=cache_dir, **kwargs)
        except Exception as err:
            raise EmbeddingError(f"The model {name!r} can't be loaded: {err}") from err
        size = getattr(self._model, "embedding_size", None) or (self._model.dim() if callable(getattr(self._model, "dim", None)) else None)
        if not size:
            raise EmbeddingError(f"The model {name!r} doesn't tell its dimension.")
        super().__init__(name, int(size), {"threads": threads, "cache_dir": cache_dir, **kwargs})

    def _encode(self, texts: list[str], batch_size: int) -> np.ndarray:
        return normalized(np.stack(list(self._model.embed(texts, batch_size=batch_size))))

    @property
    def query_prefix(self) -> str:
        return BGE_QUERY_PREFIX if "bge" in self.model_name.lower() else ""


class SentenceEmbedder(_ModelEmbedder):
    backend = "sentence-transformers"

    def __init__(self, model_name: str = DEFAULT_SENTENCE_MODEL, device: str | None = None, **kwargs: Any):
        from sentence_transformers import SentenceTransformer

        self._model = SentenceTransformer(model_name, device=device, **kwargs)
        super().__init__(model_name, int(self._model.get_sentence_embedding_dimension()), {"device": device, **kwargs})

    def _encode(self, texts: list[str], batch_size: int) -> np.ndarray:
        return normalized(self._model.encode(texts, batch_size=batch_size, normalize_embeddings=True, convert_to_numpy=True))


def pool(hidden: np.ndarray, mask: np.ndarray, how: str) -> np.ndarray:
    """Token vectors to one: the first, or the mean of those the mask keeps."""
    if how == "cls":
        return hidden[:, 0]
    weights = mask[..., None].astype(hidden.dtype)
    return (hidden * weights).sum(1) / np.maximum(weights.sum(1), 1.0)


class TorchEmbedder(_ModelEmbedder):
    """Any torch module with a tokenizer, pooled, optionally projected."""

    backend = "torch"

    def __init__(
        self,
        model: Any = None,
        tokenizer: Any = None,
        model_name: str | None = None,
        pooling: str = "mean",
        normalize: bool = True,
        projection_dim: int | None = None,
        device: str | None = None,
        max_length: int = 512,
    ):
        if model is None and model_name is None:
            raise EmbeddingError("A torch module or the name of a model is needed.")
        if pooling not in ("mean", "cls"):
            raise EmbeddingError(f"The pooling must be 'mean' or 'cls', not {pooling!r}.")
        if projection_dim is not None and projection_dim <= 0:
            raise EmbeddingError(f"The projected dimension must be above 0, not {projection_dim!r}.")
        import torch

        self._given = model is not None or tokenizer is not None
        if tokenizer is None and model_name is None:
            raise EmbeddingError("A bare torch module needs a tokenizer.")
        if tokenizer is None or model is None:
            from transformers import AutoModel, AutoTokenizer

            tokenizer = tokenizer or AutoTokenizer.from_pretrained(model_name)
            model = model or AutoModel.from_pretrained(model_name)
        self._torch, self._tokenizer = torch, tokenizer
        self._device = device or ("cuda" if torch.cuda.is_available() else "cpu")
        self._model = model.to(self._device).eval()
        width = int(model.config.hidden_size)
        self._projection = torch.nn.Linear(width, projection_dim).to(self._device).eval() if projection_dim else None
        self._pooling, self._normalize, self._max_length = pooling, normalize, int(max_length)
        kwargs = {"pooling": pooling, "normalize": normalize, "device": device, "max_length": max_length, "projection_dim": projection_dim}
        super().__init__(model_name or type(model).__name__, projection_dim or width, kwargs)

    def recipe(self) -> tuple[str, str, dict[str, Any]] | None:
        return None if self._given or self._projection is not None else super().recipe()

    def _encode(self, texts: list[str], batch_size: int) -> np.ndarray:
        parts = []
        with self._torch.no_grad():
            for a in range(0, len(texts), batch_size):
                inputs = self._tokenizer(
                    texts[a : a + batch_size], padding=True, truncation=True, max_length=self._max_length, return_tensors="pt"
                ).to(self._device)
                hidden = self._model(**inputs).last_hidden_state
                pooled = self._torch.as_tensor(
                    pool(hidden.cpu().numpy(), inputs["attention_mask"].cpu().numpy(), self._pooling), device=self._device
                )
                parts.append((self._projection(pooled) if self._projection else pooled).cpu().numpy())
        whole = np.concatenate(parts).astype(np.float32)
        return normalized(whole) if self._normalize else whole


_BUILT: dict[str, Any] = {}


def _in_task(recipe: tuple[str, str, dict[str, Any]]) -> Any:
    """The embedder of a recipe, built once in each worker: models don't travel."""
    name = repr(recipe)
    if name not in _BUILT:
        backend, model, kwargs = recipe
        _BUILT[name] = EmbedderRegistry.create(backend, model_name=model, **kwargs)
    return _BUILT[name]


def embed_table(embedder: Any, df: DataFrame, key: str, text: str, queries: bool = False) -> DataFrame:
    """``(key, embedding)`` by any embedder; ``queries``: the texts are queries, not passages.  Null texts count as empty."""
    if hasattr(embedder, "embed_table"):
        return embedder.embed_table(df, key, text)
    rows = df.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    recipe = embedder.recipe() if hasattr(embedder, "recipe") else None
    given = None if recipe else embedder

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _in_task(recipe) if recipe else given
        for b in batches:
            texts = b.column(1).to_pylist()
            if not queries:
                matrix = model.embed_documents(texts)
            elif hasattr(model, "embed_queries"):
                matrix = model.embed_queries(texts)
            else:
                matrix = [model.embed_query(t) for t in texts]
            vectors = pa.array([v for v in np.asarray(matrix, np.float32)], pa.list_(pa.float32()))
            yield pa.RecordBatch.from_arrays([b.column(0), vectors], ["key", "embedding"])

    kind = dict(rows.dtypes)["key"]
    return rows.mapInArrow(run, f"key {kind}, embedding array<float>").withColumnRenamed("key", key)


_BACKENDS: dict[str, tuple[str | None, Callable[..., Any]]] = {
    "hash": (None, HashEmbedder),
    "fastembed": ("fastembed", OnnxEmbedder),
    "sentence-transformers": ("sentence_transformers", SentenceEmbedder),
    "torch": ("torch", TorchEmbedder),
}
_ALIASES = {
    "fast-embed": "fastembed",
    "fast_embed": "fastembed",
    "sentence_transformers": "sentence-transformers",
    "sentence-transformer": "sentence-transformers",
    "pytorch": "torch",
}


class EmbedderRegistry:
    @staticmethod
    def _name(backend: str) -> str:
        name = backend.strip().lower()
        name = _ALIASES.get(name, name)
        if name not in _BACKENDS:
            raise ValueError(f"Unknown embedder {backend!r}; known: {sorted(_BACKENDS)}")
        return name

    @classmethod
    def create(cls, backend: str, model_name: str | None = None, **kwargs: Any) -> Any:
        name = cls._name(backend)
        package, build = _BACKENDS[name]
        if package and name != "fastembed" and importlib.util.find_spec(package) is None:
            raise ImportError(f"{name} isn't installed: pip install {name}")
        if model_name is not None:
            kwargs["model_name"] = model_name
        return build(**kwargs)

    @classmethod
    def is_available(cls, backend: str) -> bool:
        package, _ = _BACKENDS[cls._name(backend)]
        return package is None or importlib.util.find_spec(package) is not None
