"""Retrieval over large text collections on Spark: chunking, BM25, vectors, fusion, search."""

from seekstone.embedders import Embedder, EmbedderRegistry, HashEmbedder, OnnxEmbedder, SentenceEmbedder, TorchEmbedder
from seekstone.engine import Engine
from seekstone.errors import (
    ChunkingError,
    EmbeddingError,
    IncompatibleBackendError,
    LexicalError,
    SeekstoneError,
    SerializationError,
    VectorStoreError,
)
from seekstone.functions.text import STOPWORDS, words
from seekstone.functions.vectors import l2_normalize
from seekstone.operators.chunking import Chunker, RecursiveCharacterChunker, SimpleCharacterChunker
from seekstone.operators.fusion import fuse, linear, minmax, rrf, zscore
from seekstone.operators.lexical import bm25, build_index
from seekstone.schema import DistanceMetric, Document, FusionStrategy, LexicalParams, QueryResult, SearchMode
from seekstone.sources.files import EmbeddingConfig, IndexStats, LexicalConfig, Manifest, VectorStoreConfig
from seekstone.stores import ExactVectorStore, CellVectorStore, VectorStoreRegistry
from seekstone.tool import SearchTool

__version__ = "0.1.0"
__all__ = [n for n in dir() if n[0] != "_"]
