"""Small files of the driver (JSON, atomic), tables of records (JSON lines), and the manifest of an index."""

from __future__ import annotations

import json
import re
import uuid
from dataclasses import asdict, dataclass, field
from datetime import datetime, timezone
from typing import Any

from pyspark.sql import DataFrame, SparkSession, functions as F

from seekstone.errors import SerializationError
from seekstone.schema import DistanceMetric

SCHEMA_MAJOR = 1
SCHEMA_VERSION = "1.0.0"
PACKAGE_VERSION = "0.1.0"


def utc_now() -> str:
    return datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")


class _Place:
    """A path on whatever file system its scheme names, through Spark's own."""

    def __init__(self, path: str):
        context = SparkSession.getActiveSession().sparkContext
        self.hadoop, conf = context._jvm.org.apache.hadoop.fs, context._jsc.hadoopConfiguration()
        self.path = self.hadoop.Path(path)
        self.files = self.path.getFileSystem(conf)
        self.path = self.files.makeQualified(self.path)
        self.context = self.hadoop.FileContext.getFileContext(self.path.toUri(), conf)
        self.gateway = context._gateway

    def exists(self) -> bool:
        return self.files.exists(self.path)

    def read(self) -> bytes:
        self.files.setVerifyChecksum(False)  # small files that people edit
        stream = self.files.open(self.path)
        try:
            return bytes(stream.readAllBytes())
        finally:
            stream.close()

    def replace(self, data: bytes) -> None:
        """All or nothing: written beside the place, then renamed onto it."""
        self.files.setWriteChecksum(False)
        beside = self.hadoop.Path(self.path.getParent(), f".{uuid.uuid4().hex}")
        stream = self.files.create(beside, True)
        try:
            stream.write(bytearray(data))
            stream.close()
            rename = self.hadoop.Options.Rename
            how = self.gateway.new_array(rename, 1)
            how[0] = rename.OVERWRITE
            self.context.rename(beside, self.path, how)
        finally:
            self.files.delete(beside, False)


def exists(path: str) -> bool:
    return _Place(path).exists()


def read_json(path: str) -> Any:
    return json.loads(_Place(path).read().decode("utf-8"))


def write_text(path: str, text: str) -> None:
    """All or nothing, on any file system that Spark knows."""
    _Place(path).replace(text.encode("utf-8"))


def write_json(path: str, value: Any) -> None:
    write_text(path, json.dumps(value, indent=2, ensure_ascii=False) + "\n")


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One record a line; blank lines are skipped."""
    return spark.read.schema(schema).json(path)


def write_jsonl(df: DataFrame, path: str) -> None:
    """One record a line; Spark's commit makes the folder valid as a whole."""
    df.write.mode("overwrite").json(path)


_CORPUS = (
    "record string, id string, document_id string, content string, metadata map<string,string>, chunk_index int, "
    "total_chunks int, seq bigint"
)


def write_corpus(documents: DataFrame, chunks: DataFrame, path: str) -> None:
    """Documents and chunks as tagged records."""
    docs = documents.select(F.lit("document").alias("record"), F.col("doc_id").alias("id"), "content", "metadata", "seq")
    parts = chunks.select(
        F.lit("chunk").alias("record"),
        F.col("chunk_id").alias("id"),
        "document_id",
        "content",
        "metadata",
        "chunk_index",
        "total_chunks",
        "seq",
    )
    write_jsonl(docs.unionByName(parts, allowMissingColumns=True), path)


def read_corpus(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """``(documents, chunks)`` of tagged records; another tag is an error."""
    if not exists(path):
        raise FileNotFoundError(f"There are no records at {path!r}.")
    records = read_jsonl(spark, path, _CORPUS)
    odd = records.filter(~F.coalesce(F.col("record").isin("document", "chunk"), F.lit(False))).select("record").head()
    if odd is not None:
        raise SerializationError(f"Unknown record type {odd['record']!r} in {path!r}.")
    docs = records.filter("record = 'document'").select(F.col("id").alias("doc_id"), "content", "metadata", "seq")
    chunks = records.filter("record = 'chunk'").select(
        F.col("id").alias("chunk_id"), "document_id", "content", "metadata", "chunk_index", "total_chunks", "seq"
    )
    return docs, chunks


# The names and defaults of the manifest's fields, as stored.


@dataclass
class EmbeddingConfig:
    backend: str
    model_name: str
    dimension: int
    kwargs: dict[str, Any] = field(default_factory=dict)


@dataclass
class VectorStoreConfig:
    backend: str
    dimension: int
    metric: str = DistanceMetric.COSINE.value
    kwargs: dict[str, Any] = field(default_factory=dict)


@dataclass
class LexicalConfig:
    backend: str = "bm25"
    k1: float = 1.5
    b: float = 0.75
    lowercase: bool = True
    stopwords: list[str] = field(default_factory=list)


@dataclass
class IndexStats:
    total_documents: int = 0
    total_chunks: int = 0


@dataclass
class Manifest:
    created_at_utc: str
    embedding_config: EmbeddingConfig
    vector_store_config: VectorStoreConfig
    lexical_config: LexicalConfig = field(default_factory=LexicalConfig)
    stats: IndexStats = field(default_factory=IndexStats)
    schema_version: str = SCHEMA_VERSION
    package_version: str = PACKAGE_VERSION
    data: str = "data"

    def to_dict(self) -> dict[str, Any]:
        return asdict(self)

    @classmethod
    def from_dict(cls, raw: dict[str, Any]) -> Manifest:
        try:
            parts = dict(raw)
            for name, kind in (
                ("embedding_config", EmbeddingConfig),
                ("vector_store_config", VectorStoreConfig),
                ("lexical_config", LexicalConfig),
                ("stats", IndexStats),
            ):
                if name in parts:
                    parts[name] = kind(**parts[name])
            manifest = cls(**parts)
            DistanceMetric(manifest.vector_store_config.metric)
            return manifest
        except (TypeError, ValueError) as err:
            raise SerializationError(f"The manifest is malformed: {err}") from err


def check_version(version: str) -> None:
    """Any minor version of the supported major one will do."""
    major = re.match(r"\s*(\d+)", str(version))
    if not major:
        raise SerializationError(f"The schema version {version!r} can't be read.")
    if int(major[1]) != SCHEMA_MAJOR:
        raise SerializationError(f"Schema version {version!r} isn't supported; this package reads {SCHEMA_MAJOR}.x.")
