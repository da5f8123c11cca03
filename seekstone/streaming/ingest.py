"""Continuous ingestion: a stream of documents into an engine, by micro-batches.

A batch is an upsert by document id, so a batch that is delivered again changes nothing but the order of its chunks.
"""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame, functions as F


def ingest_stream(engine: Any, stream: DataFrame, checkpoint: str, chunk_size: int = 500, chunk_overlap: int = 50, trigger: dict | None = None):
    """Start a query that feeds ``stream`` (doc_id, content[, metadata]) to ``engine``; returns the streaming query."""

    def upsert(batch: DataFrame, epoch: int) -> None:
        columns = set(batch.columns)
        given = F.col("metadata") if "metadata" in columns else F.create_map()
        order = F.col("seq") if "seq" in columns else F.monotonically_increasing_id()
        rows = batch.select("doc_id", "content", given.cast("map<string,string>").alias("metadata"), order.cast("bigint").alias("seq"))
        if not rows.isEmpty():
            engine.add_table(rows, chunk_size, chunk_overlap)

    writer = stream.writeStream.foreachBatch(upsert).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start()
