"""Cutting documents into chunks: fixed windows, recursive splitting, and user-made chunkers.

The two built-in chunkers are Spark expressions from text to an array of chunks; their depth is fixed when the plan is
built.  A user's chunker, any object with ``split_text``, runs as an Arrow UDF.
"""

from __future__ import annotations

from typing import Any, Protocol, runtime_checkable

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from seekstone.errors import ChunkingError
from seekstone.functions.text import NOT_BLANK, strip

#: Paragraphs, lines, sentences, words, characters.
SEPARATORS = ("\n\n", "\n", ". ", " ", "")


@runtime_checkable
class Chunker(Protocol):
    def split_text(self, text: str) -> list[str]: ...


def check_sizes(size: int, overlap: int) -> None:
    if isinstance(size, bool) or not isinstance(size, int) or size <= 0:
        raise ChunkingError(f"The chunk size must be a whole number above 0, not {size!r}.")
    if isinstance(overlap, bool) or not isinstance(overlap, int) or overlap < 0:
        raise ChunkingError(f"The overlap must be a whole number from 0, not {overlap!r}.")
    if overlap >= size:
        raise ChunkingError(f"The overlap ({overlap}) must be smaller than the chunk size ({size}).")


def _not_blank(pieces: Column) -> Column:
    return F.filter(pieces, lambda p: p.rlike(NOT_BLANK))


def _windows(text: Column, size: int, step: int) -> Column:
    """``size`` characters every ``step``, up to the first that reaches the end."""
    last = F.ceil(F.greatest(F.length(text) - size, F.lit(0)) / step).cast("int")
    return F.transform(F.sequence(F.lit(0), last), lambda i: F.substring(text, i * step + 1, F.lit(size)))


def simple_chunks(text: Column, size: int = 500, overlap: int = 50) -> Column:
    """Windows of ``size`` characters of the stripped text, each ``overlap`` back from the one before; blank ones are
    dropped.  Null and blank texts give an empty array."""
    check_sizes(size, overlap)
    # as a lambda's variable the text is stripped once, not once per window
    once = F.array(strip(F.coalesce(text, F.lit(""))))
    return _not_blank(F.flatten(F.transform(once, lambda t: _windows(t, size, size - overlap))))


def _quoted(separator: str) -> str:
    return r"\Q" + separator.replace(r"\E", r"\E\\E\Q") + r"\E"


def _splitter(separator: str, size: int):
    """Of a piece that doesn't fit: texts up to and with a run of separators; a run at the start is one of its own."""
    run = f"(?:{_quoted(separator)})+"
    pattern = F.lit(rf"(?s)\A{run}|.+?(?:{run}|\z)")

    def split(piece: Column) -> Column:
        cut = _not_blank(F.regexp_extract_all(piece, pattern, F.lit(0)))
        return F.when(F.length(piece) > size, cut).otherwise(F.array(piece))

    return split


def recursive_chunks(text: Column, size: int = 500, overlap: int = 50, separators: list[str] | None = None) -> Column:
    """Pieces between separators, the coarse ones first, put together again up to ``size`` characters.

    A piece that fits isn't split further; one that no separator makes fit is cut by length.  A separator stays with the
    text before it.  A new chunk begins with up to ``overlap`` characters of the one before, as far as the next piece leaves
    room.  Null and blank texts give an empty array."""
    check_sizes(size, overlap)
    whole = strip(F.coalesce(text, F.lit("")))
    pieces = _not_blank(F.array(whole))
    for separator in separators or SEPARATORS:
        if not separator:
            break
        pieces = F.flatten(F.transform(pieces, _splitter(separator, size)))
    pieces = F.flatten(
        F.transform(pieces, lambda p: F.when(F.length(p) > size, _windows_disjoint(p, size)).otherwise(F.array(p)))
    )
    start = F.struct(F.lit("").alias("cur"), F.array().cast("array<string>").alias("out"))

    def put(state: Column, piece: Column) -> Column:
        cur, out = state["cur"], state["out"]
        full = (F.length(cur) > 0) & (F.length(cur) + F.length(piece) > size)
        tail = F.least(F.lit(overlap), size - F.length(piece))
        carried = F.when(tail > 0, F.right(cur, tail)).otherwise(F.lit(""))
        return F.struct(
            F.when(full, F.concat(carried, piece)).otherwise(F.concat(cur, piece)).alias("cur"),
            F.when(full, F.concat(out, F.array(cur))).otherwise(out).alias("out"),
        )

    merged = F.aggregate(pieces, start, put, lambda s: F.concat(s["out"], F.array(s["cur"])))
    return _not_blank(merged)


def _windows_disjoint(text: Column, size: int) -> Column:
    last = F.floor((F.length(text) - 1) / size).cast("int")
    return F.transform(F.sequence(F.lit(0), last), lambda i: F.substring(text, i * size + 1, F.lit(size)))


class SimpleCharacterChunker:
    """Fixed windows; :meth:`column` is the expression, :meth:`split_text` the same for one text."""

    def __init__(self, chunk_size: int = 500, chunk_overlap: int = 50):
        check_sizes(chunk_size, chunk_overlap)
        self.chunk_size, self.chunk_overlap = chunk_size, chunk_overlap

    def column(self, text: Column) -> Column:
        return simple_chunks(text, self.chunk_size, self.chunk_overlap)

    def split_text(self, text: str) -> list[str]:
        return _on_one(self, text)


class RecursiveCharacterChunker:
    """Recursive splitting; an empty list of separators means the default."""

    def __init__(self, chunk_size: int = 500, chunk_overlap: int = 50, separators: list[str] | None = None):
        check_sizes(chunk_size, chunk_overlap)
        self.chunk_size, self.chunk_overlap = chunk_size, chunk_overlap
        self.separators = tuple(separators) if separators else SEPARATORS

    def column(self, text: Column) -> Column:
        return recursive_chunks(text, self.chunk_size, self.chunk_overlap, list(self.separators))

    def split_text(self, text: str) -> list[str]:
        return _on_one(self, text)


def _on_one(chunker: Any, text: str) -> list[str]:
    from pyspark.sql import SparkSession

    spark = SparkSession.getActiveSession() or SparkSession.builder.getOrCreate()
    return spark.range(1).select(chunker.column(F.lit(text)).alias("c")).head()["c"]


def chunk_column(chunker: Any, text: Column) -> Column:
    """The chunks of a text by any chunker."""
    if hasattr(chunker, "column"):
        return chunker.column(text)

    @F.pandas_udf("array<string>")
    def split(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: list(chunker.split_text(t or "")))

    return split(text)


def chunk_documents(documents: DataFrame, chunker: Any) -> DataFrame:
    """Chunks with ids, places and metadata.  ``documents``: doc_id, content, metadata, seq.

    ``chunk_id`` is ``<doc_id>_chunk_<index>``; the document's metadata is overlaid by ``chunk_index`` and ``total_chunks``.
    Documents without a chunk give no row.  ``seq`` of a chunk: the document's, as the high part of a pair."""
    # as the row of a generator the chunks are cut once; as a column, again in each filter on their number
    cut = documents.select("doc_id", "metadata", "seq", F.explode(F.array(chunk_column(chunker, F.col("content")))).alias("parts"))
    cut = cut.select("doc_id", "metadata", "seq", F.size("parts").alias("total_chunks"), F.posexplode("parts"))
    own = F.map_filter(
        F.coalesce("metadata", F.create_map().cast("map<string,string>")),
        lambda k, v: ~k.isin("chunk_index", "total_chunks"),
    )
    place = F.create_map(
        F.lit("chunk_index"), F.col("pos").cast("string"), F.lit("total_chunks"), F.col("total_chunks").cast("string")
    )
    return cut.select(
        F.concat("doc_id", F.lit("_chunk_"), F.col("pos").cast("string")).alias("chunk_id"),
        F.col("doc_id").alias("document_id"),
        F.col("col").alias("content"),
        F.map_concat(own, place).alias("metadata"),
        F.col("pos").alias("chunk_index"),
        "total_chunks",
        "seq",
    )
