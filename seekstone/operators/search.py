"""Search for batches of queries, as one plan over the tables of an index.

The ranking comes first: it holds some rows a query, whatever the size of the index.  Only then are the chunks it names, and
their documents, fetched for the filter and the content, so neither texts nor metadata of the collection are shuffled.

Semantics to know:

* a metadata filter is applied *after* ranking, to a candidate list widened to ``max(4 * top_k, 40)``: a result can hold fewer
  than ``top_k`` hits, even none, although more chunks match.  ``prefilter=True`` filters first instead;
* hybrid search without a filter merges only the first ``top_k`` of each side.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from seekstone.functions.text import is_blank
from seekstone.functions.vectors import EPS
from seekstone.metadata import matches, matches_each
from seekstone.operators import fusion
from seekstone.operators.lexical import bm25, top
from seekstone.operators.vector import knn_batch
from seekstone.schema import DistanceMetric, FusionStrategy, LexicalParams, SearchMode, coerce
from seekstone.session import materialize

#: Chunks named by a ranking up to which their ids are broadcast; more are joined by a shuffle.
BROADCAST_MATCHES = 200_000


@dataclass
class IndexTables:
    documents: DataFrame
    chunks: DataFrame
    vectors: DataFrame
    postings: DataFrame
    lengths: DataFrame
    #: (term, df), and (chunks, mean length), where they are stored
    frequencies: DataFrame | None = None
    stats: tuple[int, float] | None = None
    #: how vectors are searched, (queries, k) to a ranking; exactly where it isn't said
    nearest: Callable[[DataFrame, int | str], DataFrame] | None = None


def candidate_count(top_k: int, filtered: bool) -> int:
    return max(4 * top_k, 40) if filtered else top_k


def candidates(tables: IndexTables, wanted: dict[str, str]) -> DataFrame:
    """``(chunk_id)`` of the chunks that match; keys a chunk lacks are looked up in its document."""
    documents = tables.documents.select(F.col("doc_id").alias("document_id"), F.col("metadata").alias("inherited"))
    rows = tables.chunks.select("chunk_id", "document_id", "metadata").join(documents, "document_id", "left")
    return rows.filter(matches(wanted, F.col("metadata"), F.col("inherited"))).select("chunk_id")


def _limited(table: DataFrame, allowed: DataFrame | None) -> DataFrame:
    return table if allowed is None else table.join(allowed, "chunk_id", "left_semi")


def search_rankings(
    tables: IndexTables,
    queries: DataFrame,
    top_k: int = 5,
    mode: SearchMode | str = SearchMode.HYBRID,
    alpha: float = 0.5,
    strategy: FusionStrategy | str = FusionStrategy.RRF,
    wanted: dict[str, str] | None = None,
    params: LexicalParams = LexicalParams(),
    metric: DistanceMetric | str = DistanceMetric.COSINE,
    prefilter: bool = False,
) -> DataFrame:
    """``(query_id, chunk_id, score, vector_score, lexical_score, rank)``.

    ``queries``: query_id bigint, query string, and for vector and hybrid search qvec.  Blank queries and a ``top_k`` of 0 or
    less find nothing; an empty filter is none."""
    mode, strategy = coerce(SearchMode, mode), coerce(FusionStrategy, strategy)
    queries = queries.filter(~is_blank(F.col("query")))
    if top_k <= 0:
        queries = queries.limit(0)
    allowed = candidates(tables, wanted) if wanted and prefilter else None
    k = candidate_count(top_k, bool(wanted) and not prefilter)
    vectors, after = tables.vectors, wanted
    if prefilter:  # frequencies of words remain those of the whole index
        vectors, after = _limited(vectors, allowed), None
    none = F.lit(None).cast("double")
    if mode is not SearchMode.VECTOR:
        lexical = bm25(
            queries, tables.postings, tables.lengths, params, k, tables.frequencies, tables.stats, allowed if prefilter else None
        ).select("query_id", "chunk_id", "score", "rank")
    if mode is SearchMode.BM25:
        return _cut(tables, lexical, after, top_k, [F.col("rank")], none, F.col("score"))
    if tables.nearest is not None and not prefilter:
        near = tables.nearest(queries, k)
    else:
        near = knn_batch(vectors, queries, coerce(DistanceMetric, metric).value, k)
    near = near.select("query_id", "chunk_id", "score", "rank")
    if mode is SearchMode.VECTOR:
        return _cut(tables, near, after, top_k, [F.col("rank")], F.col("score"), none)
    # the scores of both sides travel through the merge, so neither ranking is computed or joined again
    near = near.withColumns({"vector_score": F.col("score"), "lexical_score": none})
    lexical = lexical.withColumns({"vector_score": none, "lexical_score": F.col("score")})
    fused = fusion.fuse([near, lexical], strategy, alpha, carry=("vector_score", "lexical_score"))
    fused = fused.withColumnRenamed("rank", "place")
    return _cut(tables, fused, after, top_k, [F.col("place")], F.col("vector_score"), F.col("lexical_score"))


def _named(table: DataFrame, key: str, names: DataFrame) -> DataFrame:
    """The rows of a large table whose ``key`` is in the column of the same name of ``names``, a stored table."""
    ids = names.select(key).distinct()
    return table.join(F.broadcast(ids) if names.count() <= BROADCAST_MATCHES else ids, key, "left_semi")


def described(tables: IndexTables, ranked: DataFrame) -> DataFrame:
    """``(chunk_id, own, inherited)``: metadata of the chunks that a stored ranking names, and of their documents."""
    chunks = _named(tables.chunks.select("chunk_id", "document_id", F.col("metadata").alias("own")), "chunk_id", ranked)
    chunks = materialize(chunks, "named")
    documents = tables.documents.select(F.col("doc_id").alias("document_id"), F.col("metadata").alias("inherited"))
    return chunks.join(_named(documents, "document_id", chunks), "document_id", "left").drop("document_id")


def _cut(tables: IndexTables, ranked: DataFrame, wanted, k: int, order: list[Column], v: Column, x: Column) -> DataFrame:
    kept = ranked.withColumns({"vector_score": v, "lexical_score": x})
    if wanted:
        kept = materialize(kept, "ranked")
        about = described(tables, kept).filter(matches(wanted, F.col("own"), F.col("inherited")))
        kept = kept.join(about.select("chunk_id"), "chunk_id", "left_semi")
    return top(kept, order, k).select("query_id", "chunk_id", "score", "vector_score", "lexical_score", "rank")


def search_requests(
    tables: IndexTables,
    requests: DataFrame,
    params: LexicalParams = LexicalParams(),
    metric: DistanceMetric | str = DistanceMetric.COSINE,
) -> DataFrame:
    """Many searches, each in its own way: ``(query_id, chunk_id, score, vector_score, lexical_score, rank)``.

    ``requests``: query_id bigint (each once), query string, qvec array, search_mode (null: hybrid), top_k int, fusion (null: rrf),
    alpha double (null: 0.5), metadata_filter map (null or empty: none).  A blank query or a ``top_k`` that is null, 0 or less finds
    nothing; nor does a vector search without a vector, while a hybrid one then ranks by words alone.  An unknown mode or fusion is
    an error.  The rules are those of :func:`search_rankings`.  An empty table gives no row."""

    def checked(column: str, kind: type, default: str) -> Column:
        value = F.coalesce(F.lower(F.trim(F.col(column))), F.lit(default))
        names = [m.value for m in kind]
        odd = F.raise_error(F.concat(F.lit(f"no {kind.__name__}: "), value)).cast("string")
        return F.when(value.isin(names), value).otherwise(odd)

    has = F.coalesce(F.size("metadata_filter"), F.lit(0)) > 0
    asked = requests.filter(~is_blank(F.col("query")) & (F.col("top_k") > 0)).select(
        "query_id",
        "query",
        "qvec",
        checked("search_mode", SearchMode, "hybrid").alias("mode"),
        F.col("top_k").cast("int").alias("top_k"),
        checked("fusion", FusionStrategy, "rrf").alias("fusion"),
        F.coalesce("alpha", F.lit(0.5)).alias("alpha"),
        F.when(has, F.col("metadata_filter")).alias("wanted"),
        F.when(has, F.greatest(F.col("top_k") * 4, F.lit(40))).otherwise(F.col("top_k")).cast("int").alias("wide"),
    )
    asked = materialize(asked, "requests")
    lexical = bm25(
        asked.filter("mode <> 'vector'"), tables.postings, tables.lengths, params, "wide", tables.frequencies, tables.stats
    )
    nearest = tables.nearest or (lambda q, k: knn_batch(tables.vectors, q, coerce(DistanceMetric, metric).value, k))
    near = nearest(asked.filter("mode <> 'bm25'"), "wide")
    both = near.select("query_id", "chunk_id", "score", "rank", F.lit(True).alias("near")).unionByName(
        lexical.select("query_id", "chunk_id", "score", "rank", F.lit(False).alias("near"))
    )
    how = asked.select("query_id", "mode", "top_k", "fusion", "alpha", "wanted")
    both = both.join(how, "query_id")
    side = Window.partitionBy("query_id", "near")
    low, high = F.min("score").over(side), F.max("score").over(side)
    scaled = F.when(high - low < EPS, F.lit(1.0)).otherwise((F.col("score") - low) / (high - low))
    weight = F.when(F.col("near"), F.col("alpha")).otherwise(1 - F.col("alpha"))
    share = F.when(F.col("fusion") == "rrf", 1.0 / (fusion.RRF_K + F.col("rank"))).otherwise(weight * scaled)
    both = both.withColumn("share", F.when(F.col("mode") == "hybrid", share).otherwise(F.col("score")))
    merged = both.groupBy("query_id", "chunk_id", "mode", "top_k").agg(
        F.sum("share").alias("score"),
        F.max(F.when(F.col("near"), F.col("score"))).alias("vector_score"),
        F.max(F.when(~F.col("near"), F.col("score"))).alias("lexical_score"),
        F.max(F.when(F.col("mode") != "hybrid", F.col("rank"))).alias("place"),
        F.first("wanted").alias("wanted"),
    )
    merged = materialize(merged, "ranked")
    filtered = merged.filter("wanted IS NOT NULL")
    kept = filtered.join(described(tables, filtered), "chunk_id").filter(
        matches_each(F.col("wanted"), F.col("own"), F.col("inherited"))
    )
    rows = merged.filter("wanted IS NULL").unionByName(kept.select(*merged.columns))
    order = [F.col("place"), F.round("score", 12).desc(), F.col("chunk_id")]  # hybrid rows have no place yet
    return top(rows, order, F.col("top_k")).select("query_id", "chunk_id", "score", "vector_score", "lexical_score", "rank")


def with_content(rankings: DataFrame, chunks: DataFrame) -> DataFrame:
    """The result rows: rankings with their chunks."""
    rankings = materialize(rankings, "rankings")
    rows = _named(chunks.select("chunk_id", "document_id", "content", "metadata"), "chunk_id", rankings)
    few = rankings.count() <= BROADCAST_MATCHES
    return rows.join(F.broadcast(rankings) if few else rankings, "chunk_id").select(
        "query_id", "chunk_id", "document_id", "content", "score", "metadata", "vector_score", "lexical_score", "rank"
    )


def context_text(results: DataFrame) -> DataFrame:
    """``(query_id, context)``: the hits of each query as one text for a language model, in order."""
    block = F.format_string("[%d] (Score: %.4f, Doc ID: %s)\n%s", "rank", "score", "document_id", "content")
    hits = F.array_sort(F.collect_list(F.struct("rank", block.alias("block"))))  # top_k of them
    return results.groupBy("query_id").agg(F.array_join(F.transform(hits, lambda h: h["block"]), "\n\n").alias("context"))
