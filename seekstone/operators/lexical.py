"""The inverted index and BM25.

Postings carry their chunk's length and order, so a batch of searches is one join of query terms with postings, one sum,
and a top-k.  Query terms are few; they are broadcast after a look at their number, and postings of other terms are never
shuffled.  Stored postings lie in order of terms, so few terms prune the scan; the frequencies of terms, and number and
mean length of the chunks, are stored beside them.

A few searches add up their scores in the JVM.  For many, what each posting adds to each search would be a multiple of the
index: there the postings of the searches' terms are shuffled once, by chunk, and each task scores its chunks for all searches,
keeping only the best of each.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F

from seekstone.errors import LexicalError
from seekstone.functions.text import word_counts, words
from seekstone.operators.best import BLOCK_HITS, Best, gathered
from seekstone.schema import LexicalParams

#: Terms of all searches together that are asked at once (some 10 MB); more, or more hits than ``BLOCK_HITS``, go in several rounds.
BLOCK_TERMS = 200_000
#: Up to so many the scores are added up in the JVM.
FEW_TERMS = 64
#: Different terms up to which they are named to the scan.
PUSHED_TERMS = 1_000
#: Scores that a task holds at once, and shares of postings in scores.
TILE = 1_000_000


def check_new(chunk_ids: list[str], texts: list[str], known: set[str] = frozenset()) -> None:
    """For callers that hold ids and texts as lists: equal lengths, no id twice."""
    if len(chunk_ids) != len(texts):
        raise LexicalError(f"There are {len(chunk_ids)} ids but {len(texts)} texts.")
    seen = set(known)
    for i in chunk_ids:
        if i in seen:
            raise LexicalError(f"The chunk {i!r} is indexed already.")
        seen.add(i)


def build_index(chunks: DataFrame, params: LexicalParams, id_col: str = "chunk_id", text: str = "content", seq: str = "seq") -> tuple[DataFrame, DataFrame]:
    """``(postings, lengths)``.  Chunks without a word have a length of 0 and no posting."""
    stop = list(params.stopwords)
    cut = chunks.select(F.col(id_col).alias("chunk_id"), F.col(seq).alias("seq"), F.col(text).alias("_text"))
    lengths = cut.select("chunk_id", F.size(words(F.col("_text"), params.lowercase, stop)).alias("dl"), "seq")
    counted = word_counts(cut, ["chunk_id", "seq"], "_text", params.lowercase, stop)
    return counted.select("term", "chunk_id", "tf", F.col("length").alias("dl"), "seq"), lengths


def in_order(postings: DataFrame) -> DataFrame:
    """Postings as they are stored: by ranges of terms, a frequent one over several."""
    return postings.repartitionByRange("term", "seq").sortWithinPartitions("term", "seq")


def remove(table: DataFrame, ids: DataFrame, column: str = "chunk_id") -> DataFrame:
    """Rows of other chunks; unknown ids do nothing."""
    return table.join(ids.select(column).distinct(), column, "left_anti")


def corpus_stats(lengths: DataFrame) -> DataFrame:
    """``(n, avg_dl)``, one row; empty chunks count."""
    return lengths.agg(F.count(F.lit(1)).alias("n"), F.avg("dl").alias("avg_dl"))


def idf(n: Column, df: Column) -> Column:
    return F.log((n - df + 0.5) / (df + 0.5) + 1.0)


def document_frequencies(postings: DataFrame, lengths: DataFrame) -> DataFrame:
    """``(term, df, idf)``."""
    counted = postings.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    joined = counted.crossJoin(F.broadcast(lengths.agg(F.count(F.lit(1)).alias("n"))))
    return joined.select("term", "df", idf(F.col("n"), F.col("df")).alias("idf"))


def query_terms(queries: DataFrame, params: LexicalParams) -> DataFrame:
    """``(query_id, term)``: each word of a query once."""
    terms = F.array_distinct(words(F.col("query"), params.lowercase, list(params.stopwords)))
    return queries.select("query_id", F.explode(terms).alias("term")).distinct()


def top(ranked: DataFrame, order: list[Column], k: Column | int) -> DataFrame:
    """The first k rows of each query, numbered."""
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(*order)).cast("int")
    return ranked.withColumn("rank", place).filter(F.col("rank") <= k)


def bm25(
    queries: DataFrame,
    postings: DataFrame,
    lengths: DataFrame,
    params: LexicalParams,
    k: str | int = 10,
    frequencies: DataFrame | None = None,
    stats: tuple[int, float] | None = None,
    allowed: DataFrame | None = None,
) -> DataFrame:
    """``(query_id, chunk_id, score, seq, rank)``: the k best chunks of each query (a column of ``queries`` or a number).

    A repeated query word counts once.  Of equal scores the chunk indexed first is first.  Chunks without a word of the
    query aren't found.  ``frequencies`` (term, df) and ``stats`` (chunks, mean length): as stored, else counted here.  With
    ``allowed`` (chunk_id) only those chunks are ranked; frequencies remain those of the whole index."""
    spark = queries.sparkSession
    limit = F.col(k) if isinstance(k, str) else F.lit(k)
    asked = query_terms(queries, params)
    n, mean = stats or tuple(corpus_stats(lengths).first())
    number = asked.count()
    rounds = -(-number // BLOCK_TERMS)
    if number > FEW_TERMS:
        hits = queries.select(F.least(limit, F.lit(n)).alias("k")).filter("k > 0").agg(F.sum("k")).first()[0] or 0
        rounds = max(rounds, -(-hits // BLOCK_HITS))
    found = None
    for r in range(rounds):
        mine = queries if rounds == 1 else queries.filter(F.pmod(F.xxhash64("query_id"), F.lit(rounds)) == r)
        terms = query_terms(mine, params).toPandas()  # about BLOCK_TERMS rows
        part = _bm25_round(spark, terms, mine.select("query_id", limit.alias("k")), postings, params, n, mean or 0.0, frequencies, allowed)
        found = part if found is None else found.unionByName(part)
    if found is None:
        kind = dict(postings.dtypes)["chunk_id"]
        found = spark.createDataFrame([], f"query_id bigint, chunk_id {kind}, score double, seq bigint, k int")
    return top(found, [F.round("score", 9).desc(), F.col("seq")], F.col("k")).drop("k")


def _bm25_round(spark, terms, limits, postings, params, n, mean, frequencies, allowed) -> DataFrame:
    """``(query_id, chunk_id, score, seq, k)``, with all of the k best of each query."""
    names = sorted(set(terms["term"]))
    wanted = F.broadcast(spark.createDataFrame(list(enumerate(names)), "t int, term string"))
    some = F.col("term").isin(names) if len(names) <= PUSHED_TERMS else F.lit(True)
    hits = postings.filter(some).join(wanted, "term")
    if frequencies is None:
        frequencies = postings.filter(some).join(wanted, "term", "left_semi").groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    df = dict(frequencies.filter(some).join(wanted, "term", "left_semi").select("term", "df").collect())  # a row a term
    if allowed is not None:
        hits = hits.join(allowed, "chunk_id", "left_semi")
    tf = F.col("tf").cast("double")
    length = 1.0 - params.b + params.b * F.col("dl") / mean if mean else F.lit(1.0)
    weighed = hits.select("t", "chunk_id", "seq", (tf * (params.k1 + 1.0) / (tf + params.k1 * length)).alias("w"))
    idfs = np.array([np.log((n - df.get(w, 0) + 0.5) / (df.get(w, 0) + 0.5) + 1.0) for w in names])
    place = {w: i for i, w in enumerate(names)}
    t = np.array([place[w] for w in terms["term"]], np.int64)
    ids = terms["query_id"].to_numpy(np.int64)
    ks = {r["query_id"]: r["k"] or 0 for r in limits.dropDuplicates(["query_id"]).collect()}  # a row a query of this round
    if len(t) <= FEW_TERMS:
        rows = [(int(q), int(i), float(idfs[i]), int(ks[q])) for q, i in zip(ids, t)]
        if not rows:
            rows_df = spark.createDataFrame([], "query_id bigint, t int, idf double, k int")
        else:
            rows_df = spark.createDataFrame(rows, "query_id bigint, t int, idf double, k int")
        scored = weighed.join(F.broadcast(rows_df), "t").groupBy("query_id", "chunk_id", "seq", "k")
        return scored.agg(F.sum(F.col("idf") * F.col("w")).alias("score")).select("query_id", "chunk_id", "score", "seq", "k")
    asked, q = np.unique(ids, return_inverse=True)
    deep = np.array([ks[i] for i in asked], np.int64)
    order = np.argsort(t, kind="stable")
    shared = spark.sparkContext.broadcast(
        (asked, deep, q.ravel()[order].astype(np.int32), np.searchsorted(t[order], np.arange(len(names) + 1)), idfs)
    )
    kind = dict(postings.dtypes)["chunk_id"]
    by_chunk = weighed.repartition("chunk_id").sortWithinPartitions("chunk_id")
    return gathered(by_chunk, int(deep.sum())).mapInArrow(
        lambda b: _score_chunks(b, shared), f"query_id bigint, chunk_id {kind}, score double, seq bigint, k int"
    )


def _score_chunks(batches: Iterator[pa.RecordBatch], shared) -> Iterator[pa.RecordBatch]:
    """Weighed postings ``(t, chunk_id, seq, w)``, those of a chunk together -> of each search the best chunks of these."""
    asked, ks, searches, cuts, idfs = shared.value
    tile = max(1, TILE // max(1, len(asked)))
    best, none = Best(ks), np.nextafter(0.0, 1.0)
    held: list[pa.RecordBatch] = []

    def score(table: pa.Table) -> None:
        chunk, t = table.column("chunk_id").combine_chunks(), table.column("t").to_numpy()
        new = np.r_[True, pc.not_equal(chunk[1:], chunk[:-1]).to_numpy(zero_copy_only=False)]
        which, first = np.cumsum(new) - 1, np.flatnonzero(new)
        weight, seq = table.column("w").to_numpy() * idfs[t], table.column("seq").to_numpy()[first]
        base, times = best.rows(chunk.take(pa.array(first))), cuts[t + 1] - cuts[t]
        shares = np.r_[0, np.cumsum(np.add.reduceat(times, first))]  # before each chunk
        a = 0
        while a < len(first):
            n = int(min(tile, max(1, np.searchsorted(shares, shares[a] + TILE, "right") - 1 - a), len(first) - a))
            rows = slice(first[a], first[a + n] if a + n < len(first) else len(t))
            many = times[rows]
            at = np.arange(many.sum()) + np.repeat(cuts[t[rows]] - (np.cumsum(many) - many), many)
            place = searches[at].astype(np.int64) * n + np.repeat(which[rows] - a, many)
            s = np.bincount(place, np.repeat(weight[rows], many), len(asked) * n).reshape(len(asked), n)
            i, j = np.nonzero(s >= np.maximum(best.bound, none)[:, None])
            best.add(i, s[i, j], seq[a + j], base + a + j)
            a += n

    if not ks.any():
        return
    for batch in batches:
        if not len(batch):
            continue
        held.append(batch)
        if sum(map(len, held)) < 100_000:
            continue
        table = pa.Table.from_batches(held).combine_chunks()
        chunk = table.column("chunk_id").combine_chunks()
        changes = np.flatnonzero(pc.not_equal(chunk[1:], chunk[:-1]).to_numpy(zero_copy_only=False))
        if len(changes):  # the last chunk waits for the next batch
            cut = int(changes[-1]) + 1
            score(table.slice(0, cut).combine_chunks())
            held = table.slice(cut).combine_chunks().to_batches()
    if held:
        score(pa.Table.from_batches(held).combine_chunks())
    yield from best.batches(asked)
