"""The queries of the driver contract for the engine's own operators, and the same in DuckDB's SQL.

Texts: ``documents`` (``doc_id`` stands for chunk id and order; null texts are empty).  Vectors: ``embeddings``.  Hybrid: both,
joined on ``doc_id = vec_id``.  Scores are rounded to 6 digits on both sides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from seekstone.engine import Engine
from seekstone.functions.hashing import hash_embed
from seekstone.functions.text import STOPWORDS, is_blank, strip, words
from seekstone.functions.vectors import l2_normalize
from seekstone.metadata import canonical, matches
from seekstone.operators import fusion
from seekstone.operators.chunking import recursive_chunks, simple_chunks
from seekstone.operators.lexical import bm25, build_index, corpus_stats, document_frequencies, remove
from seekstone.operators.search import IndexTables, context_text, search_rankings, search_requests, with_content
from seekstone.operators.vector import approximate_batch, fit_cells, in_cells, knn, knn_batch
from seekstone.schema import LexicalParams
from seekstone.session import materialize, new_path, spread
from seekstone.sources.tables import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = sql
        return f

    return add


# shared pieces

WS = (
    "(chr(9)||chr(10)||chr(11)||chr(12)||chr(13)||chr(28)||chr(29)||chr(30)||chr(31)||' '||chr(133)||chr(160)||chr(5760)||"
    "chr(8192)||chr(8193)||chr(8194)||chr(8195)||chr(8196)||chr(8197)||chr(8198)||chr(8199)||chr(8200)||chr(8201)||chr(8202)||"
    "chr(8232)||chr(8233)||chr(8239)||chr(8287)||chr(12288))"
)
FOLD = "replace(replace(replace(replace(lower({0}),'ß','ss'),'ﬁ','fi'),'ﬀ','ff'),'ﬂ','fl')"
TOKENS = "regexp_extract_all(" + FOLD.format("coalesce({0},'')") + ", '[\\p{{L}}\\p{{N}}_]+')"
STOP = "[" + ",".join("'" + w.replace("'", "''") + "'" for w in STOPWORDS) + "]"
#: The single searches: id, text, and the vector (by its id) that stands for the text.
ONE = (1, "the large archive and the query", 3)


def _texts(spark: SparkSession, folder: str) -> DataFrame:
    return spread(table(spark, folder, "documents"))


def _documents(spark: SparkSession, folder: str) -> DataFrame:
    """chunk_id, content, seq, metadata."""
    pairs = F.map_filter(F.create_map(F.lit("lang"), F.col("lang"), F.lit("source"), F.col("source")), lambda k, v: v.isNotNull())
    return _texts(spark, folder).select(
        F.col("doc_id").alias("chunk_id"), F.coalesce("text", F.lit("")).alias("content"), F.col("doc_id").alias("seq"), pairs.alias("metadata")
    )


def _vectors(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "embeddings").select(F.col("vec_id").alias("chunk_id"), "embedding", F.col("vec_id").alias("seq"))


def _batch(spark: SparkSession, folder: str) -> DataFrame:
    """All searches of the table queries that aren't blank, each id once, and for each a vector: of those whose id is divisible by
    100, in order, the one whose number is the remainder of the query's id."""
    rows = table(spark, folder, "queries").select("query_id", "query").dropDuplicates(["query_id"]).filter(~is_blank(F.col("query")))
    return rows.join(F.broadcast(_numbered(spark, folder)), F.col("query_id") % F.col("m") == F.col("i")).drop("m", "i")


def _numbered(spark: SparkSession, folder: str) -> DataFrame:
    """i, m, vec_id, qvec: every hundredth vector with its number, and how many there are (fixed, some dozens)."""
    vectors = table(spark, folder, "embeddings").filter("vec_id % 100 = 0").select("vec_id", F.col("embedding").alias("qvec"))
    place = F.row_number().over(Window.orderBy("vec_id")) - 1
    return vectors.withColumn("i", place).crossJoin(vectors.agg(F.count(F.lit(1)).alias("m")))


def _one(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([ONE], "query_id bigint, query string, vec_id bigint")


def _asked(spark: SparkSession, folder: str) -> DataFrame:
    """The table of searches, each id once: query_id, query, top_k."""
    return table(spark, folder, "queries").select("query_id", "query", "top_k").dropDuplicates(["query_id"])


def _usable(vector: Column) -> Column:
    """64 finite numbers, not all zero."""
    norm = F.aggregate(vector, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    return (F.size(vector) == 64) & (norm > 0) & (norm < float("inf")) & ~F.isnan(norm)


def _chunk_vectors(spark: SparkSession, folder: str) -> DataFrame:
    """The usable embeddings of the table chunks, each id once: chunk_id, embedding, seq."""
    rows = table(spark, folder, "chunks").select("id", "embedding", "seq").filter(_usable(F.col("embedding")))
    first = rows.groupBy(F.col("id").alias("chunk_id")).agg(F.min_by("embedding", "seq").alias("embedding"), F.min("seq").alias("seq"))
    return first


def _hundredth(spark: SparkSession, folder: str) -> DataFrame:
    """Every vector whose id is divisible by 100, as a query."""
    rows = table(spark, folder, "embeddings").filter("vec_id % 100 = 0")
    return rows.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("qvec"))


def _r(column: str | Column) -> Column:
    return F.round(column, 6)


_NUMBERED = "(SELECT vec_id, embedding, row_number() OVER (ORDER BY vec_id) - 1 AS i, count(*) OVER () AS m FROM embeddings WHERE vec_id % 100 = 0)"
_BATCH = f"""(SELECT query_id, query, vec_id FROM (SELECT query_id, any_value(query) AS query FROM queries GROUP BY query_id)
    JOIN {_NUMBERED} ON query_id % m = i WHERE trim(coalesce(query, ''), {WS}) <> '') AS b"""
_ONE = f"(VALUES ({ONE[0]}::BIGINT,'{ONE[1]}',{ONE[2]}::BIGINT)) AS b(query_id, query, vec_id)"


def _lexical_sql(k1=1.5, b=0.75, k: object = 10, stop: bool = False, where: str = "", docs: str = "", batch: str | None = None) -> str:
    """CTEs d (chunk_id, toks), ... and lex (query_id, chunk_id, score, rank)."""
    tok = TOKENS.format("{0}")
    doc_toks, query_toks = TOKENS.format("content"), TOKENS.format("query")
    if stop:
        doc_toks, query_toks = (f"list_filter({t}, lambda w: NOT list_contains({STOP}, w))" for t in (doc_toks, query_toks))
    del tok
    docs = docs or "SELECT doc_id AS chunk_id, doc_id AS seq, coalesce(text,'') AS content FROM documents"
    return f"""src AS ({docs}),
    d AS (SELECT chunk_id, seq, {doc_toks} AS toks FROM src {where}),
    len AS (SELECT chunk_id, seq, len(toks)::INT AS dl FROM d),
    post AS (SELECT term, chunk_id, count(*)::INT AS tf FROM (SELECT chunk_id, unnest(toks) AS term FROM d) GROUP BY term, chunk_id),
    st AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM len),
    idf AS (SELECT term, count(*) AS df, ln((any_value(n) - count(*) + 0.5) / (count(*) + 0.5) + 1) AS idf FROM post, st GROUP BY term),
    q AS (SELECT DISTINCT query_id, unnest({query_toks}) AS term FROM {batch or _BATCH}),
    sc AS (SELECT query_id, chunk_id, seq, sum(idf * tf * ({k1} + 1) / (tf + {k1} * (1 - {b} + {b} * dl / avgdl))) AS score
        FROM q JOIN post USING (term) JOIN idf USING (term) JOIN len USING (chunk_id), st GROUP BY query_id, chunk_id, seq),
    lex AS (SELECT query_id, chunk_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id
        ORDER BY round(score, 9) DESC, seq)::INT AS rank FROM sc) WHERE rank <= {k})"""


_SCORE_SQL = {
    "cosine": "list_cosine_similarity(v.embedding::DOUBLE[], w.embedding::DOUBLE[])",
    "inner_product": "list_dot_product(v.embedding::DOUBLE[], w.embedding::DOUBLE[])",
    "l2": "1 / (1 + list_distance(v.embedding::DOUBLE[], w.embedding::DOUBLE[]) ** 2)",
}


def _near_sql(k: object = 10, metric: str = "cosine", among: str = "embeddings", batch: str = _BATCH) -> str:
    """CTE vec (query_id, chunk_id, score, rank)."""
    return f"""vec AS (SELECT query_id, chunk_id, score, rank FROM (SELECT query_id, v.vec_id AS chunk_id,
        {_SCORE_SQL[metric]} AS score, row_number() OVER (PARTITION BY query_id ORDER BY round({_SCORE_SQL[metric]}, 9) DESC,
        v.vec_id)::INT AS rank FROM {among} v, {batch} JOIN embeddings w ON w.vec_id = b.vec_id) WHERE rank <= {k})"""


# text

@query(f"SELECT doc_id, len({TOKENS.format('text')})::INT AS n_tokens, len(list_distinct({TOKENS.format('text')}))::INT AS n_terms FROM documents")
def tokenize_counts(spark, folder):
    t = words(F.col("text"))
    return _texts(spark, folder).select("doc_id", F.size(t).alias("n_tokens"), F.size(F.array_distinct(t)).alias("n_terms"))


@query(f"SELECT doc_id, len(list_filter({TOKENS.format('text')}, lambda w: NOT list_contains({STOP}, w)))::INT AS n_tokens FROM documents")
def tokenize_stopwords(spark, folder):
    return _texts(spark, folder).select("doc_id", F.size(words(F.col("text"), stopwords=list(STOPWORDS))).alias("n_tokens"))


@query(f"SELECT doc_id, len(regexp_extract_all(coalesce(text,''), '[\\p{{L}}\\p{{N}}_]+'))::INT AS n_tokens, md5(array_to_string(regexp_extract_all(coalesce(text,''), '[\\p{{L}}\\p{{N}}_]+'), ' ')) AS digest FROM documents")
def tokenize_as_written(spark, folder):
    t = words(F.col("text"), lowercase=False)
    return _texts(spark, folder).select("doc_id", F.size(t).alias("n_tokens"), F.md5(F.array_join(t, " ")).alias("digest"))


@query(f"SELECT doc_id, md5(trim(coalesce(text,''), {WS})) AS digest, (trim(coalesce(text,''), {WS}) = '') AS blank FROM documents")
def strip_text(spark, folder):
    text = F.coalesce("text", F.lit(""))
    return _texts(spark, folder).select("doc_id", F.md5(strip(text)).alias("digest"), is_blank(text).alias("blank"))


# chunking

def _simple_sql(size: int, overlap: int) -> str:
    step = size - overlap
    return f"""WITH s AS (SELECT doc_id, trim(coalesce(text,''), {WS}) AS t FROM documents),
    w AS (SELECT doc_id, list_filter(list_transform(range(0, ceil(greatest(length(t) - {size}, 0) / {step})::BIGINT + 1),
        lambda i: substring(t, i * {step} + 1, {size})), lambda p: trim(p, {WS}) <> '') AS parts FROM s)
    SELECT doc_id, (i - 1)::INT AS chunk_index, length(parts[i])::INT AS n_chars, md5(parts[i]) AS digest
    FROM (SELECT doc_id, parts, unnest(range(1, len(parts) + 1)) AS i FROM w)"""


def _chunk_rows(df: DataFrame, chunks: Column) -> DataFrame:
    return df.select("doc_id", F.posexplode(chunks)).select(
        "doc_id", F.col("pos").alias("chunk_index"), F.length("col").alias("n_chars"), F.md5("col").alias("digest")
    )


@query(_simple_sql(500, 50))
def chunk_simple(spark, folder):
    return _chunk_rows(_texts(spark, folder), simple_chunks(F.col("text"), 500, 50))


@query(_simple_sql(200, 0))
def chunk_simple_disjoint(spark, folder):
    return _chunk_rows(_texts(spark, folder), simple_chunks(F.col("text"), 200, 0))


def _recursive_sql(size: int, overlap: int) -> str:
    pieces = "[t]"
    for sep in (r"\n\n", r"\n", r"\. ", " "):
        run = f"(?:{sep})+"
        pieces = f"""flatten(list_transform({pieces}, lambda p: CASE WHEN length(p) > {size} THEN list_filter(
            regexp_extract_all(p, '(?s)\\A{run}|.+?(?:{run}|\\z)'), lambda x: trim(x, {WS}) <> '') ELSE [p] END))"""
    pieces = f"""flatten(list_transform({pieces}, lambda p: CASE WHEN length(p) > {size} THEN list_transform(
        range(0, ((length(p) - 1) // {size}) + 1), lambda i: substring(p, i * {size} + 1, {size})) ELSE [p] END))"""
    full = f"cur <> '' AND length(cur) + length(ps[i]) > {size}"
    tail = f"least({overlap}, {size} - length(ps[i]))"
    return f"""WITH RECURSIVE s AS (SELECT doc_id, trim(coalesce(text,''), {WS}) AS t FROM documents),
    p AS (SELECT doc_id, {pieces} AS ps FROM s WHERE t <> ''),
    m AS (SELECT doc_id, 1 AS i, '' AS cur, 0 AS k, NULL::VARCHAR AS done, ps FROM p
        UNION ALL SELECT doc_id, i + 1,
            CASE WHEN i > len(ps) THEN '' WHEN {full} THEN (CASE WHEN {tail} > 0 THEN right(cur, {tail}) ELSE '' END) || ps[i]
                ELSE cur || ps[i] END,
            k + (done IS NOT NULL)::INT,
            CASE WHEN i > len(ps) THEN nullif(cur, '') WHEN {full} THEN cur END, ps
        FROM m WHERE i <= len(ps) + 1),
    c AS (SELECT doc_id, i, done FROM m WHERE done IS NOT NULL AND trim(done, {WS}) <> '')
    SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1)::INT AS chunk_index, length(done)::INT AS n_chars,
        md5(done) AS digest FROM c"""


@query(_recursive_sql(300, 40))
def chunk_recursive(spark, folder):
    return _chunk_rows(_texts(spark, folder), recursive_chunks(F.col("text"), 300, 40))


@query(_recursive_sql(120, 0))
def chunk_recursive_disjoint(spark, folder):
    return _chunk_rows(_texts(spark, folder), recursive_chunks(F.col("text"), 120, 0))


@query(
    f"""SELECT doc_id || '_chunk_' || i AS chunk_id, lang, source, i::INT AS chunk_index, n::INT AS total_chunks FROM
    (SELECT *, unnest(range(0, n)) AS i FROM (SELECT doc_id, lang, source, CASE WHEN t = '' THEN 0 ELSE
    ceil(greatest(length(t) - 500, 0) / 500)::BIGINT + 1 END AS n FROM (SELECT *, trim(coalesce(text,''), {WS}) AS t FROM documents)))"""
)
def chunk_metadata(spark, folder):
    """Chunk ids, and the document's metadata overlaid by the chunk's place.  Windows of 500 without overlap."""
    from seekstone.operators.chunking import SimpleCharacterChunker, chunk_documents

    docs = _documents(spark, folder).select(F.col("chunk_id").cast("string").alias("doc_id"), "content", "metadata", "seq")
    cut = chunk_documents(docs, SimpleCharacterChunker(500, 0))
    get = lambda k: F.element_at("metadata", F.lit(k))
    return cut.select(
        "chunk_id", get("lang").alias("lang"), get("source").alias("source"), get("chunk_index").cast("int").alias("chunk_index"), get("total_chunks").cast("int").alias("total_chunks")
    )


# lexical index

def _index(spark, folder, params=LexicalParams(), docs: DataFrame | None = None):
    return build_index(docs if docs is not None else _documents(spark, folder), params)


@query(f"WITH {_lexical_sql()} SELECT term, chunk_id, tf FROM post")
def postings(spark, folder):
    return _index(spark, folder)[0].select("term", "chunk_id", "tf")


@query(f"WITH {_lexical_sql()} SELECT term, df, round(idf, 6) AS idf FROM idf")
def doc_freq_idf(spark, folder):
    return document_frequencies(*_index(spark, folder)).select("term", "df", _r("idf").alias("idf"))


@query(f"WITH {_lexical_sql()} SELECT n, round(avgdl, 6) AS avg_dl FROM st")
def avg_doc_length(spark, folder):
    return corpus_stats(_index(spark, folder)[1]).select("n", _r("avg_dl").alias("avg_dl"))


@query(
    f"""WITH {_lexical_sql()} SELECT (SELECT n FROM st) AS chunks, (SELECT count(DISTINCT chunk_id) FROM d) AS documents,
    (SELECT count(*) FROM idf) AS terms, (SELECT count(*) FROM post) AS postings, (SELECT count(*) FROM len WHERE dl = 0) AS empty_chunks"""
)
def corpus_statistics(spark, folder):
    posts, lengths = _index(spark, folder)
    a = lengths.agg(
        F.count(F.lit(1)).alias("chunks"), F.count_distinct("chunk_id").alias("documents"), F.count(F.when(F.col("dl") == 0, 1)).alias("empty_chunks")
    )
    return a.crossJoin(posts.agg(F.count_distinct("term").alias("terms"), F.count(F.lit(1)).alias("postings")))


def _bm25(spark, folder, params=LexicalParams(), k=10, queries=None, docs=None) -> DataFrame:
    found = bm25(queries if queries is not None else _batch(spark, folder), *_index(spark, folder, params, docs), params, k)
    return found.select("query_id", "chunk_id", _r("score").alias("score"), "rank")


_LEX_OUT = "SELECT query_id, chunk_id, round(score, 6) AS score, rank FROM lex"


@query(f"WITH {_lexical_sql(batch=_ONE)} {_LEX_OUT}")
def bm25_topk(spark, folder):
    return _bm25(spark, folder, queries=_one(spark))


@query(f"WITH {_lexical_sql(k=20)} {_LEX_OUT}")
def bm25_batch(spark, folder):
    return _bm25(spark, folder, k=20)


_ASKED = "(SELECT query_id, any_value(query) AS query, any_value(top_k) AS top_k FROM queries GROUP BY query_id)"


@query(f"WITH {_lexical_sql(k=1 << 30, batch=_ASKED)} {_LEX_OUT} JOIN {_ASKED} USING (query_id) WHERE rank <= top_k")
def bm25_queries(spark, folder):
    """Every search of the table queries over all documents, each with its own top_k."""
    return _bm25(spark, folder, k="top_k", queries=_asked(spark, folder))


@query(f"WITH {_lexical_sql(0.5, 1.0)} {_LEX_OUT}")
def bm25_k1_b(spark, folder):
    return _bm25(spark, folder, LexicalParams(0.5, 1.0))


@query(f"WITH {_lexical_sql(0.0, 0.3)} {_LEX_OUT}")
def bm25_k1_zero(spark, folder):
    return _bm25(spark, folder, LexicalParams(0.0, 0.3))


@query(f"WITH {_lexical_sql(stop=True)} {_LEX_OUT}")
def bm25_stopwords(spark, folder):
    return _bm25(spark, folder, LexicalParams(stopwords=STOPWORDS))


@query(f"WITH {_lexical_sql(where='WHERE chunk_id % 3 <> 0')} {_LEX_OUT}")
def bm25_after_delete(spark, folder):
    """Deleting from the index equals never having indexed."""
    gone = _documents(spark, folder).filter("chunk_id % 3 = 0").select("chunk_id")
    posts, lengths = _index(spark, folder)
    found = bm25(_batch(spark, folder), remove(posts, gone), remove(lengths, gone), LexicalParams(), 10)
    return found.select("query_id", "chunk_id", _r("score").alias("score"), "rank")


_UPSERTED = """SELECT doc_id AS chunk_id, CASE WHEN doc_id % 5 = 0 THEN 1000000000 + doc_id ELSE doc_id END AS seq,
    CASE WHEN doc_id % 5 = 0 THEN 'archive query ' || coalesce(title, '') ELSE coalesce(text, '') END AS content FROM documents"""


@query(f"WITH {_lexical_sql(docs=_UPSERTED)} {_LEX_OUT}")
def bm25_after_upsert(spark, folder):
    """Every fifth document is replaced by a new text, which goes to the end."""
    new = _texts(spark, folder).filter("doc_id % 5 = 0").select(
        F.col("doc_id").alias("chunk_id"),
        F.concat(F.lit("archive query "), F.coalesce("title", F.lit(""))).alias("content"),
        (F.col("doc_id") + 1000000000).alias("seq"),
    )
    (posts, lengths), (more, more_lengths) = _index(spark, folder), _index(spark, folder, docs=new)
    posts, lengths = remove(posts, new).unionByName(more), remove(lengths, new).unionByName(more_lengths)
    found = bm25(_batch(spark, folder), posts, lengths, LexicalParams(), 10)
    return found.select("query_id", "chunk_id", _r("score").alias("score"), "rank")


@query(f"WITH {_lexical_sql(where='WHERE false')} SELECT (SELECT count(*) FROM post) AS postings, (SELECT count(*) FROM len) AS chunks")
def index_clear(spark, folder):
    posts, lengths = _index(spark, folder)
    one = posts.limit(0).agg(F.count(F.lit(1)).alias("postings"))
    return one.crossJoin(lengths.limit(0).agg(F.count(F.lit(1)).alias("chunks")))


# vectors

@query(
    """SELECT vec_id, i::INT AS place, round((CASE WHEN n > 1e-12 THEN x / n ELSE x END)::FLOAT::DOUBLE, 6) AS x FROM (SELECT vec_id, n,
    unnest(e) AS x, unnest(range(0, len(e))) AS i FROM (SELECT vec_id, embedding::DOUBLE[] AS e,
    sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS n FROM embeddings))"""
)
def l2_normalized(spark, folder):
    """All numbers of each unit vector."""
    v = table(spark, folder, "embeddings").select("vec_id", F.posexplode(l2_normalize(F.col("embedding").cast("array<double>"))))
    return v.select("vec_id", F.col("pos").alias("place"), _r(F.col("col").cast("double")).alias("x"))


def _knn(spark, folder, metric) -> DataFrame:
    query_vector = table(spark, folder, "embeddings").filter(f"vec_id = {ONE[2]}").head()["embedding"]
    return knn(_vectors(spark, folder), query_vector, metric, 10).select("chunk_id", _r("score").alias("score"))


def _knn_sql(metric: str) -> str:
    return f"WITH {_near_sql(10, metric, batch=_ONE)} SELECT chunk_id, round(score, 6) AS score FROM vec"


@query(_knn_sql("cosine"))
def knn_cosine(spark, folder):
    return _knn(spark, folder, "cosine")


@query(_knn_sql("inner_product"))
def knn_inner_product(spark, folder):
    return _knn(spark, folder, "inner_product")


@query(_knn_sql("l2"))
def knn_l2(spark, folder):
    return _knn(spark, folder, "l2")


@query(f"WITH {_near_sql(15)} SELECT query_id, chunk_id, round(score, 6) AS score, rank FROM vec")
def knn_batches(spark, folder):
    near = knn_batch(_vectors(spark, folder), _batch(spark, folder), "cosine", 15)
    return near.select("query_id", "chunk_id", _r("score").alias("score"), "rank")


def _hundredth_sql(metric: str) -> str:
    return f"""SELECT query_id, chunk_id, round(score, 6) AS score, rank FROM (SELECT w.vec_id AS query_id, v.vec_id AS chunk_id,
        {_SCORE_SQL[metric]} AS score, row_number() OVER (PARTITION BY w.vec_id ORDER BY round({_SCORE_SQL[metric]}, 9) DESC,
        v.vec_id)::INT AS rank FROM embeddings v, embeddings w WHERE w.vec_id % 100 = 0) WHERE rank <= 10"""


def _knn_queries(spark, folder, metric) -> DataFrame:
    near = knn_batch(_vectors(spark, folder), _hundredth(spark, folder), metric, 10)
    return near.select("query_id", "chunk_id", _r("score").alias("score"), "rank")


@query(_hundredth_sql("cosine"))
def knn_queries_cosine(spark, folder):
    return _knn_queries(spark, folder, "cosine")


@query(_hundredth_sql("inner_product"))
def knn_queries_inner_product(spark, folder):
    return _knn_queries(spark, folder, "inner_product")


@query(_hundredth_sql("l2"))
def knn_queries_l2(spark, folder):
    return _knn_queries(spark, folder, "l2")


_SHIFTED = """(SELECT vec_id, CASE WHEN vec_id % 4 = 0 THEN list_reverse(embedding) ELSE embedding END AS embedding
    FROM embeddings)"""


@query(f"WITH {_near_sql(10, among=_SHIFTED)} SELECT query_id, chunk_id, round(score, 6) AS score FROM vec")
def vector_upsert(spark, folder):
    """Every fourth vector is replaced by its reverse."""
    held = _vectors(spark, folder)
    new = held.filter("chunk_id % 4 = 0").withColumn("embedding", F.reverse("embedding"))
    whole = remove(held, new).select("chunk_id", "embedding", "seq").unionByName(new)
    return knn_batch(whole, _batch(spark, folder), "cosine", 10).select("query_id", "chunk_id", _r("score").alias("score"))


@query(f"WITH {_near_sql(10, among='(SELECT * FROM embeddings WHERE label <> 0)')} SELECT query_id, chunk_id, round(score, 6) AS score FROM vec")
def vector_delete(spark, folder):
    gone = table(spark, folder, "embeddings").filter("label = 0").select(F.col("vec_id").alias("chunk_id"))
    kept = remove(_vectors(spark, folder), gone)
    return knn_batch(kept, _batch(spark, folder), "cosine", 10).select("query_id", "chunk_id", _r("score").alias("score"))


@query("SELECT count(*) AS vectors, min(len(embedding))::INT AS dimension FROM embeddings")
def vector_size(spark, folder):
    return _vectors(spark, folder).agg(F.count(F.lit(1)).alias("vectors"), F.min(F.size("embedding")).alias("dimension"))


@query()
def ann_recall(spark, folder):
    """How many of the 10 nearest by cells are among the 10 nearest, over every hundredth chunk with a usable embedding as a
    query, for each metric; and how many of these chunks find themselves first."""
    vectors = materialize(_chunk_vectors(spark, folder), "usable")
    asked = vectors.filter("seq % 100 = 0").select(F.col("seq").alias("query_id"), F.col("embedding").alias("qvec"))
    out = None
    for metric in ("cosine", "inner_product", "l2"):
        model = fit_cells(vectors, metric)
        placed = materialize(in_cells(vectors, model, metric), "cells")
        near = approximate_batch(placed, model, asked, metric, 10).withColumn("hit", F.lit(1))
        near = near.withColumnRenamed("score", "found")
        exact = knn_batch(vectors, asked, metric, 10)
        both = exact.join(near.select("query_id", "chunk_id", "found", "hit"), ["query_id", "chunk_id"], "left")
        first = F.when(F.col("rank") == 1, F.when(F.col("hit").isNotNull(), 1.0).otherwise(0.0))
        recall = both.agg((F.count("hit") / F.count(F.lit(1))).alias("recall"), F.avg(first).alias("first"), F.count_distinct("query_id").alias("queries"))
        recall = recall.select(F.lit(metric).alias("metric"), "queries", "recall", "first")
        out = recall if out is None else out.unionByName(recall)
    return out


@query(
    f"""WITH t AS (SELECT doc_id, ' ' || {FOLD.format("coalesce(text,'')")} || ' ' AS p FROM documents),
    g AS (SELECT doc_id, unnest(list_concat(list_transform(range(1, length(p)), lambda i: substring(p, i, 2)),
        list_transform(range(1, length(p) - 1), lambda i: substring(p, i, 3)))) AS gram FROM t),
    c AS (SELECT doc_id, gram, count(*) AS n FROM g GROUP BY doc_id, gram),
    u AS (SELECT gram, md5(gram) AS h FROM (SELECT DISTINCT gram FROM g)),
    k AS (SELECT gram, (('0x' || substring(h, 1, 8))::BIGINT % 64)::INT AS bucket,
        CASE WHEN ('0x' || substring(h, 9, 2))::INT % 2 = 0 THEN 1 ELSE -1 END AS sign FROM u),
    b AS (SELECT doc_id, bucket, sum(n * sign)::DOUBLE AS v FROM c JOIN k USING (gram) GROUP BY doc_id, bucket)
    SELECT doc_id, bucket, round((v / n)::FLOAT::DOUBLE, 5) AS x FROM b JOIN (SELECT doc_id, sqrt(sum(v * v)) AS n FROM b GROUP BY doc_id)
    USING (doc_id) WHERE v <> 0"""
)
def hash_embedding(spark, folder):
    """The non-zero numbers of each document's vector."""
    v = hash_embed(_texts(spark, folder), "doc_id", "text", 64)
    each = v.select("doc_id", F.posexplode("embedding")).filter("col <> 0")
    return each.select("doc_id", F.col("pos").alias("bucket"), F.round(F.col("col").cast("double"), 5).alias("x"))


# normalizing and fusion

def _both(spark, folder, k=20) -> tuple[DataFrame, DataFrame]:
    near = knn_batch(_vectors(spark, folder), _batch(spark, folder), "cosine", k)
    docs = _documents(spark, folder).join(_vectors(spark, folder).select("chunk_id"), "chunk_id", "left_semi")
    return near, bm25(_batch(spark, folder), *_index(spark, folder, docs=docs), LexicalParams(), k)


_HYBRID_DOCS = "SELECT doc_id AS chunk_id, doc_id AS seq, coalesce(text,'') AS content FROM documents WHERE doc_id IN (SELECT vec_id FROM embeddings)"
_HYBRID_VECS = "(SELECT * FROM embeddings WHERE vec_id IN (SELECT doc_id FROM documents))"


def _both_sql(k: object = 20) -> str:
    return f"{_lexical_sql(k=k, docs=_HYBRID_DOCS)}, {_near_sql(k, among=_HYBRID_VECS)}"


@query(
    f"""WITH {_lexical_sql(k=20)} SELECT query_id, chunk_id, round(CASE WHEN hi - lo < 1e-12 THEN 1 ELSE (score - lo) / (hi - lo) END, 6)
    AS score FROM (SELECT *, min(score) OVER (PARTITION BY query_id) AS lo, max(score) OVER (PARTITION BY query_id) AS hi FROM lex)"""
)
def minmax_scores(spark, folder):
    found = bm25(_batch(spark, folder), *_index(spark, folder), LexicalParams(), 20)
    return fusion.minmax(found).select("query_id", "chunk_id", _r("score").alias("score"))


@query(
    f"""WITH {_lexical_sql(k=20)} SELECT query_id, chunk_id, round(CASE WHEN sd < 1e-12 THEN 0 ELSE (score - m) / sd END, 6) AS score
    FROM (SELECT *, avg(score) OVER (PARTITION BY query_id) AS m, stddev_pop(score) OVER (PARTITION BY query_id) AS sd FROM lex)"""
)
def zscore_scores(spark, folder):
    found = bm25(_batch(spark, folder), *_index(spark, folder), LexicalParams(), 20)
    return fusion.zscore(found).select("query_id", "chunk_id", _r("score").alias("score"))


def _rrf_sql(k: int = 60, wv: float = 1.0, wl: float = 1.0) -> str:
    return f"""fused AS (SELECT query_id, chunk_id, sum(s) AS score FROM (SELECT query_id, chunk_id, {wv}::DOUBLE / ({k} + rank) AS s
        FROM vec UNION ALL SELECT query_id, chunk_id, {wl}::DOUBLE / ({k} + rank) FROM lex) GROUP BY query_id, chunk_id)"""


def _linear_sql(alpha: float) -> str:
    def side(name: str, weight: float) -> str:
        return f"""SELECT query_id, chunk_id, {weight}::DOUBLE * CASE WHEN hi - lo < 1e-12 THEN 1 ELSE (score - lo) / (hi - lo) END AS s FROM
            (SELECT *, min(score) OVER (PARTITION BY query_id) AS lo, max(score) OVER (PARTITION BY query_id) AS hi FROM {name})"""

    return f"""fused AS (SELECT query_id, chunk_id, sum(s) AS score FROM ({side('vec', alpha)} UNION ALL {side('lex', 1 - alpha)})
        GROUP BY query_id, chunk_id)"""


_FUSED_OUT = """SELECT query_id, chunk_id, round(score, 6) AS score, row_number() OVER (PARTITION BY query_id
    ORDER BY round(score, 12) DESC, chunk_id)::INT AS rank FROM fused"""


def _among_both(spark, folder) -> tuple[DataFrame, DataFrame]:
    """Both rankings over the documents that have a vector."""
    vectors = _vectors(spark, folder).join(_documents(spark, folder).select("chunk_id"), "chunk_id", "left_semi")
    near = knn_batch(vectors, _batch(spark, folder), "cosine", 20)
    return near, _both(spark, folder)[1]


def _fuse(spark, folder, *args, **kwargs) -> DataFrame:
    fused = fusion.fuse(list(_among_both(spark, folder)), *args, **kwargs)
    return fused.select("query_id", "chunk_id", _r("score").alias("score"), "rank")


@query(f"WITH {_both_sql()}, {_rrf_sql()} {_FUSED_OUT}")
def rrf_fuse(spark, folder):
    return _fuse(spark, folder, "rrf")


@query(f"WITH {_both_sql()}, {_rrf_sql(10, 1.0, 2.0)} {_FUSED_OUT}")
def rrf_weighted(spark, folder):
    return _fuse(spark, folder, "rrf", rrf_k=10, weights=[1.0, 2.0])


@query(f"WITH {_both_sql()}, {_linear_sql(0.5)} {_FUSED_OUT}")
def linear_fuse(spark, folder):
    return _fuse(spark, folder, "linear", alpha=0.5)


@query(f"WITH {_both_sql()}, {_linear_sql(0.0)} {_FUSED_OUT}")
def linear_fuse_lexical(spark, folder):
    return _fuse(spark, folder, "linear", alpha=0.0)


@query(f"WITH {_both_sql()}, {_linear_sql(1.0)} {_FUSED_OUT}")
def linear_fuse_vector(spark, folder):
    return _fuse(spark, folder, "linear", alpha=1.0)


# search

def _tables(spark, folder) -> IndexTables:
    """The documents that have a vector, one chunk each."""
    vectors = _vectors(spark, folder)
    docs = _documents(spark, folder).join(vectors.select("chunk_id"), "chunk_id", "left_semi")
    vectors = vectors.join(docs.select("chunk_id"), "chunk_id", "left_semi").select("chunk_id", "embedding", "seq")
    whole = docs.withColumn("document_id", F.col("chunk_id"))
    documents = whole.select(F.col("document_id").alias("doc_id"), "content", "metadata", "seq")
    chunks = whole.select("chunk_id", "document_id", "content", F.create_map(F.lit("chunk_index"), F.lit("0")).alias("metadata"), "seq")
    return IndexTables(documents, chunks, vectors, *build_index(docs, LexicalParams()))


def _search(spark, folder, **kwargs) -> DataFrame:
    found = search_rankings(_tables(spark, folder), _batch(spark, folder), **kwargs)
    return found.select(
        "query_id", "chunk_id", _r("score").alias("score"), _r("vector_score").alias("vector_score"), _r("lexical_score").alias("lexical_score"), "rank"
    )


def _search_sql(mode: str, k: int, fused: str = "", where: str | None = None) -> str:
    wide = max(4 * k, 40) if where else k
    cte = _both_sql(wide)
    allowed = f"chunk_id IN (SELECT doc_id FROM documents WHERE {where})" if where else "true"
    if mode == "hybrid":
        cte += ", " + fused
        rows = """SELECT f.query_id, f.chunk_id, f.score, v.score AS vs, l.score AS ls, row_number() OVER (PARTITION BY f.query_id
            ORDER BY round(f.score, 12) DESC, f.chunk_id) AS place FROM fused f LEFT JOIN vec v USING (query_id, chunk_id)
            LEFT JOIN lex l USING (query_id, chunk_id)"""
    else:
        name, vs, ls = ("lex", "NULL::DOUBLE", "score") if mode == "bm25" else ("vec", "score", "NULL::DOUBLE")
        rows = f"SELECT query_id, chunk_id, score, {vs} AS vs, {ls} AS ls, rank AS place FROM {name}"
    return f"""WITH {cte}, r AS ({rows}) SELECT query_id, chunk_id, round(score, 6) AS score, round(vs, 6) AS vector_score,
        round(ls, 6) AS lexical_score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY place)::INT AS rank FROM r
        WHERE {allowed}) WHERE rank <= {k}"""


GERMAN = {"lang": canonical("de")}


def _filtered(spark, folder, wanted: dict[str, str], **kwargs) -> DataFrame:
    tables = _tables(spark, folder)
    quoted = F.transform_values("metadata", lambda k, v: F.concat(F.lit('"'), v, F.lit('"')))
    tables.documents = tables.documents.withColumn("metadata", quoted)
    found = search_rankings(tables, _batch(spark, folder), wanted=wanted, **kwargs)
    return found.select(
        "query_id", "chunk_id", _r("score").alias("score"), _r("vector_score").alias("vector_score"), _r("lexical_score").alias("lexical_score"), "rank"
    )


@query(_search_sql("bm25", 5))
def search_bm25(spark, folder):
    return _search(spark, folder, mode="bm25")


@query(_search_sql("vector", 5))
def search_vector(spark, folder):
    return _search(spark, folder, mode="vector")


@query(_search_sql("hybrid", 5, _rrf_sql()))
def search_hybrid_rrf(spark, folder):
    return _search(spark, folder)


@query(_search_sql("hybrid", 8, _linear_sql(0.3)))
def search_hybrid_linear(spark, folder):
    return _search(spark, folder, top_k=8, alpha=0.3, strategy="linear")


@query(_search_sql("bm25", 5, where="lang = 'de'"))
def search_filtered_bm25(spark, folder):
    return _filtered(spark, folder, GERMAN, mode="bm25")


@query(_search_sql("vector", 5, where="lang = 'de'"))
def search_filtered_vector(spark, folder):
    return _filtered(spark, folder, GERMAN, mode="vector")


@query(_search_sql("hybrid", 5, _rrf_sql(), "lang = 'de'"))
def search_filtered_hybrid(spark, folder):
    return _filtered(spark, folder, GERMAN)


@query(_search_sql("hybrid", 5, _rrf_sql(), "lang = 'xx' AND source = 'none'"))
def filter_empty_candidates(spark, folder):
    return _filtered(spark, folder, {"lang": canonical("xx"), "source": canonical("none")})


@query("SELECT doc_id FROM documents WHERE lang = 'de' AND source IS NOT NULL AND starts_with(source, 'kb')")
def metadata_filter(spark, folder):
    """Keys are looked up in the chunk, then in its document."""
    docs = _documents(spark, folder).select("chunk_id", F.col("metadata").alias("inherited"))
    kb = F.when(F.element_at("inherited", F.lit("source")).startswith("kb"), F.create_map(F.lit("kb"), F.lit("1")))
    own = F.coalesce(kb, F.create_map().cast("map<string,string>"))
    return docs.filter(matches({"lang": "de", "kb": "1"}, own, F.col("inherited"))).select(F.col("chunk_id").alias("doc_id"))


@query(_search_sql("hybrid", 5, _rrf_sql()))
def save_load_roundtrip(spark, folder):
    """Search in tables that were stored and read back."""
    path = new_path(spark, "saved")
    tables = _tables(spark, folder)
    for name in ("documents", "chunks", "vectors", "postings", "lengths"):
        held = getattr(tables, name)
        held.write.parquet(f"{path}/{name}")
        setattr(tables, name, spark.read.schema(held.schema).parquet(f"{path}/{name}"))
    found = search_rankings(tables, _batch(spark, folder))
    return found.select(
        "query_id", "chunk_id", _r("score").alias("score"), _r("vector_score").alias("vector_score"), _r("lexical_score").alias("lexical_score"), "rank"
    )


@query(
    f"""WITH {_lexical_sql(k=5, docs=_HYBRID_DOCS)} SELECT query_id, string_agg('[' || rank || '] (Score: ' || printf('%.4f', score) || ', Doc ID: ' ||
    chunk_id || ')' || chr(10) || content, chr(10) || chr(10) ORDER BY rank) AS context FROM lex JOIN src USING (chunk_id) GROUP BY query_id"""
)
def tool_context(spark, folder):
    tables = _tables(spark, folder)
    found = search_rankings(tables, _batch(spark, folder), mode="bm25")
    return context_text(with_content(found, tables.chunks))


# the engine, over all of source_docs

def _engine(spark, folder, **kwargs) -> Engine:
    engine = Engine(spark, **kwargs)
    quoted = lambda k, v: F.coalesce(F.concat(F.lit('"'), F.regexp_replace(v, r'(["\\\\])', r"\\$1"), F.lit('"')), F.lit("null"))
    rows = table(spark, folder, "source_docs").select(
        F.col("id").alias("doc_id"),
        F.coalesce("content", F.lit("")).alias("content"),
        F.transform_values("metadata", quoted).alias("metadata"),
        "seq",
    )
    engine.add_table(rows)
    return engine


_CUT = "SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1)::INT AS chunk_index"
_SOURCE = "(SELECT id AS doc_id, any_value(content) AS text, max(seq) AS seq, 0 AS later FROM source_docs GROUP BY id)"
_REPLACED = f"""(SELECT doc_id, CASE WHEN seq % 5 = 0 THEN 'archive query ' || doc_id ELSE text END AS text, seq,
    (seq % 5 = 0)::INT AS later FROM {_SOURCE})"""


def _engine_chunks_sql(source: str = _SOURCE) -> str:
    """chunk_id, document_id, chunk_index, total_chunks, seq, content."""
    body = _recursive_sql(500, 50).replace("FROM documents", f"FROM {source}")
    body = body[: body.index(_CUT)]
    return f"""SELECT doc_id || '_chunk_' || chunk_index AS chunk_id, doc_id AS document_id, chunk_index,
        count(*) OVER (PARTITION BY doc_id)::INT AS total_chunks,
        row_number() OVER (ORDER BY later, dseq, doc_id, chunk_index) - 1 AS seq, content
        FROM ({body} {_CUT}, done AS content FROM c) JOIN (SELECT doc_id, seq AS dseq, later FROM {source}) USING (doc_id)"""


_ENGINE_OUT = """SELECT query_id, chunk_id, document_id, md5(content) AS digest, round(score, 6) AS score, round(score, 6) AS lexical_score,
    rank FROM lex JOIN (SELECT chunk_id, content, regexp_replace(chunk_id, '_chunk_[0-9]+$', '') AS document_id FROM src) USING (chunk_id)"""


def _engine_rows(found: DataFrame) -> DataFrame:
    return found.select(
        "query_id", "chunk_id", "document_id", F.md5("content").alias("digest"), _r("score").alias("score"), _r("lexical_score").alias("lexical_score"), "rank"
    )


def _texts_of_batch(spark, folder) -> DataFrame:
    return _batch(spark, folder).select("query_id", "query")


@query(f"SELECT chunk_id, document_id, chunk_index, total_chunks, seq, md5(content) AS digest FROM ({_engine_chunks_sql()})")
def engine_chunks(spark, folder):
    """What the engine makes of a table of documents: redelivered ones once, in order of arrival, blank ones not at all."""
    return _engine(spark, folder).chunks.select(
        "chunk_id", "document_id", "chunk_index", "total_chunks", "seq", F.md5("content").alias("digest")
    )


@query(f"WITH {_lexical_sql(docs=_engine_chunks_sql())} {_ENGINE_OUT}")
def engine_bm25(spark, folder):
    """All searches of the table queries in an engine over all of source_docs."""
    return _engine_rows(_engine(spark, folder).search_table(_texts_of_batch(spark, folder), 10, "bm25"))


@query(f"WITH {_lexical_sql(docs=_engine_chunks_sql())} {_ENGINE_OUT}")
def engine_save_load(spark, folder):
    """The same in an engine that was stored, with its manifest, and read back."""
    path = new_path(spark, "index")
    _engine(spark, folder).save(path)
    return _engine_rows(Engine.load(path, spark=spark).search_table(_texts_of_batch(spark, folder), 10, "bm25"))


@query(f"WITH {_lexical_sql(docs=_engine_chunks_sql(_REPLACED))} {_ENGINE_OUT}")
def engine_upsert(spark, folder):
    """The same after every fifth document was added again with another text, which moves it to the end."""
    engine = _engine(spark, folder)
    last = table(spark, folder, "source_docs").groupBy(F.col("id").alias("doc_id")).agg(F.max("seq").alias("seq"))
    again = last.filter("seq % 5 = 0").withColumn("content", F.concat(F.lit("archive query "), "doc_id"))
    empty = F.create_map().cast("map<string,string>").alias("metadata")
    engine.add_table(again.select("doc_id", "content", empty, "seq"))
    return _engine_rows(engine.search_table(_texts_of_batch(spark, folder), 10, "bm25"))


@query("SELECT 0::BIGINT AS chunks, 0::BIGINT AS vectors, 0::BIGINT AS hits")
def engine_clear(spark, folder):
    engine = _engine(spark, folder)
    engine.clear()
    hits = engine.search_table(_texts_of_batch(spark, folder), 10).count()
    return spark.createDataFrame([(len(engine), len(engine.store), hits)], "chunks bigint, vectors bigint, hits bigint")


@query(
    f"""WITH {_lexical_sql(k=5, docs=_engine_chunks_sql(), batch=_ONE)} SELECT string_agg('[' || rank || '] (Score: ' || printf('%.4f', score) ||
    ', Doc ID: ' || regexp_replace(chunk_id, '_chunk_[0-9]+$', '') || ')' || chr(10) || content, chr(10) || chr(10) ORDER BY rank) AS context
    FROM lex JOIN src USING (chunk_id)"""
)
def engine_tool(spark, folder):
    """What the engine tells an agent."""
    tool = _engine(spark, folder).to_tool(mode="bm25")
    return spark.createDataFrame([(tool(ONE[1]),)], "context string")


@query()
def engine_modes(spark, folder):
    """All searches in the three modes, exactly and by cells, in an engine filled once: the same hits as often as cells find them."""
    asked, out, engine = _texts_of_batch(spark, folder), None, _engine(spark, folder)
    for backend in ("exact", "cells"):
        engine.use_store(backend)
        for mode in ("bm25", "vector", "hybrid"):
            found = engine.search_table(asked, 10, mode).select(F.lit(backend).alias("store"), F.lit(mode).alias("mode"), "query_id", "chunk_id", "rank")
            out = found if out is None else out.unionByName(found)
    return out


# searches that each have their own mode, size, fusion, weight and filter, over all of chunks

_REQUESTS = f"""(SELECT query_id, query, coalesce(lower(search_mode), 'hybrid') AS mode, top_k, coalesce(lower(fusion), 'rrf') AS fusion,
    coalesce(alpha, 0.5) AS alpha, CASE WHEN cardinality(f) > 0 THEN f END AS f,
    CASE WHEN cardinality(f) > 0 THEN greatest(4 * top_k, 40) ELSE top_k END AS wide, embedding AS qvec FROM
    (SELECT query_id, any_value(query) AS query, any_value(search_mode) AS search_mode, any_value(top_k) AS top_k, any_value(fusion) AS fusion,
        any_value(alpha) AS alpha, any_value(metadata_filter) AS f FROM queries GROUP BY query_id)
    JOIN {_NUMBERED} ON query_id % m = i WHERE trim(coalesce(query, ''), {WS}) <> '' AND top_k > 0)"""
_CHUNK_ROWS = """(SELECT id AS chunk_id, any_value(document_id) AS document_id, coalesce(any_value(content), '') AS content,
    any_value(metadata) AS own, min(seq) AS seq FROM chunks GROUP BY id)"""


@query(
    f"""WITH how AS {_REQUESTS}, {_lexical_sql(k=1 << 30, docs=f"SELECT chunk_id, seq, content FROM {_CHUNK_ROWS}", batch="(SELECT query_id, query FROM how WHERE mode <> 'vector')")},
    e AS (SELECT id AS chunk_id, any_value(embedding) AS embedding, min(seq) AS seq FROM chunks WHERE len(embedding) = 64 AND
        isfinite(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) AND list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]) > 0 GROUP BY id),
    vec AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, seq)::INT AS rank FROM (SELECT query_id, chunk_id, seq,
        list_cosine_similarity(embedding::DOUBLE[], qvec::DOUBLE[]) AS score FROM e, how WHERE mode <> 'bm25')),
    j AS (SELECT query_id, chunk_id, score, rank, true AS near FROM vec UNION ALL SELECT query_id, chunk_id, score, rank, false FROM lex),
    b AS (SELECT j.*, how.* EXCLUDE (query_id), min(score) OVER s AS lo, max(score) OVER s AS hi FROM j JOIN how USING (query_id) WHERE rank <= wide
        WINDOW s AS (PARTITION BY query_id, near)),
    g AS (SELECT query_id, chunk_id, mode, any_value(top_k) AS top_k, any_value(f) AS f, sum(CASE WHEN mode <> 'hybrid' THEN score WHEN fusion = 'rrf'
            THEN 1::DOUBLE / (60 + rank) ELSE (CASE WHEN near THEN alpha ELSE 1 - alpha END) * (CASE WHEN hi - lo < 1e-12 THEN 1 ELSE (score - lo) / (hi - lo) END) END) AS score,
        max(CASE WHEN near THEN score END) AS vs, max(CASE WHEN NOT near THEN score END) AS ls, max(CASE WHEN mode <> 'hybrid' THEN rank END) AS place
        FROM b GROUP BY query_id, chunk_id, mode),
    m AS (SELECT g.*, own, inh FROM g JOIN {_CHUNK_ROWS} c USING (chunk_id) LEFT JOIN (SELECT id AS document_id, any_value(metadata) AS inh FROM source_docs
        GROUP BY id) d USING (document_id)),
    r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY place NULLS FIRST, round(score, 12) DESC, chunk_id)::INT AS rank FROM m WHERE f IS NULL OR
        len(list_filter(map_entries(f), lambda x: NOT coalesce(CASE WHEN list_contains(map_keys(own), x.key) THEN own[x.key] ELSE inh[x.key] END = x.value, false))) = 0)
    SELECT query_id, chunk_id, round(score, 6) AS score, round(vs, 6) AS vector_score, round(ls, 6) AS lexical_score, rank FROM r WHERE rank <= top_k"""
)
def search_as_asked(spark, folder):
    """Every row of the table queries with its own mode, top_k, fusion, alpha and filter, over all chunks and their documents' metadata."""
    rows = table(spark, folder, "chunks").select("id", "document_id", "content", "metadata", "seq")
    first = rows.groupBy(F.col("id").alias("chunk_id")).agg(
        F.min_by(F.struct("document_id", "content", "metadata"), "seq").alias("x"), F.min("seq").alias("seq")
    )
    chunks = materialize(
        first.select("chunk_id", "x.document_id", F.coalesce("x.content", F.lit("")).alias("content"), F.col("x.metadata").alias("metadata"), "seq"), "chunks"
    )
    documents = table(spark, folder, "source_docs").groupBy(F.col("id").alias("doc_id")).agg(F.min_by("metadata", "seq").alias("metadata"))
    postings, lengths = build_index(chunks, LexicalParams())
    tables = IndexTables(documents, chunks, materialize(_chunk_vectors(spark, folder), "vectors"), materialize(postings, "postings"), materialize(lengths, "lengths"))
    asked = table(spark, folder, "queries").dropDuplicates(["query_id"])
    asked = asked.join(F.broadcast(_numbered(spark, folder)), F.col("query_id") % F.col("m") == F.col("i"))
    found = search_requests(tables, asked)
    return found.select(
        "query_id", "chunk_id", _r("score").alias("score"), _r("vector_score").alias("vector_score"), _r("lexical_score").alias("lexical_score"), "rank"
    )
