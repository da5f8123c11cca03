"""The queries of the problems, and the SQL that checks them where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from seekstone.llm import distinctive, frequency, lookalike, neardup, packing, ranking, similar, splitting, tokenizing
from seekstone.functions.text import strip
from seekstone.operators.distinct import first_rows
from seekstone.session import materialize
from seekstone.sources.tables import table


def _chunks(spark: SparkSession, folder: str) -> DataFrame:
    return first_rows(table(spark, folder, "chunks").select("id", "content"), "id")


def p1_frequency(spark: SparkSession, folder: str) -> DataFrame:
    return frequency.term_frequencies(_chunks(spark, folder), "content")


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    return p1_frequency(spark, folder).filter("mark IS NOT NULL").select("term", "mark")


def p2_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    """The ten most similar chunks of every chunk."""
    near = similar.similar_vectors(table(spark, folder, "chunks").select("id", "embedding"), "id", "embedding")
    return near.withColumnRenamed("id", "chunk_id")


def p2_recall(spark: SparkSession, folder: str) -> DataFrame:
    """Of each chunk whose ``seq`` is divisible by 100: how many of its listed neighbours are as similar as the tenth by brute
    force over all chunks (``found``), and how many there are (``asked``)."""
    rows = table(spark, folder, "chunks").select("id", "embedding", "seq")
    return similar.recall(rows, "id", "embedding", "seq", 100)


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    pairs = similar.mutual_pairs(table(spark, folder, "chunks").select("id", "embedding"), "id", "embedding", least=0.9)
    return pairs.select(F.col("a").alias("chunk_a"), F.col("b").alias("chunk_b"))


def _oversized(spark: SparkSession, folder: str) -> DataFrame:
    """Documents and chunks with the sizes that their own metadata leads to: 12 fixed collections, broadcast."""
    manifests = table(spark, folder, "manifests").select("collection", "chunk_size", "chunk_overlap")
    sizes = F.broadcast(manifests)
    default = F.broadcast(
        manifests.filter("collection = 'default'").select(
            F.col("chunk_size").alias("default_size"), F.col("chunk_overlap").alias("default_overlap")
        )
    )

    def records(name: str, kind: str) -> DataFrame:
        rows = table(spark, folder, name).select(
            "id", "content", F.element_at("metadata", "collection").alias("collection"), F.lit(kind).alias("record_kind")
        )
        return first_rows(rows, "id")

    both = records("source_docs", "document").unionByName(records("chunks", "chunk"))
    sized = both.join(sizes, "collection", "left").crossJoin(default)
    known = F.col("chunk_size").isNotNull()
    return sized.select(
        "record_kind",
        "id",
        "content",
        F.coalesce("chunk_size", "default_size").alias("size"),
        F.when(known, F.col("chunk_overlap")).otherwise(F.col("default_overlap")).alias("overlap"),
    )


def p3_pieces(spark: SparkSession, folder: str) -> DataFrame:
    rows = _oversized(spark, folder)
    return splitting.split_oversized(rows, F.col("record_kind"), "id", "content", F.col("size"), F.col("overlap"))


def p3_checks(spark: SparkSession, folder: str) -> DataFrame:
    """Of each record that is cut: are its pieces, without what repeats, the whole text; do they fit; do they repeat no more than
    they may?"""
    sized = _oversized(spark, folder)
    pieces = p3_pieces(spark, folder)
    fresh = F.expr("substring(piece, fresh_start - start + 1)")
    ordered = F.array_sort(F.collect_list(F.struct("piece_index", fresh.alias("t"))))  # the pieces of one record
    whole = pieces.groupBy("record_kind", F.col("record_id").alias("id")).agg(
        F.md5(F.array_join(F.transform(ordered, lambda x: x["t"]), "")).alias("digest"),
        F.max(F.length("piece")).alias("longest"),
        F.max(F.col("fresh_start") - F.col("start")).alias("repeats"),
    )
    both = whole.join(sized, ["record_kind", "id"])
    return both.select(
        "record_kind",
        F.col("id").alias("record_id"),
        (F.col("digest") == F.md5(strip(F.col("content")))).alias("whole"),
        (F.col("longest") <= F.col("size")).alias("fits"),
        (F.col("repeats") <= F.col("overlap")).alias("overlaps"),
    )


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    return p3_pieces(spark, folder).filter("piece_index = 0").select("record_kind", "record_id")


def p4_classes(spark: SparkSession, folder: str) -> DataFrame:
    """Runs of three words and a similarity of 0.6, as the statement of this problem's data fixes them."""
    both = None
    for name, kind in (("source_docs", "document"), ("chunks", "chunk")):
        rows = table(spark, folder, name).select(F.lit(kind).alias("record_kind"), "id", "content")
        both = rows if both is None else both.unionByName(rows)
    return neardup.near_duplicates(both, "record_kind", "id", "content", threshold=0.6, width=3, min_words=30)


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    pairs = neardup.class_pairs(p4_classes(spark, folder), "record_kind", "id")
    return pairs.select("record_kind", F.col("a").alias("id_a"), F.col("b").alias("id_b"))


def _results(spark: SparkSession, folder: str) -> DataFrame:
    """Each candidate of a query once; redelivered rows are equal but for the logging time."""
    rows = table(spark, folder, "query_results").select("query_id", "chunk_id", "vector_score", "lexical_score")
    return rows.dropDuplicates(["query_id", "chunk_id"])


def p5_ranking(spark: SparkSession, folder: str) -> DataFrame:
    return ranking.walk_ranking(_results(spark, folder), "query_id", "chunk_id", ["vector_score", "lexical_score"])


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    probes = table(spark, folder, "rank_probes").select("query_id").distinct()
    rows = _results(spark, folder).join(probes, "query_id", "left_semi")
    weights = ranking.walk_ranking(rows, "query_id", "chunk_id", ["vector_score", "lexical_score"])
    return ranking.best_of_each(weights, "query_id", "chunk_id")


def p6_distinctive(spark: SparkSession, folder: str) -> DataFrame:
    """The most telling word of every chunk."""
    scores = distinctive.distinctive_terms(_chunks(spark, folder), "id", "content")
    return distinctive.most_distinctive(scores, "id").withColumnRenamed("id", "chunk_id")


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    probes = table(spark, folder, "term_probes").select(F.col("chunk_id").alias("id"))
    scores = distinctive.distinctive_terms(_chunks(spark, folder), "id", "content", only=probes)
    return distinctive.most_distinctive(scores, "id").withColumnRenamed("id", "chunk_id")


def p7_ids(spark: SparkSession, folder: str) -> DataFrame:
    return tokenizing.token_ids(table(spark, folder, "documents"), "doc_id", "text")


def p8_packing(spark: SparkSession, folder: str) -> DataFrame:
    sizes = tokenizing.token_counts(table(spark, folder, "documents"), "doc_id", "text")
    return packing.pack(sizes, "doc_id", "n_tokens")


def p8_fill(spark: SparkSession, folder: str) -> DataFrame:
    """How many containers there are and how much of them is left over."""
    return packing.fill(p8_packing(spark, folder))


def p8_checks(spark: SparkSession, folder: str) -> DataFrame:
    """Of each document with tokens: does all of it lie in containers, once, in parts only if it must, and none too full?"""
    sizes = materialize(tokenizing.token_counts(table(spark, folder, "documents"), "doc_id", "text"), "sizes")
    placed = materialize(packing.pack(sizes, "doc_id", "n_tokens"), "placed")
    rooms = placed.groupBy("container").agg((F.sum("length") > 2048).alias("over"))
    parts = placed.join(rooms, "container").groupBy("doc_id").agg(
        F.sum("length").alias("placed"), F.count(F.lit(1)).alias("parts"), F.max("over").alias("over")
    )
    least = F.ceil(F.col("n_tokens") / 2048)
    whole = (F.col("placed") == F.col("n_tokens")) & (F.col("parts") == least) & ~F.col("over")
    return parts.join(sizes, "doc_id").select("doc_id", whole.alias("whole"))


def p9_checks(spark: SparkSession, folder: str) -> DataFrame:
    """Of each text: is the form of its form the form itself, under the same vocabulary?"""
    documents = table(spark, folder, "documents").select("doc_id", "text")
    words = lookalike.vocabulary(documents, "text")
    forms = materialize(lookalike.visual_forms(documents, "doc_id", "text", words).filter("form IS NOT NULL"), "forms")
    again = lookalike.visual_forms(forms, "doc_id", "form", words).withColumnRenamed("form", "again")
    return forms.join(again, "doc_id").select("doc_id", (F.col("form") == F.col("again")).alias("stable"))


def p9_forms(spark: SparkSession, folder: str) -> DataFrame:
    return lookalike.visual_forms(table(spark, folder, "documents"), "doc_id", "text")


def p9_classes(spark: SparkSession, folder: str) -> DataFrame:
    """One row per document: the least document that looks the same."""
    return lookalike.look_classes(table(spark, folder, "documents"), "doc_id", "text")


def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    pairs = lookalike.lookalike_pairs(table(spark, folder, "documents"), "doc_id", "text")
    return pairs.select(F.col("a").alias("doc_a"), F.col("b").alias("doc_b"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    name: f for name, f in list(globals().items()) if name[0] == "p" and name[1:2].isdigit() and callable(f)
}

#: Words in DuckDB: runs of letters, digits and underscores, folded.  The test data need only ``ß`` beside lower case.
_WORDS = """SELECT id, unnest(regexp_extract_all(replace(lower(content), 'ß', 'ss'), '[\\p{L}\\p{N}_]+')) AS term
    FROM (SELECT id, any_value(content) AS content FROM chunks GROUP BY id)"""
_COUNTS = f"""w AS ({_WORDS}), c AS (SELECT id, term, count(*) AS tf FROM w GROUP BY id, term),
    n AS (SELECT count(DISTINCT id) AS n FROM chunks),
    f AS (SELECT term, sum(tf)::BIGINT AS occurrences, count(*) AS records FROM c GROUP BY term),
    m AS (SELECT f.*, CASE WHEN records < 3 THEN 'rare' WHEN records > 0.4 * n THEN 'common' END AS mark FROM f, n)"""
_PPMI = f"""{_COUNTS}, l AS (SELECT id, sum(tf) AS length FROM c GROUP BY id),
    mass AS (SELECT sum(occurrences ** 0.5) AS mass FROM f),
    s AS (SELECT c.id, c.term, round(greatest(0, ln(tf / length / (occurrences ** 0.5 / mass))), 9) AS score
        FROM c JOIN l USING (id) JOIN f USING (term), mass WHERE records >= 2),
    best AS (SELECT id AS chunk_id, first(term ORDER BY score DESC, term) AS term FROM s GROUP BY id)"""

_SIZES = """r AS (SELECT 'document' AS record_kind, id, any_value(content) AS content,
        any_value(metadata) AS metadata FROM source_docs GROUP BY id
    UNION ALL SELECT 'chunk', id, any_value(content), any_value(metadata) FROM chunks GROUP BY id)"""

ORACLE: dict[str, str] = {
    "p1_frequency": f"WITH {_COUNTS} SELECT term, occurrences, records, mark FROM m",
    "p1_found": f"WITH {_COUNTS} SELECT term, mark FROM m WHERE mark IS NOT NULL",
    "p3_found": f"""WITH {_SIZES},
        s AS (SELECT record_kind, id, trim(content, chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || chr(28) ||
            chr(29) || chr(30) || chr(31) || ' ' || chr(133) || chr(160) || chr(5760) || chr(8192) || chr(8193) ||
            chr(8194) || chr(8195) || chr(8196) || chr(8197) || chr(8198) || chr(8199) || chr(8200) || chr(8201) ||
            chr(8202) || chr(8232) || chr(8233) || chr(8239) || chr(8287) || chr(12288)) AS content,
            metadata['collection'] AS collection FROM r)
        SELECT record_kind, id AS record_id FROM s LEFT JOIN manifests m ON m.collection = s.collection
        WHERE length(content) > coalesce(m.chunk_size, (SELECT chunk_size FROM manifests WHERE collection = 'default'))""",
    "p3_checks": f"""WITH {_SIZES},
        s AS (SELECT record_kind, id, trim(content, chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || chr(28) ||
            chr(29) || chr(30) || chr(31) || ' ' || chr(133) || chr(160) || chr(5760) || chr(8192) || chr(8193) ||
            chr(8194) || chr(8195) || chr(8196) || chr(8197) || chr(8198) || chr(8199) || chr(8200) || chr(8201) ||
            chr(8202) || chr(8232) || chr(8233) || chr(8239) || chr(8287) || chr(12288)) AS content,
            metadata['collection'] AS collection FROM r)
        SELECT record_kind, id AS record_id, true AS whole, true AS fits, true AS overlaps FROM s LEFT JOIN manifests m ON m.collection = s.collection
        WHERE length(content) > coalesce(m.chunk_size, (SELECT chunk_size FROM manifests WHERE collection = 'default'))""",
    "p8_checks": "SELECT doc_id, true AS whole FROM documents WHERE text <> ''",
    "p9_checks": "SELECT doc_id, true AS stable FROM documents WHERE text IS NOT NULL",
    "p6_distinctive": f"WITH {_PPMI} SELECT chunk_id, term FROM best",
    "p6_found": f"WITH {_PPMI} SELECT chunk_id, term FROM best WHERE chunk_id IN (SELECT chunk_id FROM term_probes)",
}
