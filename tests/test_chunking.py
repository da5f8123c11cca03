import re

import pytest
from pyspark.sql import functions as F

from seekstone.errors import ChunkingError
from seekstone.operators.chunking import (
    SEPARATORS,
    RecursiveCharacterChunker,
    SimpleCharacterChunker,
    chunk_documents,
    recursive_chunks,
    simple_chunks,
)

PARAGRAPHS = "First paragraph here.\n\nSecond one is a bit longer than it.\nWith a line.\n\nThird one."


def brute(text, size, overlap, separators=SEPARATORS):
    def split(t, depth):
        if len(t) <= size:
            return [t] if t.strip() else []
        if depth == len(separators) or not separators[depth]:
            return [t[k : k + size] for k in range(0, len(t), size)]
        sep, parts, at = separators[depth], [], 0
        for m in re.finditer(re.escape(sep), t):
            if m.start() == at and parts:
                parts[-1] += sep
            else:
                parts.append(t[at : m.end()])
            at = m.end()
        parts.append(t[at:])
        return [x for p in parts if p.strip() for x in split(p, depth + 1)]

    chunks, cur = [], ""
    for piece in split(text.strip(), 0):
        if cur and len(cur + piece) > size:
            chunks.append(cur)
            keep = min(overlap, size - len(piece))
            cur = (cur[len(cur) - keep :] if 0 < keep < len(cur) else cur if keep > 0 else "") + piece
        else:
            cur += piece
    return [c for c in [*chunks, cur] if c.strip()]


TEXTS = [PARAGRAPHS, "x" * 25, "a. b. " * 40, "  \n\n  ", "", None, "no", "\n\n\n\nlead " + "w " * 90, "日本語。" * 30, ". . . . " * 9]


@pytest.mark.parametrize("size,overlap", [(10, 0), (20, 5), (50, 49), (500, 50)])
def test_recursive_equals_brute_force(spark, size, overlap):
    df = spark.createDataFrame([(t,) for t in TEXTS], "t string")
    for r in df.select("t", recursive_chunks(F.col("t"), size, overlap).alias("c")).collect():
        assert r["c"] == brute(r["t"] or "", size, overlap), r["t"]
        assert all(0 < len(c) <= size for c in r["c"])


def test_custom_separators_are_quoted(spark):
    df = spark.createDataFrame([("a|b|c$d" * 5,)], "t string")
    got = df.select(recursive_chunks(F.col("t"), 6, 0, ["|", "$"]).alias("c")).head()["c"]
    assert got == brute("a|b|c$d" * 5, 6, 0, ("|", "$"))


def test_simple_windows(spark):
    df = spark.createDataFrame([("abcdefgh",), ("x" * 25,), (None,), ("   ",)], "t string")
    got = [r["c"] for r in df.select(simple_chunks(F.col("t"), 5, 2).alias("c")).collect()]
    assert got[0] == ["abcde", "defgh"] and got[2] == got[3] == []
    hard = df.select(simple_chunks(F.col("t"), 10, 0).alias("c")).collect()[1]["c"]
    assert [len(c) for c in hard] == [10, 10, 5]


def test_split_text_of_one(spark):
    assert SimpleCharacterChunker(5, 2).split_text("abcdefgh") == ["abcde", "defgh"]
    assert RecursiveCharacterChunker(50, 0).split_text(PARAGRAPHS) == brute(PARAGRAPHS, 50, 0)
    assert RecursiveCharacterChunker(10, 0, []).separators == SEPARATORS


@pytest.mark.parametrize("size,overlap", [(0, 0), (-1, 0), (10, -1), (10, 10), ("5", 0), (5, 1.5), (True, 0)])
def test_wrong_sizes(size, overlap):
    for kind in (SimpleCharacterChunker, RecursiveCharacterChunker):
        with pytest.raises(ChunkingError):
            kind(size, overlap)


def test_metadata_and_custom_chunker(spark):
    class Halves:
        def split_text(self, text):
            return [text[: len(text) // 2], text[len(text) // 2 :]]

    docs = spark.createDataFrame(
        [("d", "abcd", {"chunk_index": "9", "k": "v"}, 0), ("e", "", None, 1)], "doc_id string, content string, metadata map<string,string>, seq bigint"
    )
    rows = chunk_documents(docs.filter("content <> ''"), Halves()).orderBy("chunk_index").collect()
    assert [(r["chunk_id"], r["content"], r["metadata"]) for r in rows] == [
        ("d_chunk_0", "ab", {"k": "v", "chunk_index": "0", "total_chunks": "2"}),
        ("d_chunk_1", "cd", {"k": "v", "chunk_index": "1", "total_chunks": "2"}),
    ]
    assert chunk_documents(docs, SimpleCharacterChunker()).count() == 1
