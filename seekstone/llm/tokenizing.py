"""Problem 7: the whole corpus as token ids of a public byte-level BPE.

Tree concatenation.  A text longer than a leaf is halved again and again; the leaves of all texts of a batch are encoded
at once, then joined pairwise up the tree.  At a join only a window around it is encoded again: from the
last place before it to the first place behind it where the tokenizer is sure to cut.  Where that window is one
long unsplit run, even that is not encoded anew: tokens around the join are, in a window that doubles until it
begins with the token the left side has there and ends with the one the right side has there.  Byte pair encoding
is right as a whole if it is right for every two neighbouring tokens, so agreement at both ends is exact.

Texts beyond ``SPREAD_CHARS`` are dealt, leaf by leaf, over many tasks and joined per text afterwards.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from seekstone.session import parallelism

#: Characters of a leaf, and of an unsplit run that is encoded in one go.
LEAF_CHARS = 4096
#: Texts beyond this are encoded by many tasks.
SPREAD_CHARS = 4_000_000
#: Fixed value: the published pattern of this family of tokenizers, which cuts a text before pairs are merged.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def vocabulary_path(name: str = "byte_bpe_50k", folder: str | None = None) -> str:
    """The ``.tiktoken`` file of a public tokenizer; ``folder`` is where the vocabularies lie on every executor."""
    import os

    folder = folder or os.environ.get("SEEKSTONE_TOKENIZERS", "/opt/tokenizers")
    return os.path.join(folder, f"{name}.tiktoken")


class Tree:
    """An encoder of one vocabulary.  ``leaf``: characters of a leaf."""

    def __init__(self, path: str, leaf: int = LEAF_CHARS):
        import regex
        import tiktoken

        with open(path, "rb") as file:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
        self.encoding = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.length = np.zeros(max(ranks.values()) + 1, dtype=np.int64)
        for token, rank in ranks.items():
            self.length[rank] = len(token)
        self.pieces = regex.compile(PATTERN)
        # sure cuts: white space behind anything else; a change between letters, numbers and the rest, except that
        # an apostrophe may take letters behind it along
        self.sure = regex.compile(
            r"(?<=\S)(?=\s)|(?<=\p{L})(?=[^\s\p{L}])|(?<=\p{N})(?=[^\s\p{N}])"
        )
        self.leaf = leaf

    def encode(self, texts: list[str]) -> list[list[int]]:
        """Ids of every text; special tokens' strings are ordinary text."""
        spans: list[list[tuple[int, int]]] = []
        flat: list[str] = []
        for text in texts:
            n = len(text)
            leaves = 1
            while n > leaves * self.leaf:
                leaves *= 2
            cuts = [n * k // leaves for k in range(leaves + 1)]
            spans.append(list(zip(cuts, cuts[1:])))
            flat.extend(text[a:b] for a, b in spans[-1])
        ids = [self.encoding.encode_ordinary(t) for t in flat]
        out, at = [], 0
        for text, cuts in zip(texts, spans):
            out.append(self.join_all(text, cuts, ids[at : at + len(cuts)]))
            at += len(cuts)
        return out

    def join_all(self, text: str, spans: list[tuple[int, int]], ids: list[list[int]]) -> list[int]:
        """Join neighbouring parts level by level until one is left."""
        while len(ids) > 1:
            joined, wider = [], []
            for k in range(0, len(ids) - 1, 2):
                a, m, b = spans[k][0], spans[k][1], spans[k + 1][1]
                joined.append(self.join(text[a:m], ids[k], text[m:b], ids[k + 1]))
                wider.append((a, b))
            if len(ids) % 2:
                joined.append(ids[-1])
                wider.append(spans[-1])
            ids, spans = joined, wider
        return ids[0]

    def join(self, left: str, left_ids: list[int], right: str, right_ids: list[int]) -> list[int]:
        """The ids of ``left + right`` from the ids of both."""
        if not left or not right:
            return left_ids or right_ids
        p = self._last_sure(left)
        q = self._first_sure(right)
        keep = self._tokens_back(left_ids, len(left[p:].encode("utf-8", "surrogatepass")))
        skip = self._tokens_ahead(right_ids, len(right[:q].encode("utf-8", "surrogatepass")))
        middle = left[p:] + right[:q]
        if len(middle) <= self.leaf:
            inner = self.encoding.encode_ordinary(middle)
        else:
            inner = self._join_run(middle, len(left) - p, left_ids[keep:], right_ids[:skip])
        return left_ids[:keep] + inner + right_ids[skip:]

    def _last_sure(self, text: str) -> int:
        width = 64
        while True:
            low = max(0, len(text) - width)
            last = 0
            for m in self.sure.finditer(text, low):
                last = m.start()
            if last > 0 or low == 0:
                return last
            width *= 4

    def _first_sure(self, text: str) -> int:
        m = self.sure.search(text, 1)
        return m.start() if m else len(text)

    def _tokens_back(self, ids: list[int], size: int) -> int:
        k = len(ids)
        while size > 0:
            k -= 1
            size -= int(self.length[ids[k]])
        assert size == 0, "a sure cut inside a token"
        return k

    def _tokens_ahead(self, ids: list[int], size: int) -> int:
        k = 0
        while size > 0:
            size -= int(self.length[ids[k]])
            k += 1
        assert size == 0, "a sure cut inside a token"
        return k

    def _join_run(self, middle: str, at: int, left_ids: list[int], right_ids: list[int]) -> list[int]:
        """Ids of a text without sure cuts around ``at``; ``left_ids`` and ``right_ids`` are those of both sides.  Pieces
        are cut as the tokenizer does; the one over the join, if long, is joined token by token."""
        out: list[int] = []
        used = 0  # bytes of the left side that earlier pieces took
        left_bytes = len(middle[:at].encode("utf-8", "surrogatepass"))
        for m in self.pieces.finditer(middle):
            piece = m.group()
            if m.end() <= at or m.start() >= at or len(piece) <= self.leaf:
                out.extend(self._run(piece))
                continue
            used = len(middle[: m.start()].encode("utf-8", "surrogatepass"))
            tail = self._aligned(left_ids[::-1], left_bytes - used)
            head = self._aligned(right_ids, len(middle[at : m.end()].encode("utf-8", "surrogatepass")))
            if tail is None or head is None:  # a side cut this run elsewhere
                out.extend(self._run(piece))
            else:
                out.extend(self.join_tokens(left_ids[len(left_ids) - tail :], right_ids[:head]))
        return out

    def _run(self, piece: str) -> list[int]:
        return self.encoding._encode_single_piece(piece.encode("utf-8", "replace"))

    def _aligned(self, ids: list[int], size: int) -> int | None:
        """How many leading tokens have together just ``size`` bytes."""
        k = 0
        while size > 0 and k < len(ids):
            size -= int(self.length[ids[k]])
            k += 1
        return k if size == 0 else None

    def join_tokens(self, left: list[int], right: list[int]) -> list[int]:
        """Merge two encodings of one unsplit run: encode growing windows around the join until both sides agree."""
        width = 8
        while True:
            a, b = max(0, len(left) - width), min(len(right), width)
            window = self.encoding.decode_bytes(left[a:] + right[:b])
            inner = self.encoding._encode_single_piece(window)
            if (a == 0 or inner[0] == left[a]) and (b == len(right) or inner[-1] == right[b - 1]):
                return left[:a] + inner + right[b:]
            width *= 2


@cache
def _tree(path: str, leaf: int) -> Tree:
    return Tree(path, leaf)


def _ids_array(ids: list[list[int]]) -> pa.ListArray:
    sizes = np.fromiter((len(x) for x in ids), dtype=np.int64, count=len(ids))
    flat = np.fromiter((t for x in ids for t in x), dtype=np.int32, count=int(sizes.sum()))
    return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(sizes)], pa.int32()), pa.array(flat))


def _encode_batches(batches: Iterator[pa.RecordBatch], path: str, leaf: int, count: bool) -> Iterator[pa.RecordBatch]:
    tree = _tree(path, leaf)
    for batch in batches:
        ids = tree.encode(batch.column(1).to_pylist())
        out = pa.array([len(x) for x in ids], pa.int32()) if count else _ids_array(ids)
        yield pa.RecordBatch.from_arrays([batch.column(0), out], ["key", "ids"])


def _encode_spread(long: DataFrame, path: str, leaf: int) -> DataFrame:
    """The leaves of huge texts as rows over all tasks, joined per text.  One text's ids must fit one row anyway."""
    types = dict(long.dtypes)
    cuts = F.sequence(F.lit(0), F.floor((F.length("text") - 1) / leaf).cast("int"))
    leaves = (
        long.withColumn("n", F.monotonically_increasing_id())
        .select("key", "n", F.posexplode(F.transform(cuts, lambda k: F.substring("text", k * leaf + 1, F.lit(leaf)))))
        .select("key", "n", F.col("pos").alias("k"), F.col("col").alias("part"))
        .repartition(parallelism(long.sparkSession))
    )

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree = _tree(path, leaf)
        for b in batches:
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), b.column(2), b.column(3), _ids_array(tree.encode(b.column(3).to_pylist()))],
                ["key", "n", "k", "part", "ids"],
            )

    def join(table: pa.Table) -> pa.Table:
        table = table.sort_by("k")
        parts = table.column("part").to_pylist()
        ends = np.cumsum([len(p) for p in parts]).tolist()
        ids = _tree(path, leaf).join_all("".join(parts), list(zip([0, *ends], ends)), table.column("ids").to_pylist())
        return pa.table({"key": table.column("key").slice(0, 1), "ids": pa.array([ids], pa.list_(pa.int32()))})

    encoded = leaves.mapInArrow(encode, f"key {types['key']}, n bigint, k int, part string, ids array<int>")
    return encoded.groupBy("n").applyInArrow(join, f"key {types['key']}, ids array<int>")


def token_ids(
    df: DataFrame,
    key: str,
    text: str,
    path: str | None = None,
    leaf_chars: int = LEAF_CHARS,
    spread_chars: int = SPREAD_CHARS,
) -> DataFrame:
    """``(key, ids)``: every row's text as token ids, without special tokens.

    Null and empty texts get an empty list.  Blank texts and repeated rows are encoded like any other; a null key stays.
    Strings of special tokens are ordinary text.  An empty table gives no row; other columns are ignored.
    ``path``: the vocabulary file, present on every executor; ``spread_chars``: texts beyond it are dealt over tasks.
    """
    path = path or vocabulary_path()
    rows = df.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    schema = f"key {dict(rows.dtypes)['key']}, ids array<int>"
    short = rows.filter(F.length("text") <= spread_chars)
    ids = short.mapInArrow(lambda batches: _encode_batches(batches, path, leaf_chars, False), schema)
    long = rows.filter(F.length("text") > spread_chars)
    if not long.isEmpty():
        ids = ids.unionByName(_encode_spread(long, path, leaf_chars))
    return ids.select(F.col("key").alias(key), "ids")


def token_counts(df: DataFrame, key: str, text: str, path: str | None = None) -> DataFrame:
    """``(key, n_tokens)``: only the number of tokens, so that no ids leave Python.  Cases as in :func:`token_ids`."""
    path = path or vocabulary_path()
    rows = df.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    schema = f"key {dict(rows.dtypes)['key']}, ids int"
    counts = rows.filter(F.length("text") <= SPREAD_CHARS).mapInArrow(
        lambda batches: _encode_batches(batches, path, LEAF_CHARS, True), schema
    )
    long = rows.filter(F.length("text") > SPREAD_CHARS)
    if not long.isEmpty():
        counts = counts.unionByName(_encode_spread(long, path, LEAF_CHARS).select("key", F.size("ids").alias("ids")))
    return counts.select(F.col("key").alias(key), F.col("ids").alias("n_tokens"))
