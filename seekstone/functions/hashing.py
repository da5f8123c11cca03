"""A deterministic embedder made of hashes of character n-grams.

The folded text gets a blank at each end.  Each run of two and of three characters is hashed by MD5; the first four bytes,
modulo the dimension, choose a bucket, the parity of the fifth a sign; the sums are scaled to unit length.

The n-grams of a collection are few but occur often, so each is hashed once per worker and then looked up: one
Arrow pass without a shuffle.  The same as expressions (explode, hash, group by row and bucket) took 9.5 s where this takes
0.5 s (1,000 documents).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from seekstone.functions.vectors import EPS

SIZES = (2, 3)


class _Codes(dict):
    """n-gram -> bucket, plus the dimension for a negative sign."""

    def __init__(self, dim: int):
        super().__init__()
        self.dim = dim

    def __missing__(self, gram: str) -> int:
        digest = hashlib.md5(gram.encode("utf-8", "surrogatepass")).digest()
        code = int.from_bytes(digest[:4], "big") % self.dim + (self.dim if digest[4] % 2 else 0)
        if len(self) > 300_000:
            self.clear()
        self[gram] = code
        return code


def hash_vector(text: str | None, codes: _Codes) -> np.ndarray:
    padded = f" {(text or '').casefold()} "
    found = [codes[padded[i : i + n]] for n in SIZES for i in range(len(padded) - n + 1)]
    counts = np.bincount(found, minlength=2 * codes.dim).astype(np.float64) if found else np.zeros(2 * codes.dim)
    sums = counts[: codes.dim] - counts[codes.dim :]
    norm = np.sqrt(sums @ sums)
    return (sums / norm if norm > EPS else sums).astype(np.float32)


def hash_embed(df: DataFrame, key: str, text: str, dim: int = 64) -> DataFrame:
    """``(key, embedding array<float>)``.  Null counts as empty; rows with the same key each get a vector."""
    rows = df.select(F.col(key).alias("key"), F.col(text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = _Codes(dim)
        for b in batches:
            vectors = [hash_vector(t, codes) for t in b.column(1).to_pylist()]
            flat = pa.array(np.concatenate(vectors) if vectors else np.zeros(0, np.float32))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(vectors) + 1) * dim, pa.int32()), flat)
            yield pa.RecordBatch.from_arrays([b.column(0), lists], ["key", "embedding"])

    return rows.mapInArrow(run, f"key {dict(rows.dtypes)['key']}, embedding array<float>").withColumnRenamed("key", key)
