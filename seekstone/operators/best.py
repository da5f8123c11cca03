"""The best hits of many searches at once, as one task keeps them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Hits that the searches of a block or round ask for together; a task holds about twice as many.
BLOCK_HITS = 1_500_000
#: Hits that all tasks together pass on, as long as each core has a task.
PASSED_HITS = 4_000_000


def gathered(table: DataFrame, hits: int) -> DataFrame:
    """``table`` in no more parts than let each pass on ``hits`` hits, one for each core at least; no shuffle, and order within
    the parts stays."""
    return table.coalesce(max(table.sparkSession.sparkContext.defaultParallelism, PASSED_HITS // max(1, hits)))


class Best:
    """Of each search the best ``ks`` hits seen so far, equal scores (to 9 digits) by ``seq``.

    However many hits come, about twice as many are held as come out.  Ids are held once for each row, not for each hit."""

    def __init__(self, ks: np.ndarray):
        self.ks = ks
        #: What is below can't be among the best any more.
        self.bound = np.where(ks > 0, -np.inf, np.inf)
        self.most = 2 * int(ks.sum()) + 200_000
        self.held: list[tuple[np.ndarray, ...]] = []
        self.count = 0
        self.ids: list[pa.Array] = []
        self.known, self.limit = 0, 500_000

    def rows(self, ids: pa.Array) -> int:
        """Take the ids of new rows; returns the place of the first, by which :meth:`add` names them until the next call."""
        if self.known > self.limit:
            self._keep()
            self._forget()
        self.ids.append(ids.take(pa.array(np.arange(len(ids)))))  # a copy, as a part would hold all of its batch
        self.known += len(ids)
        return self.known - len(ids)

    def add(self, search: np.ndarray, score: np.ndarray, seq: np.ndarray, place: np.ndarray) -> None:
        self.held.append((search.astype(np.int32), score, seq, place))
        self.count += len(search)
        if self.count > self.most:
            self._keep()

    def _keep(self) -> None:
        if not self.count:
            return
        search, score, seq, place = (np.concatenate(parts) for parts in zip(*self.held))
        self.held = []
        order = np.lexsort((seq, -np.round(score, 9), search))
        at = search[order]
        start = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
        rank = np.arange(len(at)) - np.repeat(start, np.diff(np.r_[start, len(at)]))
        last = rank == self.ks[at] - 1
        self.bound[at[last]] = score[order[last]] - 1e-9  # equal ones are left to the final order
        order = order[rank < self.ks[at]]
        self.held, self.count = [(search[order], score[order], seq[order], place[order])], len(order)

    def _forget(self) -> None:
        """Let go of the ids of rows that no hit names."""
        if not self.count:
            self.ids, self.known = [], 0
            return
        search, score, seq, place = self.held[0]
        named, place = np.unique(place, return_inverse=True)
        self.ids = [pa.chunked_array(self.ids).take(pa.array(named)).combine_chunks()]
        self.held = [(search, score, seq, place)]
        self.known, self.limit = len(named), max(500_000, 2 * len(named))

    def batches(self, names: np.ndarray) -> Iterator[pa.RecordBatch]:
        """``(query_id, chunk_id, score, seq, k)``; ``names``: the ids of the searches."""
        self._keep()
        if not self.count:
            return
        ids, columns = pa.chunked_array(self.ids), self.held[0]
        for a in range(0, self.count, 50_000):
            search, score, seq, place = (c[a : a + 50_000] for c in columns)
            found = ids.take(pa.array(place)).combine_chunks()
            yield pa.RecordBatch.from_arrays(
                [pa.array(names[search]), found, pa.array(score), pa.array(seq), pa.array(self.ks[search].astype(np.int32))],
                ["query_id", "chunk_id", "score", "seq", "k"],
            )
