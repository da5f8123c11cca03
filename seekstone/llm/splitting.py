"""Problem 3: cutting oversized texts at natural boundaries, with overlap.

Pointer doubling.  Every place where a text may be cut is joined to its farthest legal successor: the last
place that a piece which starts there (with its overlap) may end.  The cuts of a text are the places reached from its
start; instead of walking from cut to cut, the table of successors is squared again and again, each time doubling
the steps that are known, for all places of several texts at once.  No text is shuffled.  A very long one is looked at
through windows of bounded size, each beginning at the last cut that the window before could tell for sure.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from seekstone.errors import ChunkingError
from seekstone.functions.text import strip

#: Kinds of boundary, the best first.
PARAGRAPH, LINE, SENTENCE, WORD = 4, 3, 2, 1
#: Characters that end a sentence; the last four need no blank behind them.
SENTENCE_ENDS = ".!?…"
WIDE_SENTENCE_ENDS = "。！？．"
CLOSERS = "\"')]}»”’」』"
#: Characters that are looked at together, some 40 bytes each; a longer text goes by windows of this size.
WINDOW = 4_000_000
_BLANKS = np.array([c for c in range(0x3001) if chr(c).isspace()], dtype=np.uint32)


def boundaries(code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of a text (array of code points) where a new piece may start, ascending, and their kinds.

    A run of white space belongs to what precedes it: the place is behind the run.  The start of the run is a place
    too, for runs that don't fit.
    """
    n = len(code)
    blank = np.isin(code, _BLANKS)
    breaks = (code == 10) | (code == 0x2028) | (code == 0x2029) | (code == 0x85)
    padded = np.r_[False, blank, False]
    start = np.flatnonzero(padded[1:-1] & ~padded[:-2])
    end = np.flatnonzero(padded[1:-1] & ~padded[2:]) + 1
    lines = np.r_[0, np.cumsum(breaks)]
    newlines = lines[end] - lines[start]
    ends = np.isin(code, np.array([ord(c) for c in SENTENCE_ENDS + WIDE_SENTENCE_ENDS], dtype=np.uint32))
    closing = np.isin(code, np.array([ord(c) for c in CLOSERS], dtype=np.uint32))
    before = np.maximum(start - 1, 0)
    stops = (start > 0) & (ends[before] | (closing[before] & ends[np.maximum(start - 2, 0)]))
    kind = np.where(newlines >= 2, PARAGRAPH, np.where(newlines == 1, LINE, np.where(stops, SENTENCE, WORD)))
    wide = np.flatnonzero(np.isin(code, np.array([ord(c) for c in WIDE_SENTENCE_ENDS], dtype=np.uint32))) + 1
    wide = wide[(wide < n)]
    at = np.r_[start, end, wide]
    kinds = np.r_[kind, kind, np.full(len(wide), SENTENCE)]
    best = np.zeros(n + 1, dtype=np.int8)
    np.maximum.at(best, at, kinds.astype(np.int8))
    best[0] = best[n] = PARAGRAPH
    places = np.flatnonzero(best)
    return places, best[places]


def _overlap_start(starts: np.ndarray, places: np.ndarray, overlap: np.ndarray) -> np.ndarray:
    """Where the piece that is cut at each of ``starts`` begins: at the first place within the overlap before it, else
    (no place there) exactly the overlap before it."""
    low = np.maximum(starts - overlap, 0)
    first = places[np.searchsorted(places, low)]  # exists: the start itself or an earlier place
    return np.where((first < starts) & (overlap > 0), first, np.where(overlap > 0, low, starts))


def cut_places(code: np.ndarray, size: int, overlap: int) -> tuple[np.ndarray, np.ndarray]:
    """Begin (with overlap) and cut of every piece of one text: piece k is ``code[begin[k] : cut[k + 1]]``."""
    begins, cuts, _ = _cut_many([code], np.array([size]), np.array([overlap]))
    return begins[0], cuts[0]


def _farthest(places, kinds, starts, begin, size):
    """The farthest legal successor of each start: the last place of the best kind in the second half of its window; else
    the last place of any kind in the window; else a cut inside a word, at the window's end."""
    limit = begin + size
    half = np.maximum(starts, begin + size // 2)
    out = np.zeros(len(starts), dtype=np.int64)
    for kind in (PARAGRAPH, LINE, SENTENCE, WORD):
        of = places[kinds >= kind]
        last = of[np.maximum(np.searchsorted(of, limit, side="right") - 1, 0)]
        out = np.where((out == 0) & (last > half) & (last <= limit), last, out)
    last = places[np.maximum(np.searchsorted(places, limit, side="right") - 1, 0)]
    out = np.where((out == 0) & (last > starts) & (last <= limit), last, out)
    return np.where(out == 0, limit, out)


def _cut_long(code: np.ndarray, size: int, overlap: int, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """The same by windows: a cut is sure if its piece ends before the window's last run of white space."""
    n, at = len(code), 0
    begins, cuts = [], [0]
    while at < n:
        low, end = max(0, at - overlap - 1), min(n, at + max(window, 4 * size))
        while low > 0 and np.isin(code[low - 1], _BLANKS):  # no run is seen in part
            low -= 1
        while end < n and np.isin(code[end - 1], _BLANKS):
            end += 1
        (begin,), (cut,), _ = _cut_many([code[low:end]], np.array([size]), np.array([overlap]), np.array([at - low]))
        sure = len(begin) if end == n else int(np.searchsorted(begin + size, end - low - 1))
        begins += (begin[:sure] + low).tolist()
        cuts += (cut[1 : sure + 1] + low).tolist()
        at = cuts[-1]
    return np.array(begins), np.array(cuts)


def _cut_many(codes: list[np.ndarray], sizes: np.ndarray, overlaps: np.ndarray, starts: np.ndarray | None = None):
    """Pointer doubling over all texts of a batch, laid end to end.  ``starts``: where the first piece of each starts, if not at 0."""
    starts = np.zeros(len(codes), np.int64) if starts is None else starts
    lengths = np.array([len(c) for c in codes], dtype=np.int64)
    base = np.r_[0, np.cumsum(lengths + 1)]  # one place more than characters: a text's end
    succ = np.arange(base[-1], dtype=np.int64)  # places not looked at lead nowhere
    begin_of = np.arange(base[-1], dtype=np.int64)
    for k, code in enumerate(codes):
        n, size, overlap = int(lengths[k]), int(sizes[k]), int(overlaps[k])
        places, kinds = boundaries(code)
        tidy = places[(places == n) | ~np.isin(code, _BLANKS)[np.minimum(places, n - 1)]]  # no piece begins blank
        wanted = np.union1d(places[(places < n) & (places >= starts[k])], starts[k : k + 1])
        seen = np.zeros(n + 1, dtype=bool)
        while len(wanted):  # cuts inside words make new places; rare
            seen[wanted] = True
            begin = _overlap_start(wanted, tidy, np.where(wanted == 0, 0, overlap))
            to = np.minimum(_farthest(places, kinds, wanted, begin, size), n)
            to = np.where(n <= begin + size, n, to)  # the rest fits
            succ[base[k] + wanted] = base[k] + to
            begin_of[base[k] + wanted] = base[k] + begin
            fresh = np.unique(to[to < n])
            wanted = fresh[~seen[fresh]]
    # the places reached from the starts: after step j all within 2**j cuts are marked
    reached = np.zeros(base[-1], dtype=bool)
    reached[base[:-1] + starts] = True
    jump = succ
    while True:
        marked = reached.copy()
        marked[jump[reached]] = True
        if (marked == reached).all():
            break
        reached, jump = marked, jump[jump]
    begins, cuts = [], []
    for k in range(len(codes)):
        at = np.flatnonzero(reached[base[k] : base[k + 1]])
        cuts.append(at)
        begins.append((begin_of[base[k] + at] - base[k])[:-1])
    return begins, cuts, base


def _portions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows with about ``WINDOW`` characters in all; a longer text is alone."""
    for batch in batches:
        sizes = pc.utf8_length(batch.column(batch.schema.get_field_index("text"))).to_numpy(zero_copy_only=False)
        a = 0
        while a < len(batch):
            b = a + max(1, int(np.searchsorted(np.cumsum(sizes[a:]), WINDOW, side="right")))
            yield batch.slice(a, b - a)
            a = b


def _split_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in _portions(batches):
        cols = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
        texts = cols["text"].to_pylist()
        codes = [np.frombuffer(t.encode("utf-32-le", "surrogatepass"), dtype=np.uint32) for t in texts]
        sizes, overlaps = cols["size"].to_numpy(), cols["overlap"].to_numpy()
        if len(codes) == 1 and len(codes[0]) > WINDOW:
            one = _cut_long(codes[0], int(sizes[0]), int(overlaps[0]))
            begins, cuts = [one[0]], [one[1]]
        else:
            begins, cuts, _ = _cut_many(codes, sizes, overlaps)
        row, index, start, end, fresh, piece = [], [], [], [], [], []
        for k, text in enumerate(texts):
            for j, (b, c, e) in enumerate(zip(begins[k].tolist(), cuts[k][:-1].tolist(), cuts[k][1:].tolist(), strict=True)):
                row.append(k)
                index.append(j)
                start.append(b)
                end.append(e)
                fresh.append(c)
                piece.append(text[b:e])
        take = pa.array(row, pa.int64())
        yield pa.RecordBatch.from_arrays(
            [
                cols["kind"].take(take),
                cols["id"].take(take),
                pa.array(index, pa.int32()),
                pa.array(start, pa.int32()),
                pa.array(fresh, pa.int32()),
                pa.array(end, pa.int32()),
                pa.array(piece, pa.string()),
            ],
            ["record_kind", "record_id", "piece_index", "start", "fresh_start", "end", "piece"],
        )


def split_oversized(df: DataFrame, kind: Column, key: str, text: str, size: Column, overlap: Column) -> DataFrame:
    """The pieces of every text that, stripped of white space at both ends, is longer than its ``size``.

    ``(record_kind, record_id, piece_index, start, fresh_start, end, piece)``: a piece is characters ``start`` to
    ``end`` of the stripped text, at most ``size`` code points; up to ``fresh_start`` it repeats the piece before
    (up to ``overlap`` characters, from a boundary on where there is one).  The fresh parts of all pieces, end to
    end, are the stripped text: nothing is lost.  A piece ends at the last paragraph end in the second half of its
    room, else at the last line end there, sentence end, word end, else at the last boundary of any kind, and only
    where its room holds none inside a word.

    Null, empty and blank texts, and texts that fit, give no row.  A null size never cuts.  Sizes below 1 and
    overlaps below 0 or not below the size raise a :class:`ChunkingError`, in the task that meets them.  Rows with
    the same id are cut each.  An empty table gives no row; other columns are ignored, whatever their names.
    """
    wrong = (F.col("size") < 1) | (F.col("overlap") < 0) | (F.col("overlap") >= F.col("size"))
    rows = df.select(
        kind.alias("kind"),
        F.col(key).alias("id"),
        strip(F.col(text)).alias("text"),
        size.cast("int").alias("size"),
        F.coalesce(overlap, F.lit(0)).cast("int").alias("overlap"),
    ).filter(F.length("text") > F.col("size"))
    message = F.concat(
        F.lit(f"{ChunkingError.__name__}: overlap must be at least 0 and smaller than the size, not "),
        F.col("overlap").cast("string"),
        F.lit(" and "),
        F.col("size").cast("string"),
    )
    rows = rows.withColumn("size", F.when(wrong, F.raise_error(message).cast("int")).otherwise(F.col("size")))
    types = dict(rows.dtypes)
    return rows.mapInArrow(
        _split_batches,
        f"record_kind string, record_id {types['id']}, piece_index int, start int, fresh_start int, end int, piece string",
    )
