"""Problem 4: records that are others with small edits, in one class per original.

Two records are linked if the sets of their runs of consecutive words (shingles) overlap by a Jaccard similarity of
at least a threshold; classes are what links join.  Exact: no link between different texts is missed.

A token-group matrix, in steps that each shuffle a compact table once:

1. equal texts count once; the shingles of a batch of texts are dealt to slices by hash, as packed arrays;
2. each slice counts in how many texts its shingles are; the counts go back to the texts.  Shingles of one text
   only are dropped, and texts left with too few shared shingles to be linked at all.  Of each text, the rarest shingles are
   kept: if two texts are linked, at least ``MATCHES`` of these are in both;
3. many alike texts are brought together first, by a few comparisons each: texts with equal least hashes of their shared
   shingles are compared with some others of these, in blocks of bounded size.  This finds links, and misses some;
4. texts are partitioned into groups of bounded size: what belongs together by step 3, else those that share their rarest
   shared shingle.  The matrix says which groups hold a shingle.  The number of a text's kept shingles in a group's union, plus
   what the shingles that weren't kept could add, bounds what the text shares with any member; groups whose bound is below
   what the sizes ask for stay closed, as do groups that hold nothing but the text's own class.  Of two classes the smaller
   one asks, so a huge class is asked about by few and asks about nobody;
5. in the groups that are opened, members are compared with the whole sets.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from seekstone.session import materialize, parallelism

#: Kept shingles that linked texts must have in common.
MATCHES = 4
#: Texts of a group at most, on average.
BLOCK = 256
#: Keys of a text, each made of so many least hashes, so that texts that merely share some phrases rarely have an equal one; by how
#: many of the keys it is compared before the matrix, and with how many texts in each block.
SKETCH, HASHES, COMPARED, REPRESENTATIVES = 4, 2, 2, 6
#: A key that fewer texts have isn't worth it: the matrix compares so few with each other.
WORTH = 32
#: Texts of a slice, about.
SLICE_TEXTS = 20_000
#: Links up to which one task joins them (16 bytes each); more are joined by rounds of tables.
SMALL_LINKS = 2_000_000
#: Tokens of one posting list up to which all of its pairs are looked at; longer ones go group by group.
SHORT_LIST = 512
#: Rows up to which a table of long integers is broadcast (16 MB).
BROADCAST_ROWS = 1_000_000
#: The same for tables with keys of some 40 bytes.
SMALL_ROWS = 200_000
MAX_ROUNDS = 60

#: Bits of a shingle within its slice.  Where two of one text fall together, the text needs one match less.
CELL_BITS = 28
#: Texts dealt at once; their places fit 16 bits.
BATCH = 60_000

_ODD = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xBF58476D1CE4E5B9)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _MIX
    return x ^ (x >> np.uint64(27))


_WORDS = re.compile(r"\w+")


class _Hashes(dict):
    """64-bit hashes of words, case-folded; remembered, as words repeat."""

    def __missing__(self, word: str) -> int:
        if len(self) > 500_000:
            self.clear()
        code = int.from_bytes(hashlib.blake2b(word.casefold().encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little")
        self[word] = code
        return code


_HASHES = _Hashes()


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of all words, texts end to end, and where each text begins."""
    found = [_WORDS.findall(t) for t in texts]
    offsets = np.r_[0, np.cumsum([len(w) for w in found])].astype(np.int64)
    get = _HASHES.__getitem__
    flat = np.fromiter((h for w in found for h in map(get, w)), np.uint64, count=int(offsets[-1]))
    return flat, offsets


def shingle_sets(h: np.ndarray, offsets: np.ndarray, seeds: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """``(doc, shingle)``, sorted, each shingle of a document once.  ``h``: hashes of all words, documents end to end;
    ``offsets``: where each begins; ``seeds``: equal for documents that may share shingles."""
    runs = np.maximum(np.diff(offsets) - width + 1, 0)
    doc = np.repeat(np.arange(len(runs), dtype=np.int64), runs)
    if not len(doc):
        return doc, np.zeros(0, np.uint64)
    at = np.arange(len(doc)) - np.repeat(np.cumsum(runs) - runs, runs) + offsets[:-1][doc]
    s = seeds[doc]
    for k in range(width):
        s = s * _ODD + h[at + k]
    s = _mixed(s)
    order = np.lexsort((s, doc))
    doc, s = doc[order], s[order]
    new = np.r_[True, (doc[1:] != doc[:-1]) | (s[1:] != s[:-1])]
    return doc[new], s[new]


def _sets(kinds: pa.Array, texts: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    seeds = np.array([_HASHES[k] for k in kinds.to_pylist()], np.uint64)
    return shingle_sets(*word_hashes(texts.to_pylist()), seeds, width)


def _pack(values: np.ndarray, kind: type) -> bytes:
    """An array by planes of bytes, compressed: high bytes are mostly equal."""
    planes = np.ascontiguousarray(values, kind).view(np.uint8).reshape(len(values), -1).T.tobytes()
    return len(planes).to_bytes(8, "little") + pa.Codec("zstd").compress(planes, asbytes=True)


def _unpack(data: bytes, kind: type) -> np.ndarray:
    planes = pa.Codec("zstd").decompress(data[8:], int.from_bytes(data[:8], "little"), asbytes=True)
    return np.frombuffer(planes, np.uint8).reshape(np.dtype(kind).itemsize, -1).T.copy().view(kind).ravel()


def _steps(ascending: np.ndarray) -> np.ndarray:
    return np.diff(ascending, prepend=ascending.dtype.type(0))


_POST = pa.schema([("slice", pa.int32()), ("uid", pa.int64()), ("a", pa.binary()), ("b", pa.binary()), ("c", pa.binary())])


def _rows(rows: list[tuple], schema: pa.Schema = _POST) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(schema.types)], schema=schema)


def _each(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)


def _slices_of(part: np.ndarray, slices: int) -> np.ndarray:
    return np.searchsorted(part, np.arange(slices + 1))


def _deal(batches: Iterator[pa.RecordBatch], slices: int, width: int) -> Iterator[pa.RecordBatch]:
    """(rid, kind, text) -> shingles by slice: (slice, uid, cells, texts).  ids run on within a batch: uid + place.  A row with
    slice < 0 tells of the batch: the sizes of its texts' sets."""
    for batch in batches:
        ids = batch.column(0).to_numpy()
        cuts = np.r_[0, np.flatnonzero(np.diff(ids) != 1) + 1, len(ids)]
        for start, end in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            for a in range(start, end, BATCH):
                part = batch.slice(a, min(BATCH, end - a))
                doc, s = _sets(part.column(1), part.column(2), width)
                uid = int(ids[a])
                size = np.bincount(doc, minlength=len(part))
                rows = [(-1 - uid % slices, uid, _pack(size, np.uint32), b"", b"")]
                slice_of = (s % np.uint64(slices)).astype(np.int32)
                cell = (_mixed(s * _ODD) >> np.uint64(64 - CELL_BITS)).astype(np.uint32)
                order = np.lexsort((cell, slice_of))
                bounds = _slices_of(slice_of[order], slices)
                for p in range(slices):
                    at = order[bounds[p] : bounds[p + 1]]
                    if len(at):
                        rows.append((p, uid, _pack(_steps(cell[at]), np.uint32), _pack(doc[at], np.uint16), b""))
                yield _rows(rows)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Whole slices -> the shingles that several texts have, with the number of texts.  Counted by batch of texts first, so
    that a shingle of very many texts takes no more memory than its packed lists."""
    held: dict[int, list[tuple]] = {}
    for p, uid, a, b, c in _each(batches):
        if p < 0:
            yield _rows([(p, uid, a, b, c)])
        else:
            cells, times = np.unique(np.cumsum(_unpack(a, np.uint32), dtype=np.uint32), return_counts=True)
            held.setdefault(p, []).append((uid, a, b, cells, times))
    for p, parts in held.items():
        cells, inverse = np.unique(np.concatenate([x[3] for x in parts]), return_inverse=True)
        total = np.bincount(inverse.ravel(), np.concatenate([x[4] for x in parts]), len(cells)).astype(np.uint32)
        for uid, a, b, _, _ in parts:
            t = np.cumsum(_unpack(a, np.uint32), dtype=np.uint32)
            f = total[np.searchsorted(cells, t)]
            some = f > 1
            if some.any():
                d = _unpack(b, np.uint16)
                yield _rows([(p, uid, _pack(_steps(t[some]), np.uint32), _pack(d[some], np.uint16), _pack(f[some], np.uint32))])


_KEPT = pa.schema(
    [
        ("uid", pa.int64()),
        *[(c, pa.binary()) for c in ("ids", "size", "twice", "rarest", "times", "keys", "slice", "cell", "doc", "short")],
    ]
)
_KEPT_SQL = "uid bigint, " + ", ".join(f"{c} binary" for c in _KEPT.names[1:])
_MATRIX = pa.schema([("slice", pa.int32()), ("uid", pa.int64()), *[(c, pa.binary()) for c in ("cell", "doc", "size", "grp", "own", "mates", "short")]])
_MATRIX_SQL = "slice int, uid bigint, " + ", ".join(f"{c} binary" for c in _MATRIX.names[2:])
_PAIRS = pa.schema([("slice", pa.int32()), *[(c, pa.binary()) for c in ("x", "g", "c", "need")]])


def _must(size: np.ndarray, threshold: float) -> np.ndarray:
    """What a text shares at least with any linked one ..."""
    return np.ceil(threshold * size - 1e-9).astype(np.int64)


def _must_larger(size: np.ndarray, threshold: float) -> np.ndarray:
    """... and with a linked one that isn't smaller."""
    return np.ceil(2 * threshold / (1 + threshold) * size - 1e-9).astype(np.int64)


def _keep(batches: Iterator[pa.RecordBatch], slices: int, threshold: float) -> Iterator[pa.RecordBatch]:
    """Whole batches of texts -> one row each: of the texts that can have a link their sizes, rarest shingle and least hashes, and
    of their rarest shingles slice and cell; ``short``: among the fewer that count against a text that isn't smaller."""
    sizes: dict[int, np.ndarray] = {}
    held: dict[int, list[tuple]] = {}
    for p, uid, a, b, c in _each(batches):
        if p < 0:
            sizes[uid] = _unpack(a, np.uint32).astype(np.int64)
        else:
            held.setdefault(uid, []).append((p, a, b, c))
    for uid, parts in held.items():
        size = sizes[uid]
        cells = [np.cumsum(_unpack(a, np.uint32), dtype=np.uint32) for _, a, _, _ in parts]
        token = np.concatenate([t.astype(np.uint64) * np.uint64(slices) + np.uint64(q[0]) for t, q in zip(cells, parts)])
        doc = np.concatenate([_unpack(b, np.uint16) for _, _, b, _ in parts]).astype(np.int64)
        df = np.concatenate([_unpack(c, np.uint32) for _, _, _, c in parts])
        shared = np.bincount(doc, minlength=len(size))
        must, more = _must(size, threshold), _must_larger(size, threshold)
        order = np.lexsort((_mixed(token * _ODD), df, doc))
        doc, df, token = doc[order], df[order], token[order]
        first = np.cumsum(shared) - shared
        place = np.arange(len(doc)) - first[doc] + (size - shared)[doc]  # shingles of one text come first
        good = (shared >= must) & (shared > 0)
        ids = np.flatnonzero(good)
        if not len(ids):
            continue
        keep = good[doc] & (place < (size - must + MATCHES)[doc])
        short = place < (size - more + MATCHES)[doc]
        twice = np.bincount(doc[1:][(doc[1:] == doc[:-1]) & (token[1:] == token[:-1])], minlength=len(size))
        some = np.flatnonzero(shared)
        keys = np.zeros((SKETCH, len(ids)), np.uint64)
        for k in range(SKETCH * HASHES):
            least = np.zeros(len(size), np.uint64)
            least[some] = np.minimum.reduceat(_mixed((token + np.uint64(k + 1)) * _ODD), first[some])
            keys[k // HASHES] = _mixed((keys[k // HASHES] + least[ids]) * _ODD + np.uint64(k))
        rarest, times = token[first[ids]], df[first[ids]]
        doc, token, short = doc[keep], token[keep], short[keep]
        slice_of, cell = (token % np.uint64(slices)).astype(np.uint32), (token // np.uint64(slices)).astype(np.uint32)
        order = np.lexsort((cell, slice_of))
        yield _rows(
            [
                (
                    uid,
                    _pack(ids, np.uint16),
                    _pack(size[ids], np.uint32),
                    _pack(twice[ids], np.uint32),
                    _pack(rarest, np.uint64),
                    _pack(times, np.uint32),
                    _pack(keys.ravel(), np.uint64),
                    _pack(_steps(slice_of[order]), np.uint32),
                    _pack(_steps(cell[order]), np.uint32),  # wraps where a slice begins
                    _pack(doc[order], np.uint16),
                    _pack(short[order], np.uint8),
                )
            ],
            _KEPT,
        )


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(uid, ids, keys) -> (key, rid)."""
    for uid, ids, keys in _each(batches):
        rid = _unpack(ids, np.uint16).astype(np.int64) + uid
        yield from pa.table({"key": _unpack(keys, np.uint64).view(np.int64), "rid": np.tile(rid, SKETCH)}).to_batches(max_chunksize=50_000)


def _with_uids(batches: Iterator[pa.RecordBatch], uids: np.ndarray) -> Iterator[pa.RecordBatch]:
    """(node, label, n) -> (uid, doc, label, n)."""
    for b in batches:
        node = b.column(0).to_numpy()
        uid = uids[np.searchsorted(uids, node, side="right") - 1]
        yield pa.RecordBatch.from_arrays([pa.array(uid), pa.array((node - uid).astype(np.int32)), b.column(1), b.column(2)], ["uid", "doc", "label", "n"])


def _grouped(uid: int, ids: np.ndarray, rarest: np.ndarray, times: np.ndarray, known: list | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(group, label, size of the class)`` of the texts ``ids`` of a batch; the label of a text without a class is its own id."""
    rid = ids + uid
    label, n, token = rid.copy(), np.ones(len(ids), np.int64), rarest.astype(np.uint64)
    members = times.astype(np.uint64)
    if known:
        at = np.searchsorted(ids, [k["doc"] for k in known])
        label[at] = [k["label"] for k in known]
        n[at] = [k["n"] for k in known]
        token[at], members[at] = _mixed(label[at].astype(np.uint64) + _MIX), n[at].astype(np.uint64)
    block = _mixed(rid.astype(np.uint64) * _ODD) % ((members + np.uint64(BLOCK - 1)) // np.uint64(BLOCK))
    # 32 bits: rarely two groups are one
    return (_mixed((token + block * _MIX) * _ODD) >> np.uint64(32)).astype(np.uint32), label, n


def _members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(uid, ids, rarest, times, known) -> (rid, g, label)."""
    for uid, ids, rarest, times, known in _each(batches):
        ids = _unpack(ids, np.uint16).astype(np.int64)
        g, label, _ = _grouped(uid, ids, _unpack(rarest, np.uint64), _unpack(times, np.uint32), known)
        yield from pa.table({"rid": ids + uid, "g": g.astype(np.int64), "label": label}).to_batches(max_chunksize=50_000)


def _spread(batches: Iterator[pa.RecordBatch], slices: int) -> Iterator[pa.RecordBatch]:
    """Batches of texts, with the classes that are known -> the matrix by slice."""
    for row in _each(batches):
        uid, ids, size, twice, rarest, times, slice_of, cell, doc, short, known = row
        ids = _unpack(ids, np.uint16).astype(np.int64)
        g, label, n = _grouped(uid, ids, _unpack(rarest, np.uint64), _unpack(times, np.uint32), known)
        slice_of = np.cumsum(_unpack(slice_of, np.uint32), dtype=np.uint32)
        cell, doc, short = np.cumsum(_unpack(cell, np.uint32), dtype=np.uint32), _unpack(doc, np.uint16), _unpack(short, np.uint8)
        at = np.searchsorted(ids, doc)
        sizes = _unpack(size, np.uint32).astype(np.uint64)[at] | (_unpack(twice, np.uint32).astype(np.uint64)[at] << np.uint64(32))
        own, mates = np.where(n == 1, 0, label + 1)[at], np.where(n == 1, 0, n)[at]  # mostly 0, which packs well
        bounds = _slices_of(slice_of, slices)
        rows = []
        for p in range(slices):
            c = slice(bounds[p], bounds[p + 1])
            if bounds[p] < bounds[p + 1]:
                rows.append(
                    (
                        p,
                        uid,
                        _pack(_steps(cell[c]), np.uint32),
                        _pack(doc[c], np.uint16),
                        _pack(sizes[c], np.uint64),
                        _pack(g[at[c]], np.uint32),
                        _pack(own[c], np.uint64),
                        _pack(mates[c], np.uint32),
                        _pack(short[c], np.uint8),
                    )
                )
        yield _rows(rows, _MATRIX)


def _needed(x: np.ndarray, y: np.ndarray, threshold: float) -> np.ndarray:
    """Kept shingles that texts of sizes x and y (not larger) must share: what a link asks for, less what the shingles
    that aren't kept can add.  All that both have lies in both kept parts or in the rest of one of them."""
    rest = np.maximum(_must(x, threshold), _must_larger(y, threshold)) - MATCHES
    both = np.ceil(threshold / (1 + threshold) * (x + y) - 1e-9).astype(np.int64)
    return np.maximum(1, both - np.maximum(rest, 0))


def _bound(batches: Iterator[pa.RecordBatch], slices: int, threshold: float) -> Iterator[pa.RecordBatch]:
    """Whole slices of the matrix -> (text, group, shared kept shingles, how many are needed), packed by text."""
    held: dict[int, list[tuple]] = {}
    for p, uid, cell, doc, size, grp, own, mates, short in _each(batches):
        rid = _unpack(doc, np.uint16).astype(np.int64) + uid
        label, n = _unpack(own, np.uint64).astype(np.int64) - 1, _unpack(mates, np.uint32).astype(np.int64)
        label, n = np.where(n == 0, rid, label), np.maximum(n, 1)
        held.setdefault(p, []).append(
            (np.cumsum(_unpack(cell, np.uint32), dtype=np.uint32), rid, _unpack(size, np.uint64), _unpack(grp, np.uint32), label, n, _unpack(short, np.uint8))
        )
    for parts in held.values():
        token, rid, marked, group, label, n, short = (np.concatenate(x) for x in zip(*parts, strict=True))
        size, twice = (marked & np.uint64(0xFFFFFFFF)).astype(np.int64), (marked >> np.uint64(32)).astype(np.int64)
        order = np.lexsort((rid, size, token))
        token, rid, size, group, twice, label, n, short = (v[order] for v in (token, rid, size, group, twice, label, n, short))
        if not len(token):
            continue
        # shingles that only one class has, or only for texts that are too large to be asked about, lead nowhere
        start = np.flatnonzero(np.r_[True, token[1:] != token[:-1]])
        useful = (np.minimum.reduceat(label, start) != np.maximum.reduceat(label, start)) & (np.maximum.reduceat(short, start) > 0)
        stay = np.repeat(useful, np.diff(np.r_[start, len(token)]))
        token, rid, size, group, twice, label, n, short = (v[stay] for v in (token, rid, size, group, twice, label, n, short))
        if not len(token):
            continue
        start = np.flatnonzero(np.r_[True, token[1:] != token[:-1]])
        length = np.diff(np.r_[start, len(token)])
        nth = np.repeat(np.arange(len(start)), length)
        some = np.flatnonzero(np.repeat(length <= SHORT_LIST, length))
        found = []
        for shift in range(1, int(length[length <= SHORT_LIST].max(initial=1))):
            x, y = some[shift:], some[:-shift]
            same = nth[x] == nth[y]
            if not same.any():
                break
            x, y = x[same], y[same]
            # the smaller isn't too small, and they aren't of one class already
            ok = (size[y] >= threshold * size[x] - 1e-9) & (short[y] > 0) & (label[x] != label[y])
            x, y = x[ok], y[ok]
            need, asks = _needed(size[x], size[y], threshold), n[x] <= n[y]
            found.append((np.where(asks, x, y), np.where(asks, group[y], group[x]), need))
        for k in np.flatnonzero(length > SHORT_LIST):  # a common shingle: by group, not by pair
            cut = slice(start[k], start[k] + length[k])
            for at, one in _by_group(size[cut], group[cut], label[cut], n[cut], short[cut] > 0, threshold):
                need = np.clip(_must(size[at + start[k]], threshold), 1, MATCHES)  # not more than any pair asks for
                found.append((at + start[k], np.full(len(at), one, np.uint32), need))
        if not found:
            continue
        x, g, need = (np.concatenate(f) for f in zip(*found, strict=True))
        order = np.lexsort((need, nth[x], g, rid[x]))
        x, g, need = x[order], g[order], need[order]
        text = rid[x]
        once = np.ones(len(x), bool)
        once[1:] = (nth[x][1:] != nth[x][:-1]) | (g[1:] != g[:-1]) | (text[1:] != text[:-1])
        begin = np.ones(len(x), bool)
        begin[1:] = (g[1:] != g[:-1]) | (text[1:] != text[:-1])
        begin = np.flatnonzero(begin)
        if len(begin):
            count = np.add.reduceat(once.astype(np.int64), begin)
            need = np.maximum(1, np.minimum.reduceat(need, begin) - twice[x[begin]])
            yield from _by_text(text[begin], g[begin], count, need, slices)


def _by_group(size, group, label, n, short, threshold: float) -> Iterator[tuple[np.ndarray, int]]:
    """Texts of one long list, sorted by size, that ask about a group, for each group: those of a class that isn't larger, with a
    member near enough in size, of which the smaller one's shingle is short."""
    by_class = np.argsort(n, kind="stable")  # who may ask a group is a prefix of this
    ascending = n[by_class]
    order = np.argsort(group, kind="stable")
    for ys in np.split(order, np.flatnonzero(np.diff(group[order])) + 1):  # places rise within a group
        asks = by_class[: np.searchsorted(ascending, n[ys].max(), side="right")]
        if len(ys) and (label[ys] == label[ys[0]]).all():
            asks = asks[label[asks] != label[ys[0]]]
        if not len(asks):
            continue
        small = ys[short[ys]]
        low = np.searchsorted(size[small], threshold * size[asks] - 1e-9)  # the first that isn't too small ...
        below = np.r_[small, len(size)][low] < asks  # ... stands before the text
        after = np.r_[ys, len(size)][np.searchsorted(ys, asks, side="right")]  # the next larger one
        above = short[asks] & (n[asks] < n[ys].max()) & (after < len(size)) & (size[asks] >= threshold * size[np.minimum(after, len(size) - 1)] - 1e-9)
        at = asks[below | above]
        if len(at):
            yield at, int(group[ys[0]])


def _by_text(text: np.ndarray, g: np.ndarray, count: np.ndarray, need: np.ndarray, slices: int) -> Iterator[pa.RecordBatch]:
    slice_of = (_mixed(text.astype(np.uint64) * _ODD) % np.uint64(slices)).astype(np.int32)
    order = np.argsort(slice_of, kind="stable")
    bounds = _slices_of(slice_of[order], slices)
    rows = []
    for p in range(slices):
        at = order[bounds[p] : bounds[p + 1]]
        if len(at):
            x = _pack(_steps(text[at]), np.int64)
            rows.append((p, x, _pack(g[at], np.uint32), _pack(count[at], np.uint32), _pack(need[at], np.uint32)))
    yield _rows(rows, _PAIRS)


def _open(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Whole slices of bounds -> the (text, group) that qualify."""
    held: dict[int, list[tuple]] = {}
    for p, x, g, c, need in _each(batches):
        held.setdefault(p, []).append(
            (np.cumsum(_unpack(x, np.int64)), _unpack(g, np.uint32), _unpack(c, np.uint32), _unpack(need, np.uint32))
        )
    for parts in held.values():
        x, g, c, need = (np.concatenate(a) for a in zip(*parts, strict=True))
        order = np.lexsort((g, x))
        x, g, c, need = x[order], g[order].astype(np.int64), c[order].astype(np.int64), need[order].astype(np.int64)
        if not len(x):
            continue
        begin = np.flatnonzero(np.r_[True, (x[1:] != x[:-1]) | (g[1:] != g[:-1])])
        ok = np.add.reduceat(c, begin) >= np.minimum.reduceat(need, begin)
        out = pa.table({"x": x[begin][ok], "g": g[begin][ok]})
        yield from out.to_batches(max_chunksize=100_000)


class _Roots(dict):
    """Union-find."""

    def __missing__(self, x: int) -> int:
        self[x] = x
        return x

    def find(self, x: int) -> int:
        while self[x] != x:
            self[x] = self[self[x]]
            x = self[x]
        return x


def _each_group(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Rows sorted by the first column -> tables of whole groups."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not len(batch):
            continue
        held.append(batch)
        g = batch.column(0).to_numpy()
        changes = np.flatnonzero(g[1:] != g[:-1])
        if len(changes):
            cut = int(changes[-1]) + 1
            yield pa.Table.from_batches([*held[:-1], batch.slice(0, cut)])
            held = [batch.slice(cut)]
        elif len(held) > 1 and held[0].column(0)[0].as_py() != g[0]:
            yield pa.Table.from_batches(held[:-1])
            held = [batch]
    if held:
        yield pa.Table.from_batches(held)


def _starts(g: np.ndarray) -> Iterator[tuple[int, int]]:
    starts = np.flatnonzero(np.r_[True, g[1:] != g[:-1]])
    return zip(starts.tolist(), np.r_[starts[1:], len(g)].tolist(), strict=True)


def _prelink(batches: Iterator[pa.RecordBatch], width: int, threshold: float) -> Iterator[pa.RecordBatch]:
    """Blocks, rows sorted by block, first ones first: (g, later, rid, kind, text) -> links.  Each text is compared with the
    first ones, which all blocks of a key have in common, and with the last few that began a class of the block."""
    for table in _each_group(batches):
        g, later, rid = (table.column(k).to_numpy(zero_copy_only=False) for k in ("g", "later", "rid"))
        doc, s = _sets(table.column("kind"), table.column("text"), width)
        cuts = np.searchsorted(doc, np.arange(len(g) + 1))
        sets = [s[a:b] for a, b in zip(cuts[:-1], cuts[1:])]
        left, right = [], []
        for a, b in _starts(g):
            roots, first, recent = _Roots(), [], []
            for x in range(a, b):
                began = True
                for y in first + recent[-REPRESENTATIVES:]:
                    if rid[x] == rid[y]:
                        began = False
                        continue
                    if roots.find(int(rid[x])) == roots.find(int(rid[y])):
                        continue
                    both = len(np.intersect1d(sets[x], sets[y], assume_unique=True))
                    if both >= threshold * (len(sets[x]) + len(sets[y]) - both) - 1e-9:
                        roots[roots.find(int(rid[x]))] = roots.find(int(rid[y]))
                        left.append(int(rid[x]))
                        right.append(int(rid[y]))
                        began = False
                if not later[x]:
                    first.append(x)
                elif began:
                    recent.append(x)
        yield pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], ["u", "v"])


def _verify(batches: Iterator[pa.RecordBatch], width: int, threshold: float) -> Iterator[pa.RecordBatch]:
    """Opened groups, rows sorted by group: (g, asks, rid, label, kind, text) -> links between classes."""
    for table in _each_group(batches):
        g, asks, rid, label = (table.column(k).to_numpy(zero_copy_only=False) for k in ("g", "asks", "rid", "label"))
        doc, s = _sets(table.column("kind"), table.column("text"), width)
        cuts = np.searchsorted(doc, np.arange(len(g) + 1))
        size = np.diff(cuts)
        left, right = [], []
        for a, b in _starts(g):
            members = np.flatnonzero(~asks[a:b]) + a
            held = np.concatenate([s[cuts[y] : cuts[y + 1]] for y in members] + [s[:0]])
            owner = np.repeat(np.arange(len(members)), size[members])
            order = np.argsort(held, kind="stable")
            held, owner = held[order], owner[order]
            roots = _Roots()
            for x in np.flatnonzero(asks[a:b]) + a:
                mine = s[cuts[x] : cuts[x + 1]]
                low, high = np.searchsorted(held, mine), np.searchsorted(held, mine, side="right")
                times = high - low
                at = np.arange(times.sum()) + np.repeat(low - (np.cumsum(times) - times), times)
                both = np.bincount(owner[at], minlength=len(members))  # with every member at once
                for k in np.flatnonzero(both >= threshold * (size[x] + size[members] - both) - 1e-9):
                    y = members[k]
                    one, other = roots.find(int(label[x])), roots.find(int(label[y]))
                    if one != other:  # a class needs no further link
                        roots[one] = other
                        left.append(int(rid[x]))
                        right.append(int(rid[y]))
        yield pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], ["u", "v"])


def _among(df: DataFrame, column: str, keys: DataFrame) -> DataFrame:
    """Rows whose ``column`` is in the one-column table ``keys``: broadcast up to a checked size, else shuffled."""
    few = keys.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    return df.join(F.broadcast(keys) if few else keys, column, "left_semi")


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All links -> every node with the least node of its component."""
    held = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches if len(b)]
    if held:
        u, v = (np.concatenate(x) for x in zip(*held, strict=True))
        node, ends = np.unique(np.r_[u, v], return_inverse=True)
        u, v = np.split(ends.ravel(), 2)
        label = np.arange(len(node))
        while (label[u] != label[v]).any():
            np.minimum.at(label, np.maximum(label[u], label[v]), np.minimum(label[u], label[v]))
            while (label != label[label]).any():
                label = label[label]
        yield from pa.table({"node": node, "label": node[label]}).to_batches(max_chunksize=50_000)


def components(links: DataFrame) -> DataFrame:
    """``(node, label)``: the least node of each component of the links ``(u, v)``.

    Up to ``SMALL_LINKS`` links are joined in one task.  More go by rounds: each round a node takes the least of its label's label and those of the nodes around it, and the node that was its label
    takes it too.  So whole trees are hooked at their roots where they meet, and rounds grow about with the logarithm
    of the longest path.  Ends only when no label changes; raises if ``MAX_ROUNDS`` don't suffice.  Every round is a table
    in the shared folder, so lineage stays short and no executor's loss hurts.
    """
    links = links.filter("u <> v").select("u", "v")
    if links.limit(SMALL_LINKS + 1).count() <= SMALL_LINKS:
        return materialize(links.coalesce(1).mapInArrow(_joined, "node bigint, label bigint"), "labels")
    edges = links.select("u", "v").unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    # a node is around itself, so that its own label comes along
    edges = materialize(edges.unionByName(edges.select("u", F.col("u").alias("v"))).distinct(), "edges")
    labels = materialize(edges.groupBy("u").agg(F.min("v").alias("label")).withColumnRenamed("u", "node"), "labels")
    for _ in range(MAX_ROUNDS):
        above = labels.select(F.col("node").alias("label"), F.col("label").alias("up"))
        labels = labels.join(above, "label").select(F.col("node").alias("v"), "label", "up")
        own = F.max(F.when(F.col("u") == F.col("v"), F.col("label"))).alias("old")
        around = edges.join(labels, "v").groupBy("u").agg(own, F.min("up").alias("m"))
        node = F.struct(F.col("u").alias("node"), "old", F.least("old", "m").alias("label"))
        root = F.struct(F.col("old").alias("node"), F.lit(None).cast("bigint").alias("old"), F.col("m").alias("label"))
        taken = around.select(F.explode(F.array(node, root)).alias("t")).select("t.*")
        new = materialize(taken.groupBy("node").agg(F.max("old").alias("old"), F.min("label").alias("label")), "labels")
        labels = new.select("node", "label")
        if new.filter("label <> old").isEmpty():
            return labels
    raise RuntimeError(f"The classes weren't settled after {MAX_ROUNDS} rounds.")


def near_duplicates(
    df: DataFrame, kind: str, key: str, text: str, threshold: float = 0.8, width: int = 5, min_words: int = 1
) -> DataFrame:
    """``(kind, key, class)``: one row per record (each kind and key once), with the least key of its class.

    Records of different kinds are never linked.  Records with fewer than ``min_words`` words (at least ``width``),
    among them null, empty and blank texts, are a class of their own each, as is any without a link; records with the same
    text are one class.  Rows with a null kind or key are dropped.  An empty table gives no row; other columns are ignored.
    """
    spark = df.sparkSession
    wanted = max(min_words, width)
    rows = df.filter(F.col(kind).isNotNull() & F.col(key).isNotNull()).select(
        F.col(kind).alias("kind"),
        F.col(key).alias("key"),
        F.coalesce(F.col(text), F.lit("")).alias("text"),
    )
    rows = rows.withColumn("same", F.unhex(F.md5(F.concat_ws("\x00", "kind", "text"))))
    # enough words: looked at from the start, without going back
    word, gap = r"[\p{L}\p{N}_]", r"[^\p{L}\p{N}_]"
    enough = F.col("text").rlike(f"^{gap}*+(?:{word}++{gap}++){{{wanted - 1}}}{word}")
    texts = rows.filter(enough).dropDuplicates(["same"])  # the only time that texts are shuffled
    texts = materialize(texts.select(F.monotonically_increasing_id().alias("rid"), "kind", "same", "text"), "texts")
    slices = max(16, 2 * parallelism(spark), texts.count() // SLICE_TEXTS)
    blob = "slice int, uid bigint, a binary, b binary, c binary"
    dealt = texts.select("rid", "kind", "text").mapInArrow(lambda b: _deal(b, slices, width), blob)
    counted = dealt.repartition(slices, "slice").mapInArrow(_count, blob)
    kept = counted.repartition(slices, "uid").mapInArrow(lambda b: _keep(b, slices, threshold), _KEPT_SQL)
    kept = materialize(kept, "kept")
    first = materialize(_prelinks(kept, texts, slices, width, threshold), "first-links")
    labels = components(first)
    sizes = labels.groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    labels = materialize(labels.join(_small(materialize(sizes, "class-sizes")), "label").select("node", "label", "n"), "classes")
    # a batch of texts has up to 10,000 of them, so these are few
    uids = np.array(sorted(r["uid"] for r in kept.select("uid").collect()), np.int64)
    of_batch = labels.mapInArrow(lambda b: _with_uids(b, uids), "uid bigint, doc int, label bigint, n bigint")
    known = F.array_sort(F.collect_list(F.struct("doc", "label", "n"))).alias("known")  # of one batch
    known = of_batch.groupBy("uid").agg(known)
    known = F.broadcast(known) if labels.count() <= BROADCAST_ROWS else known
    held = kept.join(known, "uid", "left")
    matrix = held.select("uid", "ids", "size", "twice", "rarest", "times", "slice", "cell", "doc", "short", "known")
    bounds = (
        matrix.mapInArrow(lambda b: _spread(b, slices), _MATRIX_SQL)
        .repartition(slices, "slice")
        .mapInArrow(lambda b: _bound(b, slices, threshold), "slice int, x binary, g binary, c binary, need binary")
    )
    opened = bounds.repartition(slices, "slice").mapInArrow(_open, "x bigint, g bigint")
    opened = materialize(opened, "opened")
    groups = held.select("uid", "ids", "rarest", "times", "known").mapInArrow(_members, "rid bigint, g bigint, label bigint")
    members = _among(groups, "g", opened.select("g").distinct())
    asks = opened.select(F.col("x").alias("rid"), "g", F.lit(True).alias("asks"))
    asking = _among(groups, "rid", asks.select("rid").distinct()).select("rid", "label")
    asks = asks.join(asking, "rid")
    parts = asks.select("rid", "g", "asks", "label").unionByName(members.select("rid", "g", F.lit(False).alias("asks"), "label"))
    parts = materialize(parts, "parts")
    few = _among(texts, "rid", parts.select("rid").distinct()).select("rid", "kind", "text")
    links = (
        parts.join(few, "rid")
        .select("g", "asks", "rid", "label", "kind", "text")
        .repartition(slices, "g")
        .sortWithinPartitions("g", "asks")
        .mapInArrow(lambda b: _verify(b, width, threshold), "u bigint, v bigint")
    )
    # the classes that were known stand for their texts' links
    links = links.unionByName(labels.select(F.col("node").alias("u"), F.col("label").alias("v")))
    labels = components(materialize(links, "links"))
    linked = texts.select(F.col("rid").alias("node"), "same").join(_small(labels), "node").select("same", "label")
    linked = materialize(linked, "linked")
    # what has no link keeps its own text as label; records below the least length their own key
    own = F.when(F.col("label").isNotNull(), F.concat(F.lit("l"), F.col("label").cast("string"))).otherwise(
        F.when(F.col("long"), F.concat(F.lit("t"), F.hex("same"))).otherwise(F.concat(F.lit("k"), F.col("key").cast("string")))
    )
    records = rows.select("kind", "key", "same", enough.alias("long")).dropDuplicates(["kind", "key"])
    labelled = materialize(records.join(_small(linked), "same", "left").select("kind", "key", own.alias("own")), "labelled")
    several = labelled.groupBy("kind", "own").agg(F.min("key").alias("class"), F.count(F.lit(1)).alias("n"))
    several = materialize(several.filter("n > 1").drop("n"), "several")
    classes = labelled.join(_small(several), ["kind", "own"], "left")
    return classes.select(F.col("kind").alias(kind), F.col("key").alias(key), F.coalesce("class", "key").alias("class"))


def _prelinks(kept: DataFrame, texts: DataFrame, slices: int, width: int, threshold: float) -> DataFrame:
    """``(u, v)``: links found by few comparisons a text, most of those that join large classes."""
    keys = kept.select("uid", "ids", "keys").mapInArrow(_keys, "key bigint, rid bigint")
    counts = keys.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("rid").alias("low"), F.max("rid").alias("high"))
    counts = materialize(counts.filter(F.col("n") >= WORTH), "keys")
    # of each text the keys that most others have
    most = F.row_number().over(Window.partitionBy("rid").orderBy(F.col("n").desc(), "key"))
    few = counts.count() <= BROADCAST_ROWS
    chosen = keys.join(F.broadcast(counts) if few else counts, "key").withColumn("p", most).filter(F.col("p") <= COMPARED)
    blocks = F.ceil(F.col("n") / BLOCK)
    placed = chosen.select("key", F.pmod(F.xxhash64("rid"), blocks).alias("block"), "rid", F.lit(True).alias("later"))
    every = F.explode(F.sequence(F.lit(0).cast("bigint"), blocks - 1)).alias("block")
    first = counts.filter(F.col("n") > BLOCK).select("key", every, F.array("low", "high").alias("rids"))
    first = first.select("key", "block", F.explode("rids").alias("rid"), F.lit(False).alias("later"))
    parts = materialize(placed.unionByName(first).select(F.xxhash64("key", "block").alias("g"), "later", "rid"), "blocks")
    wanted = _among(texts, "rid", parts.select("rid").distinct()).select("rid", "kind", "text")
    return (
        parts.join(wanted, "rid")
        .select("g", "later", "rid", "kind", "text")
        .repartition(slices, "g")
        .sortWithinPartitions("g", "later", "rid")
        .mapInArrow(lambda b: _prelink(b, width, threshold), "u bigint, v bigint")
    )


def _small(table: DataFrame) -> DataFrame:
    """Broadcast up to a checked size, else left to a shuffle.  For stored tables, which are counted without reading them."""
    return F.broadcast(table) if table.count() <= SMALL_ROWS else table


def class_pairs(classes: DataFrame, kind: str, key: str) -> DataFrame:
    """``(kind, a, b)``: all pairs of different records of a class, the smaller key first."""
    # a class is named by its least key, so all others have another one
    rest = classes.filter(F.col("class") != F.col(key))
    one = rest.select(kind, "class", F.col(key).alias("b")).unionByName(
        rest.select(kind, "class", F.col("class").alias("b")).distinct()
    )
    return (
        one.withColumnRenamed("b", "a").join(one, [kind, "class"]).filter("a < b").select(kind, "a", "b")
    )
