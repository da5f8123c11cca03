"""Problem 8: filling containers of fixed capacity with items of varying length.

Pattern packing.  All that packing needs to know of any number of items is how many there are of each length: a
histogram of at most ``capacity`` rows, which the driver may hold whatever the size of the collection.  There,

1. all patterns of one to three lengths that fill a container exactly are listed;
2. non-negative least squares fits how often each is used to the histogram; the fit is rounded to whole containers;
3. what is left is packed by length, the longest first, each into the fullest container that it fits, many equal
   containers at a time.

The result is a plan by length, of bounded size.  Items are numbered within their length without bringing a length
into one task, and each looks its place up in the plan.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from seekstone.session import materialize, parallelism

CAPACITY = 2048
#: Least and most parts into which the items of one length are dealt for numbering; between them twice the session's
#: parallelism.
DEALS = (64, 1024)
FIT_STEPS = 400


@dataclass
class Plan:
    """Slots by length: items number ``first`` to ``first + count`` of a length go ``per`` to a container, from
    container ``base`` on, the first of each at ``offset``.  Sorted by (length, first)."""

    length: np.ndarray
    first: np.ndarray
    base: np.ndarray
    per: np.ndarray
    offset: np.ndarray
    containers: int


def exact_patterns(lengths: np.ndarray, capacity: int) -> np.ndarray:
    """All multisets of one to three of ``lengths`` with the sum ``capacity``; rows of three, zeros fill."""
    there = np.zeros(capacity + 1, dtype=bool)
    there[lengths] = True
    found = []
    if there[capacity]:
        found.append([[capacity, 0, 0]])
    a = lengths[lengths * 2 >= capacity]
    a = a[a < capacity]
    pairs = a[there[capacity - a]]
    if len(pairs):
        found.append(np.c_[pairs, capacity - pairs, np.zeros(len(pairs), dtype=int)])
    for first in lengths:  # the longest of the three
        rest = capacity - int(first)
        second = lengths[(lengths <= first) & (lengths * 2 >= rest) & (lengths < rest)]
        second = second[there[rest - second]]
        if len(second):
            found.append(np.c_[np.full(len(second), first), second, rest - second])
    return np.concatenate([np.asarray(f, dtype=np.int64) for f in found]) if found else np.zeros((0, 3), np.int64)


def fit_repeats(patterns: np.ndarray, histogram: np.ndarray, steps: int = FIT_STEPS) -> np.ndarray:
    """Non-negative repeats of the patterns that come closest to the histogram: accelerated projected gradient.

    The matrix has a column per pattern with three entries at most, so a step is one gather and one weighted count.
    Small lengths weigh less: they are easily placed afterwards."""
    m = len(patterns)
    if not m:
        return np.zeros(0)
    capacity = len(histogram) - 1
    weight = np.arange(capacity + 1) / capacity  # the share of a container that a missed item leaves
    weight[0] = 0.0
    flat = patterns.ravel()
    target = histogram * weight

    def apply(x: np.ndarray) -> np.ndarray:
        return np.bincount(flat, np.repeat(x, 3), minlength=capacity + 1) * weight

    def back(r: np.ndarray) -> np.ndarray:
        return (r * weight)[patterns].sum(axis=1)

    v = np.ones(m)
    for _ in range(12):  # the largest eigenvalue bounds the step
        v = back(apply(v))
        v /= np.linalg.norm(v) or 1.0
    rate = 1.0 / (1.05 * max(float(np.linalg.norm(back(apply(v)))), 1e-9))
    x = y = np.zeros(m)
    t = 1.0
    for _ in range(steps):
        new = np.maximum(0.0, y - rate * back(apply(y) - target))
        t_new = (1 + np.sqrt(1 + 4 * t * t)) / 2
        y = new + (t - 1) / t_new * (new - x)
        x, t = new, t_new
    return x


def round_repeats(patterns: np.ndarray, repeats: np.ndarray, histogram: np.ndarray) -> np.ndarray:
    """Whole repeats that use no length more often than the histogram has it: the largest fits first."""
    left = histogram.copy()
    whole = np.zeros(len(patterns), dtype=np.int64)
    order = np.argsort(-repeats, kind="stable")
    for up in (False, True):  # rounded down first; then once more each where the fit asked for a part
        for j in order:
            wish = int(np.ceil(repeats[j]) - whole[j]) if up else int(repeats[j])
            if wish <= 0:
                if repeats[j] <= 0:
                    break
                continue
            parts, times = np.unique(patterns[j][patterns[j] > 0], return_counts=True)
            can = min(wish, int((left[parts] // times).min()))
            if can > 0:
                whole[j] += can
                left[parts] -= can * times
    return whole


def pack_histogram(histogram: np.ndarray, capacity: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """``(containers, [(length, how many in each), ...])``: the longest first, best fit, equal containers together."""
    rooms: dict[int, list[tuple[int, tuple]]] = {}  # free space -> (containers, contents)
    full: list[tuple[int, tuple]] = []

    def put(count: int, contents: tuple, free: int) -> None:
        if not count:
            return
        if free:
            rooms.setdefault(free, []).append((count, contents))
        else:
            full.append((count, contents))

    for length in range(capacity, 0, -1):
        n = int(histogram[length])
        while n:
            free = next((f for f in range(length, capacity + 1) if rooms.get(f)), None)
            if free is None:
                per = capacity // length
                if n >= per:
                    put(n // per, ((length, per),), capacity - per * length)
                    n %= per
                if n:
                    put(1, ((length, n),), capacity - n * length)
                break
            count, contents = rooms[free].pop()
            per = min(free // length, n)
            used = min(count, n // per)
            put(used, (*contents, (length, per)), free - per * length)
            put(count - used, contents, free)
            n -= used * per
    for free, entries in rooms.items():
        full.extend(entries)
    return [(count, list(contents)) for count, contents in full]


def make_plan(histogram: np.ndarray, capacity: int = CAPACITY) -> Plan:
    """``histogram[n]``: how many items of length n there are (1 to capacity)."""
    lengths = np.flatnonzero(histogram)
    lengths = lengths[lengths > 0]
    patterns = exact_patterns(lengths, capacity)
    repeats = round_repeats(patterns, fit_repeats(patterns, histogram.astype(float)), histogram)
    left = histogram.copy()
    groups: list[tuple[int, list[tuple[int, int]]]] = []
    for pattern, count in zip(patterns[repeats > 0], repeats[repeats > 0]):
        parts, times = np.unique(pattern[pattern > 0], return_counts=True)
        left[parts] -= count * times
        groups.append((int(count), list(zip(parts[::-1].tolist(), times[::-1].tolist()))))
    groups += pack_histogram(left, capacity)
    used = np.zeros(capacity + 1, dtype=np.int64)
    rows, base = [], 0
    for count, contents in groups:
        offset = 0
        for length, per in contents:
            rows.append((length, used[length], base, per, offset))
            used[length] += count * per
            offset += length * per
        base += count
    table = np.array(sorted(rows), dtype=np.int64).reshape(-1, 5)
    return Plan(*table.T, containers=base)


def _place_batches(batches: Iterator[pa.RecordBatch], plan: Plan, capacity: int) -> Iterator[pa.RecordBatch]:
    step = int(plan.first.max(initial=0)) + 1
    keys = plan.length * step + plan.first
    for batch in batches:
        cols = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
        length, number = cols["length"].to_numpy().astype(np.int64), cols["number"].to_numpy()
        slot = np.searchsorted(keys, length * step + np.minimum(number, step - 1), side="right") - 1
        nth = number - plan.first[slot]
        container = plan.base[slot] + nth // plan.per[slot]
        offset = plan.offset[slot] + nth % plan.per[slot] * length
        yield pa.RecordBatch.from_arrays(
            [pa.array(container), cols["key"], cols["part"], cols["start"], cols["length"], pa.array(offset, pa.int32())],
            ["container", "key", "part", "start", "length", "offset"],
        )


def pack(sizes: DataFrame, key: str, size: str, capacity: int = CAPACITY) -> DataFrame:
    """``(container, key, part, start, length, offset)``: where every item, or part of an item, goes.

    Items larger than ``capacity`` are cut into parts: full ones, each alone in its container, and a rest; no other
    item is split.  ``start`` is the part's first unit in its item, ``offset`` its first unit in the container.  Items of
    size null, 0 or below take no room and give no row.  Equal items are told apart by row, so repeated keys are packed
    as often as they occur.  An empty table gives no row; other columns are ignored.
    """
    spark = sizes.sparkSession
    items = sizes.filter(F.col(size) > 0).select(F.col(key).alias("key"), F.col(size).cast("int").alias("size"))
    parts = items.select(
        "key", "size", F.explode(F.sequence(F.lit(0), F.floor((F.col("size") - 1) / capacity).cast("int"))).alias("part")
    )
    start = (F.col("part") * capacity).cast("int")
    pieces = parts.select(
        "key", "part", start.alias("start"), F.least(F.lit(capacity), F.col("size") - start).cast("int").alias("length")
    )
    deals = min(DEALS[1], max(DEALS[0], 2 * parallelism(spark)))
    # a length may hold a third of all items: each is dealt to parts, numbered there, and the parts' numbers shifted
    pieces = pieces.withColumn("deal", F.pmod(F.xxhash64("key", "part"), F.lit(deals)).cast("int"))
    pieces = materialize(pieces, "pack-pieces")
    counts = pieces.groupBy("length", "deal").agg(F.count(F.lit(1)).alias("n"))
    rows = counts.collect()  # at most capacity x deals rows
    if not rows:
        return spark.createDataFrame(
            [], f"container bigint, {key} {dict(sizes.dtypes)[key]}, part int, start int, length int, offset int"
        )
    dealt = np.zeros((capacity + 1, deals), dtype=np.int64)
    for r in rows:
        dealt[r["length"], r["deal"]] = r["n"]
    shift = np.cumsum(dealt, axis=1) - dealt
    plan = spark.sparkContext.broadcast((make_plan(dealt.sum(axis=1), capacity), shift))
    within = Window.partitionBy("length", "deal").orderBy("key", "part")
    numbered = pieces.withColumn("number", F.row_number().over(within).cast("bigint") - 1)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chosen, shifts = plan.value

        def shifted() -> Iterator[pa.RecordBatch]:
            for b in batches:
                at = b.schema.get_field_index("number")
                number = b.column(at).to_numpy() + shifts[
                    b.column(b.schema.get_field_index("length")).to_numpy(),
                    b.column(b.schema.get_field_index("deal")).to_numpy(),
                ]
                yield b.set_column(at, "number", pa.array(number))

        yield from _place_batches(shifted(), chosen, capacity)

    schema = f"container bigint, key {dict(items.dtypes)['key']}, part int, start int, length int, offset int"
    return numbered.mapInArrow(place, schema).withColumnRenamed("key", key)


def fill(packed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``(containers, used, capacity, unused_share)``: one row; nulls where nothing is packed."""
    total = packed.agg(
        (F.max("container") + 1).alias("containers"), F.sum(F.col("length").cast("bigint")).alias("used")
    )
    room = F.col("containers") * capacity
    return total.select("containers", "used", room.alias("capacity"), (1 - F.col("used") / room).alias("unused_share"))
