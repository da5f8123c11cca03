"""Problem 5: one ranking from several differently scaled scores.

A random walk over the n items of a list: from an item pick one of the scores, jump to the items that are higher in
it, to each with the same chance 1 / n, else stay; and now and then (damping) jump to any item at all.  Where the
walk stays most is the best item.  Only the order within each score counts, so no range can dominate.  The chance
is the same from every item: were it 1 / (number of higher items), the walk would rush to the first of either score,
however low in the other.

One step needs no pairs of items: sorted by a score, what arrives at an item is the sum of the mass behind it.
Many lists are walked at once as flat arrays.  A list of more than ``BIG_LIST`` items is walked as a table, with
prefix sums over ranges of it, so that no task holds it whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from seekstone.session import materialize, parallelism

DAMPING = 0.85
TOLERANCE = 1e-10
MAX_STEPS = 200
#: Items of a list that one task may hold.
BIG_LIST = 1_000_000
#: Steps of lists walked as tables before the change of a step is looked at; the error falls by the damping each step.
BIG_STEPS = 100


def rank_walk(lists: np.ndarray, scores: np.ndarray, damping: float = DAMPING, steps: int = 0) -> np.ndarray:
    """Stationary weight of every item, times the size of its list (1: an average item).  ``lists``: the list of each
    item, equal ones adjacent; ``scores``: items x scores, NaN where missing.  Missing ones stand together below all
    others of that score."""
    n = len(lists)
    if not n:
        return np.zeros(0)
    first = np.r_[0, np.flatnonzero(lists[1:] != lists[:-1]) + 1]
    size = np.diff(np.r_[first, n])
    group = np.repeat(np.arange(len(first)), size)
    sizes = size[group].astype(float)
    walks = []
    for s in np.where(np.isnan(scores), -np.inf, scores).T:
        order = np.lexsort((-s, group))  # best first within each list
        sorted_s, sorted_g = s[order], group[order]
        start = np.flatnonzero(np.r_[True, (sorted_s[1:] != sorted_s[:-1]) | (sorted_g[1:] != sorted_g[:-1])])
        run = np.repeat(np.arange(len(start)), np.diff(np.r_[start, n]))  # equal scores
        stay = 1.0 - (start - first[sorted_g[start]])[run] / sizes[order]  # the start of a run: items above it
        walks.append((order, stay, np.r_[start[1:], n][run], (first + size)[sorted_g]))
    x = np.ones(n)
    for _ in range(steps or MAX_STEPS):
        arrived = np.zeros(n)
        for order, stay, behind, stop in walks:
            mass = x[order]
            total = np.r_[0.0, np.cumsum(mass)]
            arrived[order] += mass * stay + (total[stop] - total[behind]) / sizes[order]
        new_x = (1.0 - damping) + damping * arrived / len(walks)
        done = np.abs(new_x - x).max() < TOLERANCE
        x = new_x
        if done:
            break
    return x


def _walk_batches(batches: Iterator[pa.RecordBatch], n_scores: int) -> Iterator[pa.RecordBatch]:
    """Batches sorted by list; the last list of a batch waits for the next batch."""
    held: pa.Table | None = None

    def walked(t: pa.Table) -> pa.RecordBatch:
        names = t.column("l").to_numpy()
        scores = np.stack([t.column(f"s{i}").to_numpy() for i in range(n_scores)], axis=1)
        x = rank_walk(names, scores.astype(float))
        return pa.RecordBatch.from_arrays(
            [t.column("q").combine_chunks(), t.column("i").combine_chunks(), pa.array(x)], ["q", "i", "weight"]
        )

    for batch in batches:
        table = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
        names = table.column("l").to_numpy()
        changes = np.flatnonzero(names[1:] != names[:-1])
        if not len(changes) or len(names) < 20_000:
            held = table
            continue
        cut = int(changes[-1]) + 1
        yield walked(table.slice(0, cut).combine_chunks())
        held = table.slice(cut)
    if held is not None and len(held):
        yield walked(held.combine_chunks())


def _below(runs: DataFrame, value: str) -> DataFrame:
    """``(l, s, below)``: the sum of ``value`` over all runs of the list with a lower score than ``s``.

    No task sees a whole list: sums within a range of it (column ``range``, rising with the score) plus the totals
    of the lower ranges, of which a list has at most as many as the session has shuffle partitions."""
    within = Window.partitionBy("l", "range").orderBy("s").rowsBetween(Window.unboundedPreceding, -1)
    before = Window.partitionBy("l").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    totals = runs.groupBy("l", "range").agg(F.sum(value).alias("t"))
    totals = totals.select("l", "range", F.coalesce(F.sum("t").over(before), F.lit(0.0)).alias("lower"))
    return (
        runs.withColumn("in", F.coalesce(F.sum(value).over(within), F.lit(0.0)))
        .join(totals, ["l", "range"])
        .select("l", "s", (F.col("in") + F.col("lower")).alias("below"))
    )


def _walk_big(rows: DataFrame, n_scores: int, damping: float, ranges: int) -> DataFrame:
    """The same walk over few but huge lists, as tables.  Columns l, q, i, s0, s1, ..."""
    sizes = rows.groupBy("l").agg(F.count(F.lit(1)).cast("double").alias("size"))
    base = rows.join(sizes, "l").withColumn("id", F.monotonically_increasing_id())
    for k in range(n_scores):
        base = base.withColumn(f"s{k}", F.when(F.isnan(f"s{k}"), float("-inf")).otherwise(F.col(f"s{k}")))
    base = materialize(base, "walk")
    sides = []
    for k in range(n_scores):
        points = [j / ranges for j in range(1, ranges)]
        cuts = base.groupBy("l").agg(F.percentile_approx(f"s{k}", points, 100 * ranges).alias("cuts"))
        runs = base.groupBy("l", F.col(f"s{k}").alias("s")).agg(F.count(F.lit(1)).cast("double").alias("n"))
        runs = runs.join(cuts, "l")
        runs = runs.withColumn("range", F.size(F.filter("cuts", lambda c: c < F.col("s")))).drop("cuts")
        sides.append(materialize(runs.join(_below(runs, "n"), ["l", "s"]).withColumnRenamed("below", "worse"), "runs"))
    x = base.select("l", "id", F.lit(1.0).alias("x"))
    for step in range(1, MAX_STEPS + 1):
        arrived = None
        for k, runs in enumerate(sides):
            mine = base.select("l", "id", "size", F.col(f"s{k}").alias("s")).join(x, ["l", "id"]).join(runs, ["l", "s"])
            per_run = mine.groupBy("l", "s", "range").agg(F.sum("x").alias("m"))
            better = F.col("size") - F.col("worse") - F.col("n")
            part = mine.join(_below(per_run, "m"), ["l", "s"]).select(
                "l", "id", "x", (F.col("x") * (1 - better / F.col("size")) + F.col("below") / F.col("size")).alias("a")
            )
            arrived = part if arrived is None else arrived.unionByName(part)
        new = (F.sum("a") * (damping / n_scores) + (1.0 - damping)).alias("x")
        moved = arrived.groupBy("l", "id").agg(new, F.first("x").alias("old"))
        moved = materialize(moved, "walk-step")  # it is read several times by the next step: plans would double
        x = moved.select("l", "id", "x")
        # the same end as that of shorter lists
        if step >= BIG_STEPS and moved.agg(F.max(F.abs(F.col("x") - F.col("old")))).first()[0] < TOLERANCE:
            break
    return base.join(x, ["l", "id"]).select("q", "i", F.col("x").alias("weight"))


def walk_ranking(
    df: DataFrame,
    query: str,
    item: str,
    scores: list[str],
    damping: float = DAMPING,
    big_list: int = BIG_LIST,
) -> DataFrame:
    """``(query, item, weight)``: the items of each query with the weight that orders them; higher is better and
    1 is an average item.

    Rows are (query, item) pairs, each once.  A null or NaN score stands below all present ones; a row without any
    score still takes part.  Rows without a query or item are dropped.  Weights are rounded to 9
    digits, so items alike in all scores tie; :func:`best_of_each` then takes the smaller item.  An empty table gives no row; other columns are ignored.
    """
    spark = df.sparkSession
    rows = df.filter(F.col(query).isNotNull() & F.col(item).isNotNull()).select(
        F.xxhash64(query).alias("l"),
        F.col(query).alias("q"),
        F.col(item).alias("i"),
        *[F.coalesce(F.col(s).cast("double"), F.lit(float("nan"))).alias(f"s{k}") for k, s in enumerate(scores)],
    )
    types = dict(rows.dtypes)
    schema = f"q {types['q']}, i {types['i']}, weight double"
    # lists over the bound: fewer than rows / big_list of them; small tables are broadcast by their size
    huge = materialize(rows.groupBy("l").count().filter(F.col("count") > big_list).select("l"), "huge")
    several = not huge.isEmpty()
    n_scores = len(scores)
    weights = (
        (rows.join(huge, "l", "left_anti") if several else rows)
        .repartition(parallelism(spark), "l")
        .sortWithinPartitions("l")
        .mapInArrow(lambda batches: _walk_batches(batches, n_scores), schema)
    )
    if several:
        big = _walk_big(rows.join(huge, "l", "left_semi"), n_scores, damping, parallelism(spark))
        weights = weights.unionByName(big)
    return weights.select(F.col("q").alias(query), F.col("i").alias(item), F.round("weight", 9).alias("weight"))


def best_of_each(weights: DataFrame, query: str, item: str) -> DataFrame:
    """``(query, item)``: the first item of each query; of equal weights the smaller item.  Combined before the shuffle."""
    best = F.min(F.struct((-F.col("weight")).alias("w"), F.col(item).alias("i")))
    return weights.groupBy(query).agg(best.alias("best")).select(query, F.col("best.i").alias(item))
