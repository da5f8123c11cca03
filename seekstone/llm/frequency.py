"""Problem 1: frequency of every distinct word over a whole collection.

Recursive radix partitioning.  Words are cut in the JVM; each task counts its records' words with DuckDB, batch
by batch, so a word leaves a task once per batch however often it occurs.  The partial counts are shuffled by the
leading bits of the word's hash.  A partition that is still too large for memory is written to the shared
folder by the next bits of the hash, and so on, until each part can be aggregated; DuckDB streams the parts.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from seekstone.functions.text import words
from seekstone.session import parallelism, shared_dir

#: Bits of the hash by which an oversized partition is split again.
SPLIT_BITS = 4
#: Partial rows that a task aggregates at once; more are split to disk.
LEAF_ROWS = 4_000_000
#: Records whose words are counted at once.
BATCH_WORDS = 2_000_000

#: Memory of DuckDB in a task: a leaf and its totals.
MEMORY = "1GB"

_PARTIAL = pa.schema([("radix", pa.int32()), ("term", pa.string()), ("n", pa.int64()), ("r", pa.int64())])
_COUNTED = pa.schema([("term", pa.string()), ("occurrences", pa.int64()), ("records", pa.int64())])


def _duckdb():
    """In memory, and only so much of it: the radix partitions are what goes to disk, and that in the shared folder."""
    import duckdb

    con = duckdb.connect()
    con.execute(f"SET threads = 1; SET memory_limit = '{MEMORY}'; SET temp_directory = ''")
    return con


def _shared(folder: str):
    """``(file system, path)`` of a folder as Spark names it."""
    from pyarrow import fs

    scheme, found, rest = folder.partition("://")
    if not found:
        return fs.LocalFileSystem(), folder.removeprefix("file:")
    return fs.FileSystem.from_uri(("s3" if scheme in ("s3a", "s3n") else scheme) + "://" + rest)


def _count_batches(batches: Iterator[pa.RecordBatch], radixes: int) -> Iterator[pa.RecordBatch]:
    con = _duckdb()

    def counted(held: list[pa.Array]) -> Iterator[pa.RecordBatch]:
        lists = pa.chunked_array(held).combine_chunks()
        flat = pa.table({"rec": pc.list_parent_indices(lists), "term": lists.flatten()})
        con.register("flat", flat)
        partial = _fetch(
            con,
            f"""SELECT (hash(term) % {radixes})::INT AS radix, term, sum(tf)::BIGINT AS n, count(*)::BIGINT AS r
            FROM (SELECT rec, term, count(*) AS tf FROM flat GROUP BY rec, term) GROUP BY term""",
        )
        con.unregister("flat")
        yield from partial.cast(_PARTIAL).to_batches(max_chunksize=100_000)

    held, size = [], 0
    for batch in batches:
        held.append(batch.column(0))
        size += len(batch.column(0).flatten())
        if size >= BATCH_WORDS:
            yield from counted(held)
            held, size = [], 0
    if held:
        yield from counted(held)


def _fetch(con, sql: str) -> pa.Table:
    return con.sql(sql).to_arrow_table()


def _aggregate(con, parts: list[pa.Table]) -> pa.Table:
    con.register("part", pa.concat_tables(parts))
    out = _fetch(con, "SELECT term, sum(n)::BIGINT AS occurrences, sum(r)::BIGINT AS records FROM part GROUP BY term")
    con.unregister("part")
    return out.cast(_COUNTED)


def _radix(
    tables: Iterator[pa.Table], folder: str, leaf_rows: int, level: int = 0
) -> Iterator[pa.Table]:
    """Totals of the partial counts in ``tables``; what exceeds ``leaf_rows`` goes to disk by further hash bits."""
    from pyarrow import ipc

    con = _duckdb()
    held, rows, spilled, sink = [], 0, {}, None

    def spill() -> None:
        nonlocal sink, held, rows
        if sink is None:
            sink = _shared(folder)
        files, base = sink
        whole = _aggregate(con, held).rename_columns(["term", "n", "r"])  # the same word again costs no more space
        con.register("whole", whole)
        # the leading bits chose the partition; each level takes the next ones from the other end
        shift = SPLIT_BITS * (level + 1)
        for part in range(1 << SPLIT_BITS):
            cut = _fetch(
                con, f"SELECT * FROM whole WHERE ((hash(term) >> {64 - shift}) & {(1 << SPLIT_BITS) - 1}) = {part}"
            )
            if not len(cut):
                continue
            where = f"{base}/{level}-{part}"
            files.create_dir(where, recursive=True)
            name = f"{where}/{uuid.uuid4().hex}.arrow"
            with files.open_output_stream(name) as out, ipc.new_stream(out, cut.schema) as writer:
                writer.write_table(cut)
            spilled.setdefault(part, []).append((name, len(cut)))
        con.unregister("whole")
        held, rows = [], 0

    for table in tables:
        held.append(table)
        rows += len(table)
        if rows > leaf_rows:
            spill()
    if not spilled:
        if held:
            yield _aggregate(con, held)
        return
    if held:
        spill()
    files, base = sink

    def read(names: list[tuple[str, int]]) -> Iterator[pa.Table]:
        for name, _ in names:
            with files.open_input_stream(name) as source:
                for batch in ipc.open_stream(source):
                    yield pa.Table.from_batches([batch])
            files.delete_file(name)

    deepest = (level + 2) * SPLIT_BITS > 48
    for part, names in sorted(spilled.items()):
        # a part made of one piece is smaller than a leaf already; at the deepest level equal words remain
        limit = sum(n for _, n in names) if deepest else leaf_rows
        yield from _radix(read(names), f"{folder}/{level}-{part}", limit, level + 1)


def _total_batches(batches: Iterator[pa.RecordBatch], folder: str, leaf_rows: int) -> Iterator[pa.RecordBatch]:
    own, rows = f"{folder}/radix-{uuid.uuid4().hex}", 0

    def tables() -> Iterator[pa.Table]:
        nonlocal rows
        for b in batches:
            rows += len(b)
            yield pa.Table.from_batches([b]).select(["term", "n", "r"])

    try:
        for table in _radix(tables(), own, leaf_rows):
            yield from table.to_batches(max_chunksize=100_000)
    finally:
        if rows > leaf_rows:  # else nothing went to disk
            files, base = _shared(own)
            files.delete_dir(base)


def term_frequencies(
    df: DataFrame,
    text: str,
    rare_below: int = 3,
    common_above: float = 0.4,
    lowercase: bool = True,
    leaf_rows: int = LEAF_ROWS,
) -> DataFrame:
    """``(term, occurrences, records, mark)``: every word of column ``text``, how often it occurs, in how many rows.

    ``mark`` is ``rare`` for words in fewer than ``rare_below`` rows, ``common`` for words in more than the share
    ``common_above`` of all rows (a word that is both is rare), else null.  Rows are records: pass each record once.
    Null, empty and blank texts hold no word but count as rows.  An empty table gives no row.  Other columns are
    ignored, whatever their names.
    """
    spark = df.sparkSession
    parts = parallelism(spark)
    radixes, folder = parts * 16, shared_dir(spark)
    tokens = df.select(words(F.col(text), lowercase).alias("w"))
    partial = tokens.mapInArrow(
        lambda batches: _count_batches(batches, radixes), "radix int, term string, n bigint, r bigint"
    )
    totals = partial.repartition(parts, "radix").mapInArrow(
        lambda batches: _total_batches(batches, folder, leaf_rows), "term string, occurrences bigint, records bigint"
    )
    rows = df.agg(F.count(F.lit(1)).alias("rows"))
    mark = F.when(F.col("records") < rare_below, "rare").when(F.col("records") > common_above * F.col("rows"), "common")
    return totals.crossJoin(F.broadcast(rows)).select("term", "occurrences", "records", mark.alias("mark"))
