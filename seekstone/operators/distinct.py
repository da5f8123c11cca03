"""One row per key, for tables in which deliveries repeat."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def first_rows(df: DataFrame, key: str) -> DataFrame:
    """One row per ``key``; rows with a null key are dropped.

    Repeated rows are equal in all columns that are read (only delivery times differ), so any of them will do.
    Select the needed columns first: they are shuffled by ``key`` once, which later groupings by ``key`` reuse.
    No key is hot: each repeats a few times only, and Spark drops repetitions before the shuffle too.
    """
    return df.filter(F.col(key).isNotNull()).dropDuplicates([key])
