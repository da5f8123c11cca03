"""Problem 6: how distinctive a word is for each record.

Positive pointwise mutual information of word and record, from joint and marginal counts, by group-bys and joins.
``tf`` counts a word in a record; its sums are the marginals: ``length`` over the words of a record, ``occurrences`` over the
records of a word, T over all.  The words are the contexts, whose counts are smoothed by a fractional exponent::

    ppmi = max(0, ln( (tf / T) / ( (length / T) * (occurrences ** exponent / sum over words of occurrences ** exponent) ) ))

The exponent is 0.5.  At the usual 0.75 a word seen once in two records still beats one that a few records repeat.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from seekstone.functions.text import word_counts
from seekstone.session import materialize

#: A word is hot if more than this share of all (record, word) pairs are its own; so there are at most 1,000.
HOT_SHARE = 0.001
#: Parts into which the rows of a hot word are dealt for the join.
SALTS = 32


def distinctive_terms(
    df: DataFrame,
    key: str,
    text: str,
    exponent: float = 0.5,
    min_records: int = 2,
    only: DataFrame | None = None,
    lowercase: bool = True,
) -> DataFrame:
    """``(key, term, tf, records, score)`` for every word of every row that at least ``min_records`` rows hold.

    ``key`` names rows uniquely.  Counts are taken over all rows; with ``only`` (a table with the column ``key``)
    just those rows are scored.  Null, empty and blank texts have no word and give no row; an empty table gives none.
    Scores are rounded to 9 digits; words with the same counts get the same.  Other columns are ignored, whatever their names.
    """
    narrow = df.select(F.col(key).alias("key"), F.col(text).alias("text"))

    def counted(rows: DataFrame) -> DataFrame:
        """``(key, length, term, tf)``; the length comes with the row, and nothing is shuffled."""
        return word_counts(rows, ["key"], "text", lowercase)

    counts = counted(narrow)
    # read several times below, so it is stored: the words are cut once
    totals = counts.groupBy("term").agg(F.count(F.lit(1)).alias("records"), F.sum("tf").alias("occurrences"))
    terms = materialize(totals, "terms")
    smoothed = F.pow(F.col("occurrences").cast("double"), F.lit(exponent))
    total = terms.agg(F.sum(smoothed).alias("mass"), F.sum("records").alias("pairs")).collect()[0]
    if not total["pairs"]:
        total = {"mass": 1.0, "pairs": 1}
    # at most 1 / HOT_SHARE rows, whatever the collection's size
    hot = [r["term"] for r in terms.filter(F.col("records") > HOT_SHARE * total["pairs"]).select("term").collect()]
    salt_of = F.when(F.col("term").isin(hot), F.pmod(F.xxhash64("key"), F.lit(SALTS))).otherwise(F.lit(0))
    salts_of = F.when(F.col("term").isin(hot), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    if only is not None:
        counts = counted(narrow.join(only.select(F.col(key).alias("key")).distinct(), "key", "left_semi"))
    stats = terms.filter(F.col("records") >= min_records).withColumn("salt", F.explode(salts_of.cast("array<bigint>")))
    ratio = F.col("tf") / F.col("length") / (smoothed / F.lit(float(total["mass"])))
    return (
        counts.withColumn("salt", salt_of.cast("bigint"))
        .join(stats, ["term", "salt"])
        .select(F.col("key").alias(key), "term", "tf", "records", F.round(F.greatest(F.lit(0.0), F.log(ratio)), 9).alias("score"))
    )


def most_distinctive(scores: DataFrame, key: str) -> DataFrame:
    """``(key, term)``: of each row the word with the highest score; of equal ones the first by code point."""
    # the least struct has the highest score, then the first word; combined before the shuffle
    best = F.min(F.struct((-F.col("score")).alias("s"), F.col("term").alias("t")))
    return scores.groupBy(key).agg(best.alias("best")).select(key, F.col("best.t").alias("term"))
