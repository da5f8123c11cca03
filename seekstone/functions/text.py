"""Text functions as Spark expressions: strip, case folding, words.

Everything runs in the JVM.  Semantics follow Python's ``str``: lengths in code points, Unicode white space,
full case folding (``ß`` folds to ``ss``), words as maximal runs of letters, digits and underscores.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, functions as F

#: Letters, digits, underscores.  Java's own ``\\w`` differs from Python's.
WORD = r"[\p{L}\p{N}_]+"
#: White space as Python's ``str.strip`` sees it.
BLANK = r"(?U)[\s\x1c-\x1f]"
NOT_BLANK = r"(?U)[^\s\x1c-\x1f]"

#: The English stop words of the lexical index, plus the forms with an apostrophe, which
#: never match a word but belong to the published list.
STOPWORDS: tuple[str, ...] = tuple(
    """a about above after again against all am an and any are aren't as at be because been before being below
    between both but by can cannot could couldn't did didn't do does doesn't doing don't down during each few for
    from further had hadn't has hasn't have haven't having he her here hers herself him himself his how i if in into
    is isn't it its itself just me more most mustn't my myself no nor not of off on once only or other our ours
    ourselves out over own s same shan't she should shouldn't so some such t than that the their theirs them
    themselves then there these they this those through to too under until up very was wasn't we were weren't what
    when where which while who whom why will with won't would wouldn't you your yours yourself yourselves""".split()
)


@cache
def _fold_tables() -> tuple[str, str, tuple[tuple[str, str], ...], str]:
    """Characters that lower-casing leaves alone but case folding changes, one to one and one to many; and all
    whose folding is longer than one character, ``ß`` apart."""
    single_from, single_to, many, longer = [], [], [], []
    for code in range(0x110000):
        c = chr(code)
        if 0xD800 <= code <= 0xDFFF:
            continue
        folded = c.casefold()
        if folded == c:
            continue
        if len(folded) > 1 and folded != "ss":
            longer.append(c)
        if c.lower() != c:
            continue
        if len(folded) == 1:
            single_from.append(c)
            single_to.append(folded)
        else:
            many.append((c, folded))
    return "".join(single_from), "".join(single_to), tuple(many), "".join(longer)


def _fold_simple(text: Column) -> Column:
    """Case folding of texts without a character that folds to several, ``ß`` apart."""
    before, after, _, _ = _fold_tables()
    low = F.replace(F.lower(text), F.lit("ß"), F.lit("ss"))
    return F.when(low.rlike(f"[{before}]"), F.translate(low, before, after)).otherwise(low)


def _fold_full(text: Column) -> Column:
    before, after, many, _ = _fold_tables()
    full = F.translate(F.lower(text), before, after)
    for c, t in many:
        full = F.replace(full, F.lit(c), F.lit(t))
    return full


def _is_ascii(text: Column) -> Column:
    return F.octet_length(text) == F.char_length(text)


def _folds_longer(text: Column) -> Column:
    return text.rlike(f"[{_fold_tables()[3]}]")


def fold(text: Column) -> Column:
    """Full case folding, equal to ``str.casefold`` for the assigned characters.

    Three ways, the cheap ones first: ASCII is lower-cased; most texts need ``ß`` and one-to-one exceptions;
    the chain of one-to-many replacements runs only over texts that hold such a character.
    """
    return (
        F.when(_is_ascii(text), F.lower(text)).when(_folds_longer(text), _fold_full(text)).otherwise(_fold_simple(text))
    )


def strip(text: Column) -> Column:
    """Remove Unicode white space at both ends (Spark's ``trim`` removes only spaces)."""
    return F.regexp_replace(text, r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+\z", "")


def is_blank(text: Column) -> Column:
    """True for null, empty and white space only."""
    return ~F.coalesce(text, F.lit("")).rlike(NOT_BLANK)


def words(text: Column, lowercase: bool = True, stopwords: list[str] | None = None) -> Column:
    """The words of a text in order, folded; null gives an empty array.

    Words are cut before they are folded, as folding can produce combining marks, which are no word characters.
    Where no character folds to several, both orders agree and the text is folded as a whole, which is cheaper.
    """
    whole = F.coalesce(text, F.lit(""))

    def cut(t: Column) -> Column:
        return F.regexp_extract_all(t, F.lit(WORD), F.lit(0))

    if lowercase:
        found = (
            F.when(_is_ascii(whole), cut(F.lower(whole)))
            .when(_folds_longer(whole), F.transform(cut(whole), _fold_full))
            .otherwise(cut(_fold_simple(whole)))
        )
    else:
        found = cut(whole)
    if stopwords:
        stop = F.array(*[F.lit(w) for w in sorted(set(stopwords))])
        found = F.filter(found, lambda w: ~F.array_contains(stop, w))
    return found


def word_counts(df, key: list[str], text: str, lowercase: bool = True, stopwords: list[str] | None = None):
    """``(*key, length, term, tf)``: how often every word occurs in every row, and how many words the row has.

    Rows without a word give none.  All words of a row are in one row, so they are counted there, batch by batch: nothing is
    shuffled, and the rows of a key stay together."""
    rows = df.select(*key, words(F.col(text), lowercase, stopwords).alias("_words"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(len(key))
            flat = pa.table({"row": pc.list_parent_indices(lists), "term": lists.flatten()})
            counted = flat.group_by(["row", "term"], use_threads=False).aggregate([([], "count_all")]).combine_chunks()
            for part in counted.to_batches(max_chunksize=100_000):
                row = part.column("row")
                yield pa.RecordBatch.from_arrays(
                    [
                        *[batch.column(k).take(row) for k in range(len(key))],
                        pc.list_value_length(lists).take(row).cast(pa.int32()),
                        part.column("term"),
                        part.column("count_all").cast(pa.int32()),
                    ],
                    [*key, "length", "term", "tf"],
                )

    kinds = dict(rows.dtypes)
    return rows.mapInArrow(run, ", ".join(f"`{k}` {kinds[k]}" for k in key) + ", length int, term string, tf int")
