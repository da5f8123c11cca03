import collections
import math
import re

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from seekstone.llm.distinctive import distinctive_terms, most_distinctive
from seekstone.llm.frequency import _radix, term_frequencies

RECORDS = [
    ("a", "the cat THE Straße"),
    ("b", "the dog strasse"),
    ("c", None),
    ("d", "  "),
    ("e", "the cat the cat rare_1"),
    ("f", "x" * 3000 + " the"),
]


@pytest.fixture(scope="module")
def df(spark):
    # extra columns whose names clash with those used inside
    return spark.createDataFrame([(i, t, 1, "z", 0) for i, t in RECORDS], "id string, text string, n int, term string, radix int").repartition(3)


def counted(rows):
    occurrences, records = collections.Counter(), collections.Counter()
    for _, t in rows:
        w = [x.casefold() for x in re.findall(r"\w+", t or "")]
        occurrences.update(w)
        records.update(set(w))
    return occurrences, records


def test_frequencies_and_marks(df):
    occurrences, records = counted(RECORDS)
    got = {r["term"]: r for r in term_frequencies(df, "text", rare_below=2, common_above=0.5).collect()}
    assert {t: (r["occurrences"], r["records"]) for t, r in got.items()} == {t: (occurrences[t], records[t]) for t in occurrences}
    assert got["the"]["mark"] == "common" and got["dog"]["mark"] == "rare" and got["cat"]["mark"] is None
    assert got["strasse"]["records"] == 2


def test_frequencies_of_nothing(spark, df):
    empty = df.limit(0)
    assert term_frequencies(empty, "text").count() == 0
    assert term_frequencies(df.filter("id IN ('c', 'd')"), "text").count() == 0


def test_radix_spills_and_splits(tmp_path):
    terms = [f"w{n % 500}" for n in range(6000)] + ["hot"] * 4000
    tables = (pa.table({"term": terms[k : k + 700], "n": [2] * len(terms[k : k + 700]), "r": [1] * len(terms[k : k + 700])}) for k in range(0, len(terms), 700))
    out = pa.concat_tables(_radix(tables, str(tmp_path / "spill"), leaf_rows=60))
    got = {r["term"]: (r["occurrences"], r["records"]) for r in out.to_pylist()}
    want = collections.Counter(terms)
    assert len(out) == len(want) and got == {t: (2 * n, n) for t, n in want.items()}


def test_spilling_in_a_query(df):
    occurrences, _ = counted(RECORDS)
    got = {r["term"]: r["occurrences"] for r in term_frequencies(df, "text", leaf_rows=1).collect()}
    assert got == dict(occurrences)


def test_shared_folders_by_any_name(tmp_path):
    from seekstone.llm.frequency import _shared

    for name in (str(tmp_path), f"file:{tmp_path}", f"file://{tmp_path}"):
        files, path = _shared(name)
        assert path == str(tmp_path) and files.get_file_info(path).is_file is False


def brute_ppmi(rows, exponent=0.5, least=2):
    """ln of p(word, record) / (p(record) * smoothed p(word)), all from the one table of counts."""
    cut = {i: collections.Counter(x.casefold() for x in re.findall(r"\w+", t or "")) for i, t in rows}
    records = collections.Counter(w for c in cut.values() for w in c)
    occurrences = sum(cut.values(), collections.Counter())
    mass = sum(n**exponent for n in occurrences.values())
    total = sum(occurrences.values())
    return {
        (i, w): max(0.0, math.log((tf / total) / (sum(c.values()) / total * occurrences[w] ** exponent / mass)))
        for i, c in cut.items()
        for w, tf in c.items()
        if records[w] >= least
    }


def test_distinctive_equals_brute_force(spark, df):
    want = brute_ppmi(RECORDS)
    got = {(r["id"], r["term"]): r["score"] for r in distinctive_terms(df, "id", "text").collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-8 for k in want)
    only = spark.createDataFrame([("e",), ("e",), ("unknown",)], "id string")
    some = {(r["id"], r["term"]): r["score"] for r in distinctive_terms(df, "id", "text", only=only).collect()}
    assert some == {k: v for k, v in got.items() if k[0] == "e"}


def test_most_distinctive_ties_and_nothing(spark, df):
    rows = [("a", "y x"), ("b", "x y"), ("c", "")]
    two = spark.createDataFrame(rows, "id string, text string")
    best = most_distinctive(distinctive_terms(two, "id", "text"), "id")
    assert sorted(map(tuple, best.collect())) == [("a", "x"), ("b", "x")]
    assert distinctive_terms(df.limit(0), "id", "text").count() == 0


def test_hot_words_are_salted(spark):
    rows = [(f"r{n}", "hot " + ("warm" if n % 2 else "cold")) for n in range(300)]
    df = spark.createDataFrame(rows, "id string, text string")
    want = brute_ppmi(rows)
    got = {(r["id"], r["term"]): r["score"] for r in distinctive_terms(df, "id", "text").collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-8 for k in want)
    assert df.select(F.count("*")).head()[0] == 300
