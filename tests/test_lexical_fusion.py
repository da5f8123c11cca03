import math
import random
import re

import pytest

from seekstone.errors import LexicalError
from seekstone.operators import fusion
from seekstone.operators.lexical import bm25, build_index, check_new, document_frequencies, remove
from seekstone.schema import LexicalParams

MINI = {"d1": "the cat sat on the mat", "d2": "the dog chased the cat", "d3": "a dog on a mat"}


def index(spark, docs, params=LexicalParams()):
    rows = [(i, t, n) for n, (i, t) in enumerate(docs.items())]
    return build_index(spark.createDataFrame(rows, "chunk_id string, content string, seq bigint"), params)


def search(spark, docs, query, k=10, params=LexicalParams(), held=None):
    queries = spark.createDataFrame([(1, query)], "query_id bigint, query string")
    rows = bm25(queries, *(held or index(spark, docs, params)), params, k).orderBy("rank").collect()
    return [(r["chunk_id"], r["score"]) for r in rows]


def brute(docs, query, params):
    cut = {i: [w.casefold() for w in re.findall(r"\w+", t or "")] for i, t in docs.items()}
    avg = sum(map(len, cut.values())) / len(cut)
    scores = {}
    for term in {w.casefold() for w in re.findall(r"\w+", query)}:
        n = sum(term in c for c in cut.values())
        idf = math.log((len(cut) - n + 0.5) / (n + 0.5) + 1)
        for i, c in cut.items():
            tf = c.count(term)
            if tf:
                scores[i] = scores.get(i, 0) + idf * tf * (params.k1 + 1) / (tf + params.k1 * (1 - params.b + params.b * len(c) / avg))
    place = {i: n for n, i in enumerate(docs)}
    return sorted(scores.items(), key=lambda x: (-round(x[1], 9), place[x[0]]))


def test_bm25_against_brute_force(spark):
    rng = random.Random(11)
    pool = "alpha beta gamma delta eps zeta eta theta".split()
    docs = {f"r{n}": " ".join(rng.choices(pool, k=rng.randint(4, 12))) for n in range(6)} | {"empty": "", "null": None}
    for k1, b in ((1.5, 0.75), (0.0, 0.3), (0.5, 1.0)):
        params = LexicalParams(k1, b)
        for query in ("alpha beta", "alpha alpha zeta", "unknown"):
            got, want = search(spark, docs, query, 10, params), brute(docs, query, params)
            assert [i for i, _ in got] == [i for i, _ in want]
            assert all(abs(x - y) < 1e-9 for (_, x), (_, y) in zip(got, want))


def test_order_ties_repeats_and_limits(spark):
    assert [i for i, _ in search(spark, MINI, "cat sat mat")] == [i for i, _ in brute(MINI, "cat sat mat", LexicalParams())]
    same = {"z": "cat", "a": "cat", "m": "cat"}
    assert [i for i, _ in search(spark, same, "cat")] == ["z", "a", "m"]  # as indexed
    assert search(spark, MINI, "cat") == search(spark, MINI, "cat CAT cat")
    assert len(search(spark, MINI, "the dog", k=1)) == 1
    assert search(spark, MINI, "nothing") == [] and search(spark, {"x": ""}, "cat") == []


def test_stopwords_case_and_fold(spark):
    params = LexicalParams(stopwords=("The", "ON"))
    assert search(spark, MINI, "the on", params=params) == []
    assert search(spark, {"a": "STRASSE"}, "straße")
    assert search(spark, {"a": "Cat"}, "cat", params=LexicalParams(lowercase=False)) == []


def test_remove_equals_never_indexed(spark):
    gone = spark.createDataFrame([("d2",), ("unknown",)], "chunk_id string")
    held = tuple(remove(t, gone) for t in index(spark, MINI))
    assert search(spark, MINI, "cat mat", held=held) == search(spark, {k: v for k, v in MINI.items() if k != "d2"}, "cat mat")


def test_document_frequencies(spark):
    rows = {r["term"]: r for r in document_frequencies(*index(spark, MINI)).collect()}
    assert rows["cat"]["df"] == 2 and abs(rows["cat"]["idf"] - math.log(1.5 / 2.5 + 1)) < 1e-12


@pytest.mark.parametrize("k1,b", [(-0.1, 0.5), (1.0, -0.1), (1.0, 1.1)])
def test_wrong_parameters(k1, b):
    with pytest.raises(LexicalError):
        LexicalParams(k1, b)


def test_check_new():
    check_new(["a"], ["x"])
    for ids, texts in ((["a"], []), (["a", "a"], ["x", "y"])):
        with pytest.raises(LexicalError):
            check_new(ids, texts)


def ranking(spark, *items):
    return spark.createDataFrame([(1, i, float(s), n) for n, (i, s) in enumerate(items, 1)], "query_id bigint, chunk_id string, score double, rank int")


def as_list(df):
    return [(r["chunk_id"], round(r["score"], 9)) for r in df.orderBy("rank").collect()]


def test_rrf_and_weights(spark):
    v, x = ranking(spark, ("a", 0.9), ("b", 0.5)), ranking(spark, ("b", 3), ("c", 1))
    assert as_list(fusion.fuse([v, x])) == [(i, round(s, 9)) for i, s in (("b", 1 / 61 + 1 / 62), ("a", 1 / 61), ("c", 1 / 62))]
    assert [i for i, _ in as_list(fusion.fuse([v, x], weights=[1, 2]))] == ["b", "c", "a"]
    with pytest.raises(ValueError):
        fusion.rrf([v], k=0)


def test_linear_and_ties(spark):
    v = ranking(spark, ("a", 0.9), ("b", 0.5), ("c", 0.1))
    x = ranking(spark, ("a", 5), ("c", 4), ("b", 1))
    assert as_list(fusion.fuse([v, x], "linear", 0.5)) == [("a", 1.0), ("c", 0.375), ("b", 0.25)]
    tied = fusion.fuse([ranking(spark, ("x", 2), ("z", 1)), ranking(spark, ("w", 2), ("y", 1))])
    assert [i for i, _ in as_list(tied)] == ["w", "x", "y", "z"]
    for bad in (-0.1, 1.1):
        with pytest.raises(ValueError):
            fusion.fuse([v, x], "linear", bad)
    with pytest.raises(ValueError):
        fusion.linear([v, x], [1.0])


def test_normalizers(spark):
    get = lambda df: {r["chunk_id"]: round(r["score"], 6) for r in df.collect()}
    assert get(fusion.minmax(ranking(spark, ("a", 2), ("b", 4)))) == {"a": 0.0, "b": 1.0}
    same = ranking(spark, ("a", 2), ("b", 2))
    assert get(fusion.minmax(same)) == {"a": 1.0, "b": 1.0} and get(fusion.zscore(same)) == {"a": 0.0, "b": 0.0}
    assert get(fusion.zscore(ranking(spark, ("a", 1), ("b", 2), ("c", 3))))["c"] == 1.224745


@pytest.mark.parametrize("tile", [7, 4_000_000])
def test_many_searches_equal_single_ones(spark, monkeypatch, tile):
    """The way by chunks: ties, limits of each search, words that nobody has, and several rounds of searches."""
    from seekstone.operators import lexical

    rng = random.Random(2)
    pool = [f"w{n}" for n in range(12)]
    docs = {f"r{n:02}": " ".join(rng.choices(pool, k=rng.randint(0, 9))) for n in range(60)} | {"null": None}
    held = index(spark, docs)
    asked = [(n, " ".join(rng.choices(pool + ["unknown"], k=rng.randint(0, 5))), rng.choice([0, 1, 3, 100, None])) for n in range(40)]
    queries = spark.createDataFrame(asked, "query_id bigint, query string, k int")
    monkeypatch.setattr(lexical, "FEW_TERMS", 0)
    monkeypatch.setattr(lexical, "TILE", tile)
    monkeypatch.setattr(lexical, "BLOCK_TERMS", 60)
    got = {}
    for r in bm25(queries, *held, LexicalParams(), "k").orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["chunk_id"], round(r["score"], 9)))
    for n, text, k in asked:
        want = [(i, round(s, 9)) for i, s in brute(docs, text, LexicalParams())[: k or 0]]
        assert got.get(n, []) == want


def test_word_counts_stay_in_their_row(spark):
    from seekstone.functions.text import word_counts

    df = spark.createDataFrame([(1, "a b A", "x"), (1, "a", "y"), (2, None, "z"), (3, "", "z")], "id int, t string, term string")
    rows = sorted(tuple(r) for r in word_counts(df.select("id", "t"), ["id"], "t").collect())
    assert rows == [(1, 1, "a", 1), (1, 3, "a", 2), (1, 3, "b", 1)]
    assert "Exchange" not in word_counts(df.select("id", "t"), ["id"], "t")._jdf.queryExecution().executedPlan().toString()
