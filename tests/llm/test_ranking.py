import math
import random

import numpy as np
import pytest

from seekstone.llm import ranking
from seekstone.llm.ranking import best_of_each, rank_walk, walk_ranking


def brute(scores, damping=0.85, steps=400):
    """The walk's matrix, written out."""
    s = np.where(np.isnan(scores), -np.inf, scores)
    n, m = s.shape
    p = np.zeros((n, n))
    for k in range(m):
        for i in range(n):
            higher = s[:, k] > s[i, k]
            p[i, higher] += 1 / n / m
            p[i, i] += (1 - higher.sum() / n) / m
    x = np.full(n, 1 / n)
    for _ in range(steps):
        x = (1 - damping) / n + damping * x @ p
    return x * n


def test_walk_equals_matrix():
    rng = np.random.default_rng(1)
    lists = np.repeat([5, 2, 9], [7, 1, 12])
    scores = rng.integers(0, 6, (20, 2)).astype(float)
    scores[rng.random((20, 2)) < 0.2] = np.nan
    got = rank_walk(lists, scores)
    for one in (5, 2, 9):
        assert np.allclose(got[lists == one], brute(scores[lists == one]), atol=1e-7)
    assert len(rank_walk(np.zeros(0), np.zeros((0, 2)))) == 0


def rows(queries=4, items=30, seed=2):
    rng = random.Random(seed)
    out = []
    for q in range(queries):
        for i in range(items):
            out.append((q, f"i{i:03}", rng.choice([None, math.nan, rng.gauss(0, 1000 ** (q % 2)), 1.0]), rng.choice([None, rng.random(), 0.5]), "x", 0.1))
    return out


SCHEMA = "q bigint, i string, v double, x double, weight string, s0 double"


def by_item(df):
    return {(r["q"], r["i"]): r["weight"] for r in df.collect()}


def test_ranking_of_a_table(spark):
    data = rows()
    got = by_item(walk_ranking(spark.createDataFrame(data, SCHEMA).repartition(3), "q", "i", ["v", "x"]))
    for q in range(4):
        own = sorted(r for r in data if r[0] == q)
        scores = np.array([[np.nan if a is None else a for a in r[2:4]] for r in own], float)
        for r, w in zip(own, brute(scores)):
            assert abs(got[(q, r[1])] - w) < 1e-6


def test_huge_lists_as_tables_give_the_same(spark, monkeypatch):
    """The same steps, as tables and as arrays."""
    monkeypatch.setattr(ranking, "BIG_STEPS", 4)
    monkeypatch.setattr(ranking, "MAX_STEPS", 4)
    data = rows(2, 25)
    big = by_item(walk_ranking(spark.createDataFrame(data, SCHEMA), "q", "i", ["v", "x"], big_list=10))
    for q in range(2):
        own = [r for r in data if r[0] == q]
        scores = np.array([[np.nan if a is None else a for a in r[2:4]] for r in own], float)
        for r, w in zip(own, rank_walk(np.zeros(len(own)), scores, steps=4)):
            assert abs(big[(q, r[1])] - w) < 1e-6


def test_huge_lists_are_walked_until_they_settle(spark, monkeypatch):
    """They end at the same tolerance as shorter lists, not after a fixed number of steps."""
    monkeypatch.setattr(ranking, "BIG_STEPS", 2)
    monkeypatch.setattr(ranking, "TOLERANCE", 0.01)
    data = rows(1, 25)
    big = by_item(walk_ranking(spark.createDataFrame(data, SCHEMA), "q", "i", ["v", "x"], big_list=10))
    scores = np.array([[np.nan if a is None else a for a in r[2:4]] for r in data], float)
    settled, early = rank_walk(np.zeros(25), scores), rank_walk(np.zeros(25), scores, steps=2)
    assert np.abs(settled - early).max() > 0.01
    for r, w in zip(data, settled):
        assert abs(big[(0, r[1])] - w) < 1e-6


def test_no_range_dominates(spark):
    data = [(1, "both", 0.9, 0.9), (1, "big", 1e9, 0.1), (1, "other", 0.1, 0.95), (1, "low", 0.0, 0.2), (1, "mid", 0.2, 0.3), (1, "none", None, math.nan)]
    df = spark.createDataFrame(data, "q bigint, i string, v double, x double")
    ranked = walk_ranking(df, "q", "i", ["v", "x"])
    assert best_of_each(ranked, "q", "i").collect()[0]["i"] == "both"
    assert by_item(ranked)[(1, "none")] == min(by_item(ranked).values())


@pytest.mark.parametrize("scores", [[None, None], [0.5, 0.5]])
def test_ties_take_the_smaller_item(spark, scores):
    df = spark.createDataFrame([(1, "b", *scores), (1, "a", *scores), (None, "c", *scores), (2, None, *scores)], "q bigint, i string, v double, x double")
    ranked = walk_ranking(df, "q", "i", ["v", "x"])
    assert ranked.count() == 2 and [tuple(r) for r in best_of_each(ranked, "q", "i").collect()] == [(1, "a")]
    assert walk_ranking(df.limit(0), "q", "i", ["v", "x"]).count() == 0
