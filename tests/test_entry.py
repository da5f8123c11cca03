"""Every core query against its SQL on the smallest tables."""

import os
import pathlib

import pytest

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the test tables")


def rows(frame):
    columns = sorted(frame.columns)
    return sorted(repr([None if v != v else v for v in r]) for r in frame[columns].astype(object).where(frame[columns].notna(), None).values.tolist())


def names():
    from seekstone.plans import queries

    return sorted(queries.QUERIES)


@pytest.mark.parametrize("name", names())
def test_query_equals_sql(spark, name):
    import duckdb

    from seekstone.plans import queries

    got = queries.QUERIES[name](spark, DATA).toPandas()
    if name not in queries.ORACLE:
        assert len(got)
        return
    con = duckdb.connect()
    for p in pathlib.Path(DATA).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    want = con.execute(queries.ORACLE[name]).df()
    assert sorted(got.columns) == sorted(want.columns) and rows(got) == rows(want)


def test_every_number_of_a_unit_vector(spark):
    import pyarrow.parquet as pq

    from seekstone.plans import queries

    lengths = {r["vec_id"]: len(r["embedding"]) for r in pq.read_table(f"{DATA}/embeddings.parquet").to_pylist()}
    got = queries.QUERIES["l2_normalized"](spark, DATA).toPandas()
    assert got.groupby("vec_id")["place"].agg(lambda p: sorted(p) == list(range(len(p))) and len(p)).to_dict() == lengths


def test_searches_of_the_tables(spark):
    """Every row of queries and every hundredth vector is searched for, not a few that are written into the code."""
    import pyarrow.parquet as pq

    from seekstone.plans import queries

    asked = {r["query_id"]: r for r in pq.read_table(f"{DATA}/queries.parquet").to_pylist()}
    got = queries.QUERIES["bm25_queries"](spark, DATA).toPandas().groupby("query_id").size()
    assert set(got.index) <= set(asked) and len(got) > 4 and all(n <= asked[q]["top_k"] for q, n in got.items())
    hundredth = {v for v in pq.read_table(f"{DATA}/embeddings.parquet")["vec_id"].to_pylist() if v % 100 == 0}
    for metric in ("cosine", "inner_product", "l2"):
        got = queries.QUERIES[f"knn_queries_{metric}"](spark, DATA).toPandas()
        assert got.groupby("query_id").size().to_dict() == dict.fromkeys(hundredth, 10)
    got = queries.QUERIES["ann_recall"](spark, DATA).toPandas().set_index("metric")
    assert set(got.index) == {"cosine", "inner_product", "l2"} and (got["recall"] >= 0.9).all() and (got["first"] >= 0.99).all()


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).columns[0] == "query_id" and set(entry.oracle_sql()) <= set(entry.queries())
