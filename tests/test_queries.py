"""Every query with SQL against DuckDB over the smallest tables; those of the optional subpackage come with it."""

import os

import duckdb
import pytest

import __spark_entry__ as entry

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in os.listdir(DATA):
        c.execute(f"create view {t[:-8]} as select * from '{DATA}/{t}'")
    return c


def plain(frame):
    columns = sorted(frame.columns)
    rows = frame[columns].astype(object)
    return columns, sorted(map(str, rows.where(rows.notna(), None).itertuples(index=False, name=None)))


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables here")
@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query_equals_sql(spark, duck, name):
    assert plain(entry.queries()[name](spark, DATA).toPandas()) == plain(duck.sql(entry.oracle_sql()[name]).df())


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables here")
def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_safety_findings_cover_whole_and_unlabelled_documents(spark, tmp_path):
    long = "the house is quiet and clean. " * 400
    docs = [(1, long + "i will hurt you"), (2, "i will hurt you"), (3, long)]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 1), (3, 0)], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = {(r.doc_id, r.toxic, r.category) for r in entry.queries()["safety_findings"](spark, str(tmp_path)).collect()}
    assert got == {(1, 1, "threat"), (2, None, "threat"), (3, 0, None)}
