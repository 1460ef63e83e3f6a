"""Every query with SQL of its own against DuckDB on the smallest tables."""

import os

import duckdb
import pytest

from tessera.plans.catalogue import ORACLE, QUERIES

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.sql("SET timezone = 'UTC'")
    for name in os.listdir(SF):
        con.sql(f"CREATE VIEW {name[:-8]} AS FROM '{SF}/{name}'")
    return con


def _value(v):
    return "NULL" if v is None or v != v else f"{v:.6f}" if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted(tuple(_value(r[c]) for c in columns) for r in df.collect())
    rel = duck.sql(ORACLE[name])
    assert sorted(rel.columns) == columns
    at = [rel.columns.index(c) for c in columns]
    assert got == sorted(tuple(_value(r[i]) for i in at) for r in rel.fetchall())


@pytest.mark.parametrize(("name", "source"), [("vector_literal", "embeddings"), ("retry_plan", "events")])
def test_every_row_is_covered(spark, name, source):
    assert QUERIES[name](spark, SF).count() == spark.read.parquet(f"{SF}/{source}.parquet").count() > 100


def test_bigrams_of_whole_texts(spark, tmp_path):
    texts = ["ab" * 600 + "xyz", "é😀" * 300 + "\n\nq", "aa", "a", "", None]
    spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {tuple(r) for r in QUERIES["bigrams"](spark, str(tmp_path)).collect()}
    assert got == {(i, len(t) - 1, len({t[k : k + 2] for k in range(len(t) - 1)})) for i, t in enumerate(texts) if t and len(t) > 1}


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_query_without_sql(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_no_task_holds_all_nodes_of_a_graph(spark):
    plan = QUERIES["graph_nodes_in_order"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "row_number" not in plan


def test_sentences_of_odd_texts_are_those_of_the_sql(spark, tmp_path):
    """Null, empty and blank texts, texts of end marks alone, and marks at the beginning."""
    texts = [None, "", " ", "!?", "；。\t", "!a!!", "\n\n", "a|b!\n\n\nc", "\r\n", "😀!😀；"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {tuple(r) for r in QUERIES["sentence_split"](spark, str(tmp_path)).collect()}
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    assert got == set(con.sql(ORACLE["sentence_split"]).fetchall()) and (0, None, None) in got
