"""Every registered corpus query over whole tables; with a SQL twin all rows are compared."""

from pathlib import Path

import duckdb
import pytest

import corpus_pipeline
from pulsegrid.llm import queries as Q
from tools.check_oracle import TABLES, rows_of

SF_DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF_DIR).exists(), reason="test tables are not there")
NATIVE = ["op3_preference_format", "op4_rule_cascade", "op8_low_discrepancy_mixing"]
PER_DOCUMENT = [q for q in Q.QUERIES if q.split("_")[0] in ("op1", "op2", "op4", "op5", "op6", "op8", "op9")]


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF_DIR}/{name}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(Q.ORACLES))
def test_query_equals_sql(spark, con, name):
    df = Q.QUERIES[name](spark, SF_DIR)
    result = con.execute(Q.ORACLES[name])
    assert rows_of(df.columns, df.collect()) == rows_of([d[0] for d in result.description], result.fetchall())


@pytest.mark.parametrize("name", NATIVE)
def test_native_queries_run_no_python(spark, name):
    plan = Q.QUERIES[name](spark, SF_DIR)._jdf.queryExecution().executedPlan().toString()
    assert not [node for node in ("Python", "Pandas", "Arrow", "CartesianProduct", "NestedLoop") if node in plan]


@pytest.mark.parametrize("name", PER_DOCUMENT)
def test_one_row_per_document(spark, name):
    ids = spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id").collect()
    assert sorted(r["doc_id"] for r in Q.QUERIES[name](spark, SF_DIR).select("doc_id").collect()) == sorted(r["doc_id"] for r in ids)


def test_pipeline_stages(spark):
    """Each stage keeps what its operator keeps, and hands on the columns of documents."""
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    columns, counts = docs.columns, [docs.count()]
    for name, stage in corpus_pipeline.STAGES:
        docs = spark.createDataFrame(stage(spark, docs, SF_DIR).toPandas()) if name == "packing" else stage(spark, docs, SF_DIR).cache()
        assert docs.columns == columns or name == "packing"
        counts.append(docs.count())
    assert counts[0] > counts[1] > counts[2] == counts[3] > 0 and counts[5] >= counts[4]
    run = corpus_pipeline.run(spark, SF_DIR)
    assert run.columns == docs.columns and run.count() == counts[5]


def test_pipeline_takes_any_rows(spark):
    from .cases import clashing, documents
    docs = clashing(documents(spark))
    for name, stage in corpus_pipeline.STAGES:
        for table in (docs, docs.limit(0)):
            out = stage(spark, table, SF_DIR)
            assert out.count() >= 0 and (out.columns == docs.columns or name == "packing")
    kept = corpus_pipeline.drop_near_copies(spark, docs, SF_DIR).select("doc_id").collect()
    assert sorted((r["doc_id"] is None, r["doc_id"]) for r in kept) == [(False, i) for i in (1, 2, 3, 4, 6, 7, 8, 9)] + [(True, None)] * 2
