"""The stages one after the other against what each should have kept, and the registered queries."""

import sys
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))

import duckdb
import pytest
from brute import documents, frame

import __spark_entry__
import corpus_pipeline
from skyledger.llm import mixing, packing, pii, simhash, toxicity
from skyledger.llm.queries import ORACLES, QUERIES

FOLDER = "/root/testdata/sf0.001"


def test_stages_in_order(spark):
    assert [f for _, f in corpus_pipeline.STAGES] == [toxicity.stage, simhash.stage, pii.stage, mixing.stage, packing.stage]
    assert corpus_pipeline.ORACLE_SQL is None
    names = set(__spark_entry__.queries())
    assert set(QUERIES) | {"pipeline"} <= names and len(QUERIES) == 10


def test_pipeline_end_to_end(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    before = {r["doc_id"]: r["text"] for r in docs.collect()}
    kept = []
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, FOLDER)
        rows = out.collect()
        kept.append((name, rows, docs))
        if name != "packing":
            assert out.columns == docs.columns
            docs = spark.createDataFrame(rows, docs.schema)
    net = toxicity.fit(spark.read.parquet(f"{FOLDER}/documents.parquet"), spark.read.parquet(f"{FOLDER}/labels.parquet"))
    clean = {r["doc_id"] for r in toxicity.score(kept[0][2], net).where("predicted = 0").collect()}
    assert {r["doc_id"] for r in kept[0][1]} == clean
    low = {r["component_id"] for r in simhash.near_duplicates(kept[1][2]).collect()}
    assert {r["doc_id"] for r in kept[1][1]} == low
    made = pii.Surrogates("test")
    assert all(r["text"] == pii.replace(before[r["doc_id"]], made)[0] for r in kept[2][1])
    assert len(kept[2][1]) == len(kept[1][1])
    final = corpus_pipeline.run(spark, FOLDER)
    assert sorted((r["doc_id"], r["piece"], r["ids_crc32"]) for r in final.collect()) == sorted((r["doc_id"], r["piece"], r["ids_crc32"]) for r in kept[4][1])


def test_stages_take_awkward_documents(spark):
    docs = frame(spark)
    for name, stage in corpus_pipeline.STAGES[1:]:
        out = stage(spark, docs, FOLDER)
        rows = out.collect()
        assert rows
        if name == "packing":
            break
        assert out.columns == docs.columns
        docs = spark.createDataFrame(rows, docs.schema)
        assert all(r["_order"] == "x" and r["size"] == 1 and r["fp"] == 7 for r in rows)
    none = frame(spark).limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, FOLDER).count() == 0
    assert len(documents()) == frame(spark).count()


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_queries_equal_their_sql(spark, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{FOLDER}/documents.parquet'")
    rel = con.execute(ORACLES[name])
    columns = [d[0] for d in rel.description]
    got = QUERIES[name](spark, FOLDER)
    assert sorted(columns) == sorted(got.columns)
    assert sorted(tuple(r[c] for c in columns) for r in got.collect()) == sorted(rel.fetchall())
