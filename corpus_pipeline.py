"""From raw documents to packed sequences: five stages, each written and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from skyledger.llm import mixing, packing, pii, simhash, toxicity
from skyledger.session import tune, work_folder

#: (name, function of session, documents and folder); all but the last return the columns of documents
STAGES = [
    ("toxicity", toxicity.stage),
    ("simhash", simhash.stage),
    ("pii", pii.stage),
    ("mixing", mixing.stage),
    ("packing", packing.stage),
]

#: neither a trained network nor keyed surrogates can be put into SQL; the tests run the stages against brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder: one row for each packed piece.

    Every stage works on all rows the one before it kept. What a stage returns
    is written to the shared folder and read as the next one's documents, so a
    lost executor costs no finished stage. Nulls, empty texts, repeated rows
    and an empty table pass as each stage's docstring says.
    """
    tune(spark)
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    for name, stage in STAGES:
        path = work_folder(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
